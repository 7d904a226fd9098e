"""Reduction runs described as data: strict configurations with inheritance, single runs, all cases, and a matrix."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Mapping, Sequence
from dataclasses import fields
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, functions as F

from lexweave.operators.compose import PROFILES, RULES
from lexweave.operators.reduction import ReductionConfig, greedy_basis, optimize_basis, summary, verify_candidate

#: What a case may say besides ReductionConfig's fields; rules are given as a profile's name or as rule ids.
EXTRA = {"name", "inherits", "profile", "forced", "max_passes", "candidate_limit", "target_literals"}
KNOWN = {f.name for f in fields(ReductionConfig)} | EXTRA
DEFAULTS = {"profile": "de-compound", "max_components": 4, "max_states": 100_000, "scored": False, "linkers": [], "recursive": False, "forced": [], "max_passes": 0, "candidate_limit": 4, "target_literals": None}


def merged(low: Mapping, high: Mapping) -> dict:
    """high over low, table by table; lists and scalars are replaced as a whole."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def canonical_sha256(value: Mapping) -> str:
    """SHA-256 of the value's canonical JSON: sorted keys, no spaces, UTF-8."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def resolve(cases: Mapping[str, Mapping], defaults: Mapping | None = None, strict: bool = True) -> dict[str, dict]:
    """Each case with what it inherits (a name or several, later ones win), the defaults below, and its config_sha256.

    Raises ValueError for no cases, unknown keys (if strict), unknown parents, cycles, and bounds below one.
    """
    if not cases:
        raise ValueError("a configuration needs a case")
    parents = {}
    for name, case in cases.items():
        unknown = sorted(set(case) - KNOWN)
        if strict and unknown:
            raise ValueError(f"case {name}: unknown keys {', '.join(unknown)}")
        above = case.get("inherits") or []
        parents[name] = [above] if isinstance(above, str) else list(above)
        missing = [p for p in parents[name] if p not in cases]
        if missing:
            raise ValueError(f"case {name}: no case {', '.join(missing)} to inherit from")
    try:
        order = list(TopologicalSorter(parents).static_order())
    except CycleError as e:
        raise ValueError(f"cases inherit in a circle: {' -> '.join(e.args[1])}") from e
    own: dict[str, dict] = {}
    for name in order:
        base: dict = {}
        for p in parents[name]:
            base = merged(base, own[p])
        own[name] = merged(base, {k: v for k, v in cases[name].items() if k not in ("inherits", "name")})
    out = {}
    for name in cases:
        case = merged(merged(DEFAULTS, defaults or {}), own[name])
        if min(int(case["max_components"]), int(case["max_states"])) < 1:
            raise ValueError(f"case {name}: max_components and max_states must be positive")
        out[name] = case | {"name": name, "config_sha256": canonical_sha256(case)}
    return out


def matrix(base: Mapping, axes: Mapping[str, Sequence]) -> dict[str, dict]:
    """A case for each combination of the axes' values over base, named by them in the axes' order."""
    each = itertools.product(*axes.values())
    return {"-".join(f"{k}={json.dumps(v, ensure_ascii=False)}" for k, v in zip(axes, values, strict=True)): merged(base, dict(zip(axes, values, strict=True))) for values in each}


def reduction_config(case: Mapping) -> ReductionConfig:
    """A resolved case's ReductionConfig; rules by id go before the profile."""
    ids = case.get("rules")
    try:
        rules = tuple(RULES[i] for i in ids) if ids else PROFILES[case["profile"]]
    except KeyError as e:
        raise ValueError(f"no rule or profile {e.args[0]}") from e
    return ReductionConfig(rules, int(case["max_components"]), int(case["max_states"]), bool(case["scored"]), tuple(case["linkers"]), bool(case["recursive"]))


def run_case(lexicon: DataFrame, case: Mapping) -> tuple[DataFrame, DataFrame]:
    """A resolved case's decisions, and one row: case, config_sha256, the summary, the verification and lossless."""
    spark, config = lexicon.sparkSession, reduction_config(case)
    if case["max_passes"]:
        decisions, _ = optimize_basis(lexicon, config, int(case["max_passes"]), int(case["candidate_limit"]), case["target_literals"])
    else:
        forced = spark.createDataFrame([(w,) for w in case["forced"]], "key string") if case["forced"] else None
        decisions = greedy_basis(lexicon, config, forced)
    checked = verify_candidate(decisions, lexicon)
    lossless = sum(F.col(c) for c in checked.columns) == 0
    row = summary(decisions).crossJoin(checked.withColumn("lossless", lossless))  # two rows of one
    return decisions, row.select(F.lit(case["name"]).alias("case"), F.lit(case["config_sha256"]).alias("config_sha256"), "*")


def run_cases(lexicon: DataFrame, cases: Mapping[str, Mapping]) -> DataFrame:
    """run_case's row of each resolved case; the lexicon is read once a case."""
    rows = None
    for case in cases.values():
        one = run_case(lexicon, case)[1]
        rows = one if rows is None else rows.unionByName(one)
    return rows


def ranked(rows: DataFrame) -> DataFrame:
    """run_cases' rows as a leaderboard: lossless ones first, then the fewest literals, then by name."""
    return rows.orderBy(F.desc("lossless"), "literal_words", "case")
