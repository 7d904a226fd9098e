"""Dictionary reduction: which keys shorter keys rebuild exactly, round by round as their parts are decided."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lexweave.functions.values import runtime_unique, safe_ratio
from lexweave.operators.compose import PROFILES, Rule, derive, linker_candidates, propose, segmentations, substrings, two_part_splits, with_parts
from lexweave.operators.durable import cut


@dataclass(frozen=True)
class ReductionConfig:
    """How keys are rebuilt. max_components of 2 leaves out longer segmentations; recursive lets rebuilt keys be parts."""

    rules: tuple[Rule, ...] = PROFILES["de-compound"]
    max_components: int = 4
    max_states: int = 100_000
    scored: bool = False
    linkers: tuple[str, ...] = ()
    recursive: bool = False


#: Decision per key: is it kept, why, and the candidate that was made.
DECISION = ("key", "variants", "literal", "reason", "rule_id", "components", "candidate", "linker")


def _derived(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """found (key, components, parts, linker) with the first applicable rule's id and product."""
    d = found.withColumn("_d", derive(F.col("components"), F.col("parts"), rules))
    return d.select("key", "components", "linker", F.col("_d.rule_id").alias("rule_id"), F.col("_d.pronunciation").alias("candidate"))


def _with_parts(segments: DataFrame, values: DataFrame) -> DataFrame:
    return with_parts(segments, values.select("key", F.col("variants").alias("v")))


def candidates(words: DataFrame, literals: DataFrame, config: ReductionConfig, splits: DataFrame | None = None, members: DataFrame | None = None, found_atoms: DataFrame | None = None) -> DataFrame:
    """(key, components, linker, rule_id, candidate, limited): what literals make of each word, if anything.

    The split with the longest left half comes first; only words without one are segmented further, then (if
    asked for) from parts that are themselves rebuilt, then around a linking element.
    """
    words = words.select("key")
    lit = literals.select("key", "variants")
    done, left = None, words
    if not config.scored:
        found = two_part_splits(words, literals) if splits is None else splits
        found = found.join(lit.select(F.col("key").alias("left"), F.col("variants").alias("lv")), "left").join(lit.select(F.col("key").alias("right"), F.col("variants").alias("rv")), "right")
        best = found.groupBy("key").agg(F.max_by(F.struct("left", "right", "lv", "rv"), "i").alias("b"))
        done = best.select("key", F.array("b.left", "b.right").alias("components"), F.array("b.lv", "b.rv").alias("parts"), F.lit(None).cast("string").alias("linker"))
        done = _derived(done, config.rules).withColumn("limited", F.lit(False))
        if config.max_components > 2 or config.recursive or config.linkers:
            done, words = cut(done), cut(words)  # read again by every later step
        left = words.join(done.select("key"), "key", "left_anti")
    if config.scored or config.max_components > 2:
        segments = cut(segmentations(left, literals, config.max_components, 1, config.max_states, config.scored, found_atoms))
        more = _with_parts(segments.where("not limited").select("key", "components"), lit).withColumn("linker", F.lit(None).cast("string"))
        more = _derived(more, config.rules).withColumn("limited", F.lit(False))
        gave_up = segments.where("limited").select("key", F.col("components"), F.lit(None).cast("string").alias("linker"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("array<string>").alias("candidate"), F.lit(True).alias("limited"))
        more = cut(more.unionByName(gave_up))
        done = more if done is None else done.unionByName(more)
        left = left.join(more.select("key"), "key", "left_anti")
    if config.recursive and members is not None:
        segments = segmentations(left, members, config.max_components, 1, config.max_states, found=found_atoms).where("not limited")
        more = _with_parts(segments.select("key", "components"), members.select("key", "variants")).withColumn("linker", F.lit(None).cast("string"))
        more = _derived(more, config.rules).withColumn("limited", F.lit(False))
        done = more if done is None else done.unionByName(more)
        left = left.join(more.select("key"), "key", "left_anti")
    if config.linkers:
        found = linker_candidates(left, literals, config.linkers).where("place = 1")
        found = found.join(lit.select(F.col("key").alias("left"), F.col("variants").alias("lv")), "left").join(lit.select(F.col("key").alias("right"), F.col("variants").alias("rv")), "right")
        # A half spelled like the linker is silent with it.
        silent = F.array(F.lit(""))
        parts = F.array(F.when(F.col("left") == F.col("linker"), silent).otherwise(F.col("lv")), silent, F.when(F.col("right") == F.col("linker"), silent).otherwise(F.col("rv")))
        more = _derived(found.select("key", F.array("left", "linker", "right").alias("components"), parts.alias("parts"), "linker"), config.rules).withColumn("limited", F.lit(False))
        done = more if done is None else done.unionByName(more)
    return done


def _waits(source: DataFrame, splits: DataFrame | None, found_atoms: DataFrame | None) -> DataFrame:
    """(key, part): the stored keys whose decisions a key's own decision may depend on."""
    if found_atoms is not None:
        return found_atoms.select("key", F.col("atom").alias("part")).distinct()
    return splits.select("key", F.explode(F.array("left", "right")).alias("part")).distinct()


def greedy_basis(lexicon: DataFrame, config: ReductionConfig | None = None, forced: DataFrame | None = None) -> DataFrame:
    """A decision a key of lexicon (key, variants): kept as a literal, or left out because shorter keys rebuild it.

    A word is rebuilt from proper parts of itself only, so it can be decided once its stored parts are. Each round
    decides every word that waits for no undecided part; words without stored parts come first, all at once. There
    are as many rounds as parts nest in parts, whatever the keys' lengths; each round's decisions are checkpointed
    and only the waits that are left go on. forced (key) are literals whatever can be made of them. Keys are
    distinct; a null key is a literal.
    """
    config = config or ReductionConfig()
    source = cut(lexicon.select("key", "variants"))
    splits = None if config.scored else cut(two_part_splits(source, source))
    found_atoms = cut(substrings(source, source).where("atom <> key")) if config.scored or config.recursive or config.max_components > 2 or config.linkers else None
    waits = _waits(source, splits, found_atoms)
    if forced is not None:
        waits = waits.join(forced.select("key"), "key", "left_anti")
    undecided, waits = source, cut(waits)
    decided, literals = None, None
    while True:
        blocked = waits.select("key").distinct()
        level = cut(undecided.join(blocked, "key", "left_anti"))
        free = level if forced is None else level.join(forced.select("key"), "key", "left_anti")
        if literals is None:
            made = free.select("key", F.lit(None).cast("array<string>").alias("components"), F.lit(None).cast("string").alias("linker"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("array<string>").alias("candidate"), F.lit(False).alias("limited")).where("false")
        else:
            own = None if splits is None else splits.join(free.select("key"), "key", "left_semi")
            own_atoms = None if found_atoms is None else found_atoms.join(free.select("key"), "key", "left_semi")
            made = candidates(free, literals, config, own, source if config.recursive else None, own_atoms)
        j = level.join(made, "key", "left")
        if forced is not None:
            j = j.join(forced.select("key", F.lit(True).alias("_forced")), "key", "left")
        else:
            j = j.withColumn("_forced", F.lit(None).cast("boolean"))
        exact = F.coalesce(F.col("candidate") == F.col("variants"), F.lit(False))
        reason = F.when(F.col("_forced"), "forced").when(F.col("limited"), "search-limit").when(F.col("candidate").isNull(), "no-composition").when(~exact, "pronunciation-mismatch")
        done = cut(j.withColumn("literal", F.coalesce(F.col("_forced"), F.lit(False)) | ~exact).withColumn("reason", reason).select(*DECISION))
        decided = done if decided is None else decided.unionByName(done)
        if not waits.take(1):
            return decided
        kept = done.where("literal").select("key", "variants")
        literals = kept if literals is None else literals.unionByName(kept)
        undecided = source.join(blocked, "key", "left_semi")
        waits = cut(waits.join(done.select(F.col("key").alias("part")), "part", "left_anti"))


def summary(decisions: DataFrame) -> DataFrame:
    """One row: baseline, literal and generated keys, and the share generated."""
    t = decisions.agg(F.count("*").alias("baseline_words"), F.count_if("literal").alias("literal_words"), F.count_if(~F.col("literal")).alias("generated_words"))
    return t.withColumn("reduction_rate", F.round(safe_ratio(F.col("generated_words"), F.col("baseline_words")), 6))


def rule_usage(decisions: DataFrame) -> DataFrame:
    """(rule_id, usage, exact, mismatch) of each rule's chosen candidates."""
    used = decisions.where("rule_id is not null").groupBy("rule_id")
    return used.agg(F.count("*").alias("usage"), F.count_if(~F.col("literal")).alias("exact"), F.count_if("literal").alias("mismatch"))


def failure_reasons(decisions: DataFrame) -> DataFrame:
    return decisions.where("literal and reason is not null").groupBy("reason").agg(F.count("*").alias("words"))


def restore(decisions: DataFrame) -> DataFrame:
    """The whole logical lexicon: literals, and generated keys with what the rules make of them."""
    return decisions.select("key", F.when(F.col("literal"), F.col("variants")).otherwise(F.col("candidate")).alias("variants"))


def reconstruct_lookup(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """queries (key) with outcome literal, generated or miss, and the value; keys that aren't members are misses."""
    found = queries.join(decisions.select("key", "literal", "variants", "candidate"), "key", "left")
    outcome = F.when(F.col("literal").isNull(), "miss").when(F.col("literal"), "literal").otherwise("generated")
    return found.select("key", outcome.alias("outcome"), F.when(F.col("literal"), F.col("variants")).otherwise(F.col("candidate")).alias("variants"))


def verify_candidate(decisions: DataFrame, baseline: DataFrame, miss_words: DataFrame | None = None) -> DataFrame:
    """One row: missing, extra, pronunciation and variant-order mismatches of the restored lexicon, and false hits."""
    j = restore(decisions).withColumnRenamed("variants", "got").join(baseline.select("key", F.col("variants").alias("want")), "key", "full_outer")
    both = F.col("got").isNotNull() & F.col("want").isNotNull()
    order = both & (F.col("got") != F.col("want")) & (F.array_sort(F.array_distinct("got")) == F.array_sort(F.array_distinct("want")))
    out = j.agg(F.count_if(F.col("got").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("extra"), F.count_if(both & (F.col("got") != F.col("want"))).alias("pronunciation_mismatch"), F.count_if(order).alias("variant_order_mismatch"))
    hits = F.lit(0).cast("long")
    if miss_words is not None:
        return out.crossJoin(miss_words.join(decisions.select("key"), "key", "left_semi").agg(F.count("*").alias("false_hits")))
    return out.withColumn("false_hits", hits)


def promotion_candidates(decisions: DataFrame, limit: int = 64) -> DataFrame:
    """(key, score): generated keys by how many substrings of unexplained literals they are."""
    failed = decisions.where("reason in ('pronunciation-mismatch', 'no-composition')").select("key")
    n = F.char_length("key")
    starts = failed.select("key", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    parts = starts.select("key", "s", F.explode(F.sequence(F.lit(1), F.char_length("key") - F.col("s") + 1)).alias("m")).select(F.substring("key", F.col("s"), F.col("m")).alias("key"))
    counted = parts.groupBy("key").agg(F.count("*").alias("score"))
    return counted.join(decisions.where("not literal").select("key"), "key", "left_semi").orderBy(F.desc("score"), "key").limit(limit)


def optimize_basis(lexicon: DataFrame, config: ReductionConfig | None = None, max_passes: int = 1, candidate_limit: int = 4, target_literals: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Promote a generated key to a literal where the whole basis then shrinks; the decisions and a record a trial.

    Each trial is a full rebuild, so a pass costs candidate_limit rebuilds; it ends at the first pass without gain.
    """
    forced: list[str] = []
    best = greedy_basis(lexicon, config)
    size = best.where("literal").count()
    log: list[dict] = []
    for number in range(max_passes):
        gained = False
        for r in promotion_candidates(best, candidate_limit).collect():
            if target_literals is not None and size <= target_literals:
                return best, log
            names = lexicon.sparkSession.createDataFrame([(w,) for w in [*forced, r["key"]]], "key string")
            trial = greedy_basis(lexicon, config, names)
            n = trial.where("literal").count()
            log.append({"pass": number, "key": r["key"], "before": size, "after": n, "accepted": n < size})
            if n < size:
                best, size, gained = trial, n, True
                forced.append(r["key"])
        if not gained:
            break
    return best, log


def alternate_rules(decisions: DataFrame, rules: tuple[Rule, ...] = PROFILES["de-boundary"]) -> DataFrame:
    """(key, rule_id, exact): what every applicable rule makes of the components of keys whose candidate was wrong."""
    failed = decisions.where("reason = 'pronunciation-mismatch' and linker is null").select("key", "components", F.col("variants").alias("want"))
    parts = _with_parts(failed.select("key", "components"), decisions.where("literal").select("key", "variants"))
    made = parts.join(failed.select("key", "want"), "key").withColumn("c", F.explode(propose(F.col("components"), F.col("parts"), rules)))
    return made.select("key", F.col("c.rule_id").alias("rule_id"), (F.col("c.pronunciation") == F.col("want")).alias("exact"))


def legacy_view(lexicon: DataFrame) -> DataFrame:
    """(key, variants) without repeated variants, as the reducer reads sources."""
    return lexicon.select("key", runtime_unique(F.col("variants")).alias("variants"))
