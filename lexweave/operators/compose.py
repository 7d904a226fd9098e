"""Segmentation of keys into stored keys and composition of their values by shared rules."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexweave.functions.values import GRAPHEME_VOWELS, PRIMARY, demote_first, occurrences

# German linking elements, silent, and the weights of the segmentation score
# (components, one-letter ones, those of two letters at most, longest less shortest, boundaries).
GERMAN_LINKERS = ("s", "es", "n", "en", "e", "er", "ens")
SCORE_WEIGHTS = (-100, -12, -4, 2, 1)
MAX_LINKER_CANDIDATES = 32


def product(variants: Column) -> Column:
    """Every way to take one variant of each component, joined; the last component varies fastest."""
    return F.aggregate(variants, F.array(F.lit("")), lambda acc, v: F.flatten(F.transform(acc, lambda p: F.transform(v, lambda x: F.concat(p, x)))))


def _stressed(values: Column) -> Column:
    return F.exists(values, lambda x: F.contains(x, F.lit(PRIMARY)))


def _rest_stressed(variants: Column) -> Column:
    return (F.size(variants) > 1) & F.exists(F.slice(variants, F.lit(2), F.greatest(F.size(variants) - 1, F.lit(1))), _stressed)


def _demoted(variants: Column, which: Callable[[Column, Column], Column]) -> Column:
    return F.transform(variants, lambda v, i: F.when(which(i, F.size(variants)), F.transform(v, demote_first)).otherwise(v))


def _consonant_boundaries(components: Column) -> Column:
    heads = F.slice(components, F.lit(1), F.greatest(F.size(components) - 1, F.lit(0)))
    return F.forall(heads, lambda c: ~F.lower(F.substring(c, -1, 1)).rlike(f"[{GRAPHEME_VOWELS}]"))


@dataclass(frozen=True)
class Rule:
    """A composition rule: when it applies and what it makes, both from components and their variants."""

    rule_id: str
    applies: Callable[[Column, Column], Column]
    compose: Callable[[Column], Column]


C0 = Rule("C0", lambda c, v: F.lit(True), product)
C1 = Rule("C1", lambda c, v: _rest_stressed(v), lambda v: product(_demoted(v, lambda i, n: i > 0)))
C2 = Rule("C2", lambda c, v: (F.size(v) > 1) & _stressed(F.element_at(v, -1)), lambda v: product(_demoted(v, lambda i, n: i == n - 1)))
C3 = Rule("C3", lambda c, v: _rest_stressed(v) & _consonant_boundaries(c), lambda v: product(_demoted(v, lambda i, n: i > 0)))
RULES = {r.rule_id: r for r in (C0, C1, C2, C3)}
#: Rules by profile, in the order in which the first that applies wins.
PROFILES = {"generic": (C0,), "de-compound": (C1, C0), "de-boundary": (C1, C2, C3, C0), "de-linkers": (C1, C2, C3, C0)}


def propose(components: Column, variants: Column, rules: tuple[Rule, ...] = PROFILES["de-boundary"]) -> Column:
    """Every applicable rule with what it makes, in order."""
    each = [F.when(r.applies(components, variants), F.struct(F.lit(r.rule_id).alias("rule_id"), r.compose(variants).alias("pronunciation"))) for r in rules]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def derive(components: Column, variants: Column, rules: tuple[Rule, ...] = PROFILES["de-compound"]) -> Column:
    """The first applicable rule's id and product."""
    return F.coalesce(*[F.when(r.applies(components, variants), F.struct(F.lit(r.rule_id).alias("rule_id"), r.compose(variants).alias("pronunciation"))) for r in rules])


def two_part_splits(words: DataFrame, literals: DataFrame) -> DataFrame:
    """(key, i, left, right): all splits of words into two stored keys, i the length of the left one."""
    n = F.char_length("key")
    each = words.select("key", F.explode(F.when(n > 1, F.sequence(F.lit(1), n - 1))).alias("i"))
    each = each.select("key", "i", F.substring("key", F.lit(1), F.col("i")).alias("left"), F.substring("key", F.col("i") + 1, n).alias("right"))
    stored = literals.select("key")
    return each.join(stored.withColumnRenamed("key", "left"), "left", "left_semi").join(stored.withColumnRenamed("key", "right"), "right", "left_semi").select("key", "i", "left", "right")


def best_two_part(words: DataFrame, literals: DataFrame) -> DataFrame:
    """The split with the longest left half."""
    best = F.max_by(F.struct("left", "right"), "i").alias("_b")
    return two_part_splits(words, literals).groupBy("key").agg(best).select("key", "_b.*")


def linker_candidates(words: DataFrame, literals: DataFrame, linkers: tuple[str, ...] = GERMAN_LINKERS, limit: int = MAX_LINKER_CANDIDATES) -> DataFrame:
    """(key, left, linker, right, place): stored halves around a linking element, the longest left first, limit a word."""
    each = None
    for linker in linkers:
        part = words.select("key", F.lit(linker).alias("linker"), F.explode(occurrences(F.col("key"), F.lit(linker))).alias("i"))
        each = part if each is None else each.unionByName(part)
    n = F.char_length("key")
    each = each.select("key", "linker", F.substring("key", F.lit(1), F.col("i") - 1).alias("left"), F.substring("key", F.col("i") + F.char_length("linker"), n).alias("right")).where("right <> ''")
    stored = literals.select("key")
    each = each.join(stored.withColumnRenamed("key", "left"), "left", "left_semi").join(stored.withColumnRenamed("key", "right"), "right", "left_semi")
    order = Window.partitionBy("key").orderBy(F.desc(F.char_length("left")), "left", "linker", "right")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("key", "left", "linker", "right", "place")


def substrings(words: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, s, n, atom): every place where a stored key stands in a word."""
    n = F.char_length("key")
    starts = words.select("key", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("s"))
    each = starts.select("key", "s", F.explode(F.sequence(F.lit(1), F.char_length("key") - F.col("s"))).alias("n"))
    each = each.select("key", "s", "n", F.substring("key", F.col("s") + 1, F.col("n")).alias("atom"))
    return each.join(stored.select(F.col("key").alias("atom")), "atom", "left_semi")


def atoms(found: DataFrame, literals: DataFrame) -> DataFrame:
    """(key, atoms): of found substrings those that literals has, as (start, length) in order, a row a word."""
    found = found.join(literals.select(F.col("key").alias("atom")), "atom", "left_semi")
    return found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("atoms"))


def segmentation_score(lengths: list[int]) -> int:
    """Fixed integer weights over a segmentation's component lengths."""
    one, short = sum(n == 1 for n in lengths), sum(n <= 2 for n in lengths)
    spread = max(lengths) - min(lengths) if lengths else 0
    return sum(w * x for w, x in zip(SCORE_WEIGHTS, (len(lengths), one, short, spread, max(0, len(lengths) - 1)), strict=True))


def _rank(parts: tuple[str, ...]) -> tuple:
    return (-len(parts), tuple(map(len, parts)), tuple(reversed(parts)))


def segment_word(word: str, at: dict[int, list[int]], max_components: int, k: int, max_states: int, scored: bool) -> list[tuple[str, ...]] | None:
    """The k best segmentations of a word into 2 to max_components atoms; None when more states than allowed are met.

    First the places that 0, 1, 2, ... atoms reach are found, a layer for each count; a place in a layer is a state.
    Then layers are gone through from the last: each place keeps its k best rests by rank, or the best by score; as the
    score isn't a sum over components, that best needn't be the best overall.
    """
    reached: list[set[int]] = [{0}]
    while len(reached) <= max_components and reached[-1]:
        reached.append({place + n for place in reached[-1] for n in at.get(place, ())})
    if sum(map(len, reached)) > max_states:
        return None
    keep, order = (1, lambda p: (segmentation_score([len(x) for x in p]), _rank(p))) if scored else (k, _rank)
    rests: dict[int, list[tuple[str, ...]]] = {}
    for count in range(len(reached) - 1, -1, -1):
        ends = {len(word): [()]} if count > 1 else {}
        whole = {place: {(word[place : place + n], *rest) for n in at.get(place, ()) for rest in rests.get(place + n, ())} for place in reached[count] if place < len(word)}
        rests = {place: heapq.nlargest(keep, found, key=order) for place, found in whole.items()} | {place: found for place, found in ends.items() if place in reached[count]}
    return rests.get(0, [])


def segmentations(words: DataFrame, literals: DataFrame, max_components: int = 4, k: int = 1, max_states: int = 100_000, scored: bool = False, found: DataFrame | None = None) -> DataFrame:
    """(key, place, components, limited): each word's k best segmentations, or one row limited when search gave up.

    found has the words' substrings, if they are known already; those that literals lacks are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, found in zip(b["key"], b["atoms"], strict=True):
                at: dict[int, list[int]] = {}
                for a in found:
                    at.setdefault(a["s"], []).append(a["n"])
                best = segment_word(key, at, max_components, k, max_states, scored)
                rows += [(key, 0, [], True)] if best is None else [(key, i + 1, list(p), False) for i, p in enumerate(best)]
            yield pd.DataFrame(rows, columns=["key", "place", "components", "limited"])

    return atoms(substrings(words, literals) if found is None else found.join(words.select("key"), "key", "left_semi"), literals).mapInPandas(run, "key string, place int, components array<string>, limited boolean")


def with_parts(segments: DataFrame, values: DataFrame) -> DataFrame:
    """segments (key, components) with parts: what values (key, v) has for each component, in order; whole ones only."""
    each = segments.select("key", "components", F.posexplode("components").alias("p", "part"))
    each = each.join(values.withColumnRenamed("key", "part"), "part")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda x: x["v"])
    return each.groupBy("key", "components").agg(parts.alias("parts")).where(F.size("parts") == F.size("components"))
