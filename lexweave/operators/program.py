"""Programs of stages that each propose what a word may be pronounced like, and a selector that takes one proposal."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lexweave.operators import models, reduction

#: Proposals of a stage: place orders those of one word within the stage.
PROPOSAL = ("key", "place", "rule", "score", "pronunciation")
Stage = Callable[[DataFrame, DataFrame], DataFrame]
Selector = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Program:
    """Named stages, (words, literals) -> PROPOSAL, in order, and a selector.

    A selector is given candidates (id, stage, rule, score) and features (id, feature, value) and returns one
    candidate an id at most; without one the first proposal of the first stage that has any is taken.
    """

    stages: Sequence[tuple[str, Stage]]
    selector: Selector | None = None


def compound(config: reduction.ReductionConfig | None = None) -> Stage:
    """What a reduction's composer makes of literals; nothing where its search gave up."""

    def run(words: DataFrame, literals: DataFrame) -> DataFrame:
        made = reduction.candidates(words, literals, config or reduction.ReductionConfig()).where("candidate is not null")
        return made.select("key", F.lit(1).alias("place"), F.col("rule_id").alias("rule"), F.lit(0).alias("score"), F.col("candidate").alias("pronunciation"))

    return run


def affixes(rules: DataFrame) -> Stage:
    """Affix rules on stems that are literals, in the order of their ids."""

    def run(words: DataFrame, literals: DataFrame) -> DataFrame:
        made = models.apply_affixes(words, literals, rules)
        return made.select("key", F.col("rule_id").cast("int").alias("place"), F.col("rule_id").cast("string").alias("rule"), F.lit(0).alias("score"), "pronunciation")

    return run


def rewrites(stage: Stage, rules: DataFrame) -> Stage:
    """Rewrite rules on the first variant of what another stage proposes, in the order of their ids."""

    def run(words: DataFrame, literals: DataFrame) -> DataFrame:
        before = stage(words, literals).select("key", F.element_at("pronunciation", 1).alias("pronunciation"))
        made = models.apply_rewrites(before, rules)
        return made.select("key", F.col("rule_id").cast("int").alias("place"), F.col("rule_id").cast("string").alias("rule"), F.lit(0).alias("score"), F.array("rewritten").alias("pronunciation"))

    return run


def predictions(predict: Callable[[DataFrame], DataFrame]) -> Stage:
    """A model's (key, output) for each word; empty and null outputs are no proposals."""

    def run(words: DataFrame, literals: DataFrame) -> DataFrame:
        made = predict(words.select("key")).where("output <> ''")
        return made.select("key", F.lit(1).alias("place"), F.lit("").alias("rule"), F.lit(0).alias("score"), F.array("output").alias("pronunciation"))

    return run


def gather(program: Program, words: DataFrame, literals: DataFrame) -> DataFrame:
    """(key, order, stage, PROPOSAL's others): all proposals of all stages; order is the stage's place in the program."""
    found = None
    for i, (name, stage) in enumerate(program.stages):
        one = stage(words, literals).select(F.lit(i).alias("order"), F.lit(name).alias("stage"), *PROPOSAL)
        found = one if found is None else found.unionByName(one)
    return found


def program_features(proposals: DataFrame) -> DataFrame:
    """(id, feature, value): word_length, candidate_count and the sorted stage_ids of each word with proposals."""
    per = proposals.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("stage")), ",").alias("s"))
    each = F.array(*[F.struct(F.lit(f).alias("feature"), v.cast("string").alias("value")) for f, v in (("word_length", F.char_length("key")), ("candidate_count", F.col("n")), ("stage_ids", F.col("s")))])
    return per.select(F.col("key").alias("id"), F.inline(each))


def reconstruct(program: Program, words: DataFrame, literals: DataFrame) -> DataFrame:
    """(key, stage, rule, pronunciation) of each of words that some stage has a proposal for; others have no row.

    Of proposals that a selector can't tell apart the earliest stands.
    """
    found = gather(program, words.select("key"), literals)
    early = F.struct("order", "place", "rule", "pronunciation")
    if program.selector is None:
        return found.groupBy("key").agg(F.min_by(F.struct("stage", "rule", "pronunciation"), early).alias("b")).select("key", "b.*")
    told = found.groupBy("key", "stage", "rule", "score").agg(F.min_by("pronunciation", early).alias("pronunciation"))
    chosen = program.selector(found.select(F.col("key").alias("id"), "stage", "rule", "score"), program_features(found))
    a, b = chosen.alias("a"), told.alias("b")
    same = (F.col("a.id") == F.col("b.key")) & F.col("a.stage").eqNullSafe(F.col("b.stage")) & F.col("a.rule").eqNullSafe(F.col("b.rule")) & F.col("a.score").eqNullSafe(F.col("b.score"))
    return a.join(b, same).select("b.key", "b.stage", "b.rule", "b.pronunciation")


def lookup(program: Program, queries: DataFrame, literals: DataFrame, members: DataFrame) -> DataFrame:
    """queries (key) with outcome literal, generated, unresolved (a member without a proposal) or miss, and variants."""
    asked = queries.select("key").join(members.select("key", F.lit(True).alias("_member")), "key", "left")
    asked = asked.join(literals.select("key", F.col("variants").alias("_own"), F.lit(True).alias("_literal")), "key", "left")
    made = reconstruct(program, asked.where("_member and _literal is null").select("key").distinct(), literals).select("key", F.col("pronunciation").alias("_made"))
    j = asked.join(made, "key", "left")
    outcome = F.when(F.col("_member").isNull(), "miss").when(F.col("_literal"), "literal").when(F.col("_made").isNotNull(), "generated").otherwise("unresolved")
    return j.select("key", outcome.alias("outcome"), F.when(F.col("_member"), F.coalesce("_own", "_made")).alias("variants"))
