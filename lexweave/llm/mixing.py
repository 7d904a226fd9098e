"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import WORD_PATTERN, cut, hash60, running_sum

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Each source's target from (source, source_size), one row a source.

    Shares go by weight; a source whose share would pass cap times its size gets just that, and the excess is
    shared again among the others. Sorted by size over weight the capped sources come first, so the level is
    found from running sums instead of by repetition: with the first k capped, the rest have
    (total - their caps) / (weights of the rest) per weight. That level rises with k while the next source would
    pass its cap and falls after, so the level is its largest value among those where the next source stays under.
    The table has one row a source, so its windows are small whatever the number of documents.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("_w", pick).withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_all", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    t = t.withColumn("_need", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_need", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    level = F.max(F.when(F.col("_level") <= F.col("_need"), F.col("_level"))).over(Window.partitionBy())
    t = t.withColumn("_found", level)
    return t.select("source", "source_size", F.when(F.col("_found").isNull() | (F.col("_need") < F.col("_found")), F.col("_cap")).otherwise(F.col("_w") * F.col("_found")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs.

    A source's rows stand in the order of the md5 of seed and doc_id. The source is taken whole
    floor(target / size) times, and once more up to the word at which its budget, the target rounded, is
    used up: rows before the cut count whole, the row at the cut in part, later rows not at all.

    Null or empty texts have size 0 and are taken with 0 words; a null source is a source of its own; rows
    that share a doc_id (or have none) are ordered by the md5 of their text, and equal rows get equal shares
    in some order. An empty table gives no rows.
    """
    base = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), seed=seed).alias("_h"), F.xxhash64("text").alias("_tie")))
    rows = base.count()
    per = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    keyed = base.withColumn("_none", F.col("source").isNull()).withColumn("_src", F.coalesce("source", F.lit("")))
    per = per.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src"), "source_size", "target")
    placed = running_sum(keyed, ["_src", "_none"], "_h", ["doc_id", "_tie"], F.col("size"), "_before", rows)
    left = F.col("_budget") - F.col("_whole") * F.col("source_size")
    return (
        placed.join(per, ["_src", "_none"])
        .withColumn("_budget", F.round("target").cast("long"))
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("taken", (F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before")))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "_tie")
    )


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: every column of docs, a row for each time a document is taken.

    The last row of a document may be a prefix of it, ending with the word at which its source's budget ends;
    n_chars, if there, follows the text. Documents without words are kept once. Rows equal in doc_id, source and
    text share what the plan takes of them, in some order: where a budget ends among them, which is in one group a
    source at most, the rows are numbered and the first ones take more.
    """
    plan = mix_plan(docs, weights, share, cap, seed).select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("_tie").alias("__mix_tie"), F.col("size").alias("__mix_size"), F.col("taken").alias("__mix_taken"))
    group = ["__mix_id", "__mix_source", "__mix_tie"]
    plan = plan.groupBy(*group, "__mix_taken").agg(F.max("__mix_size").alias("__mix_size"), F.count("*").alias("__mix_n"))
    # A group takes at most three amounts: before its source's cut, at it and after it.
    plan = cut(plan.groupBy(*group).agg(F.max("__mix_size").alias("__mix_size"), F.sort_array(F.collect_list(F.struct("__mix_taken", "__mix_n")), False).alias("__mix_each")))
    keyed = docs.withColumn("__mix_text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_text") == F.col("__mix_tie"))
    alike = keyed.join(plan.where(F.size("__mix_each") == 1), same).withColumn("__mix_taken", F.col("__mix_each")[0]["__mix_taken"])
    parted = cut(keyed.join(F.broadcast(plan.where(F.size("__mix_each") > 1)), same))
    rows = parted.count()
    if rows:
        # Row ids hold as the rows are kept; null keys would be lost where sums are joined.
        numbered = cut(parted.withColumn("__mix_row", F.monotonically_increasing_id())).withColumn("__mix_h", hash60(F.col("__mix_row"))).withColumn("__mix_key", F.xxhash64(*group))
        numbered = running_sum(numbered, ["__mix_key"], "__mix_h", ["__mix_row"], F.lit(1), "__mix_number", rows)
        n, taken = (lambda i: F.coalesce(F.get("__mix_each", F.lit(i))["__mix_n"], F.lit(0))), (lambda i: F.get("__mix_each", F.lit(i))["__mix_taken"])
        which = F.when(F.col("__mix_number") < n(0), taken(0)).when(F.col("__mix_number") < n(0) + n(1), taken(1)).otherwise(taken(2))
        keyed = alike.unionByName(numbered.withColumn("__mix_taken", which).select(*alike.columns))
    else:
        keyed = alike
    whole = F.when(F.col("__mix_size") > 0, F.floor(F.col("__mix_taken") / F.col("__mix_size"))).otherwise(F.lit(1)).cast("int")
    part = (F.col("__mix_taken") - whole * F.col("__mix_size")).cast("int")
    takes = F.concat(F.array_repeat(F.lit(-1), whole), F.when((F.col("__mix_size") > 0) & (part > 0), F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = keyed.withColumn("__mix_take", F.explode(takes))
    text = F.when(F.col("__mix_take") < 0, F.col("text")).otherwise(F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.greatest(F.col("__mix_take"), F.lit(1))), ""))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__mix_take") < 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.select(*docs.columns)
