"""Report-side operators: skylines, percentiles, samples, statistics, compression accounting."""

from __future__ import annotations

import gzip
import lzma
import zlib
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def pareto(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows that no other row is at least as low as in all metrics and lower in one; null metrics aren't compared.

    For two metrics without nulls a running minimum in sorted order finds them; ranges of the first metric carry
    their own minimum, so nothing is compared pairwise. Other cases use an anti join.
    """
    if len(metrics) == 2:
        a, b = metrics
        best = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.min(b).alias("_m"))
        # One row a distinct value of the first metric.
        before = Window.orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
        front = best.withColumn("_p", F.min("_m").over(before)).where(F.col("_p").isNull() | (F.col("_m") < F.col("_p")))
        return rows.join(front.select(a, F.col("_m").alias(b)), [a, b], "left_semi")
    x, y = rows.alias("x"), rows.alias("y")
    pairs = [(F.col(f"y.{m}"), F.col(f"x.{m}")) for m in metrics]
    worse = reduce(Column.__and__, [F.coalesce(p <= q, F.lit(True)) for p, q in pairs])
    less = reduce(Column.__or__, [F.coalesce(p < q, F.lit(False)) for p, q in pairs])
    return x.join(y, worse & less, "left_anti")


def nearest_rank(rows: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the data: the one at place ceil(n p)."""
    return rows.groupBy(by).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, p in points.items()])


def inclusive(rows: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Interpolated percentiles, and the median."""
    return rows.groupBy(by).agg(*[F.round(F.percentile(value, p), 6).alias(n) for n, p in points.items()], F.round(F.median(value), 6).alias("median"))


def stratified(words: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """About size keys, from each length bucket its share, at a fixed stride in code-point order."""
    t = words.select("key", F.least(F.floor(F.char_length("key") / 4), F.lit(12)).alias("b")).distinct()
    total = t.count()
    if total <= size:
        return t.select("key")
    n = F.count("*").over(Window.partitionBy("b"))
    g = t.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("key")) - 1).withColumn("n", n)
    take = F.greatest(F.lit(1), F.bround(F.lit(float(size)) * F.col("n") / F.lit(float(total)))).cast("long")
    g = g.withColumn("take", take).withColumn("stride", F.col("n").cast("double") / F.col("take"))
    shift = (seed % 3) / 3
    # Place i is picked by the j with int(j * stride + shift) = i.
    j = F.ceil((F.col("i") - shift) / F.col("stride"))
    hit = lambda q: (q >= 0) & (q < F.col("take")) & (F.least(F.floor(q * F.col("stride") + shift), F.col("n") - 1) == F.col("i"))
    return g.where((F.col("take") >= F.col("n")) | hit(j) | hit(j - 1) | hit(j + 1)).select("key")


def source_statistics(rows: DataFrame) -> DataFrame:
    """rows (w, n): physical rows, logical words, ordered variants, duplicates removed; raises if they contradict."""
    t = rows.groupBy("w").agg(F.sum("n").alias("n"))
    out = t.agg(F.sum("n").cast("long").alias("physical_rows"), F.countDistinct(F.lower("w")).alias("logical_words"), F.count("*").alias("ordered_variants"))
    sound = (F.col("physical_rows") >= F.col("ordered_variants")) & (F.col("ordered_variants") >= F.col("logical_words"))
    removed = F.when(sound, F.col("physical_rows") - F.col("ordered_variants")).otherwise(F.raise_error(F.lit("source statistics contradict each other")))
    return out.withColumn("duplicates_removed", removed.cast("long"))


def compression_layers(rows: DataFrame) -> DataFrame:
    """One row of byte counts: raw, and as each row would take by gzip, deflate and xz."""

    @F.pandas_udf("struct<gzip:long,deflate:long,xz:long>")
    def sizes(data: pd.Series) -> pd.DataFrame:
        raw = [bytes(x) for x in data]
        return pd.DataFrame({"gzip": [len(gzip.compress(x, mtime=0)) for x in raw], "deflate": [len(zlib.compress(x)) for x in raw], "xz": [len(lzma.compress(x)) for x in raw]})

    t = rows.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")).select(F.length("b").alias("raw"), sizes("b").alias("s"))
    return t.agg(F.sum("raw").cast("long").alias("raw"), *[F.sum(f"s.{n}").cast("long").alias(n) for n in ("gzip", "deflate", "xz")])


def leaderboard(rows: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)
