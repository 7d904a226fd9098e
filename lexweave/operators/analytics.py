"""Collisions, Unicode and shape statistics of one source, and coverage of an ordered cascade of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexweave.functions.values import TRANSFORMS, all_strings, nfc, nfd, safe_ratio
from lexweave.operators.lookup import VALUE


def collisions(lexicon: DataFrame, transform: str) -> DataFrame:
    """(analysis_key, keys): keys that a transform makes equal, where there are several; repeated keys count."""
    grouped = lexicon.select("key", TRANSFORMS[transform](F.col("key")).alias("analysis_key")).groupBy("analysis_key")
    return grouped.agg(F.sort_array(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1)


def key_statistics(lexicon: DataFrame) -> DataFrame:
    """(transform, collision_groups) for all transforms, in one pass over the keys and one grouping."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("transform"), f(F.col("key")).alias("k")) for n, f in TRANSFORMS.items()])).alias("t")
    groups = lexicon.select(each).select("t.*").groupBy("transform", "k").agg(F.count("*").alias("n"))
    return groups.groupBy("transform").agg(F.count_if(F.col("n") > 1).alias("collision_groups"))


def unicode_statistics(lexicon: DataFrame) -> DataFrame:
    """One row: keys and values that aren't NFC, and distinct keys after NFC and NFD."""
    strings = all_strings(F.col("variants"), F.col("items"))
    t = lexicon.select("key", nfc(F.col("key")).alias("c"), nfd(F.col("key")).alias("d"), strings.alias("s"))
    values = t.select(F.explode("s").alias("s")).select("s", nfc(F.col("s")).alias("n")).agg(F.count_if(F.col("s") != F.col("n")).alias("non_nfc_pronunciation_strings"))
    keys = t.agg(F.count_if(F.col("key") != F.col("c")).alias("non_nfc_spellings"), F.countDistinct("c").alias("nfc_distinct_spelling_count"), F.countDistinct("d").alias("nfd_distinct_spelling_count"))
    groups = t.groupBy("c").count().agg(F.count_if(F.col("count") > 1).alias("nfc_collision_groups"))
    return keys.crossJoin(values).crossJoin(groups)


def source_shape(lexicon: DataFrame, physical_rows: int | None = None) -> DataFrame:
    """One row: rows, keys, values, words with several variants, most variants, repeated values."""
    s = all_strings(F.col("variants"), F.col("items"))
    n = F.size("s")
    out = lexicon.select(s.alias("s")).agg(
        F.count("*").alias("logical_spellings"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("pronunciation_value_count"),
        F.count_if(n > 1).alias("multi_variant_words"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("maximum_variant_count"),
        F.coalesce(F.sum(n - F.size(F.array_distinct("s"))), F.lit(0)).cast("long").alias("duplicate_identical_rows"),
    )
    return out.withColumn("physical_rows", F.lit(physical_rows).cast("long") if physical_rows is not None else F.col("pronunciation_value_count"))


def source_summary(lexicon: DataFrame, name: str, physical_rows: int | None = None) -> DataFrame:
    stats = key_statistics(lexicon).groupBy().pivot("transform", list(TRANSFORMS)).agg(F.first("collision_groups"))
    stats = stats.select(*[F.col(n).alias(f"{n}_collision_groups") for n in TRANSFORMS if n != "nfc"])
    return source_shape(lexicon, physical_rows).crossJoin(unicode_statistics(lexicon)).crossJoin(stats).withColumn("source", F.lit(name))


def cascade_rows(layers: DataFrame, words: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """A row a word: its selected layer and value, how many layers have it, whether they differ, exact against reference."""
    value = F.struct(*VALUE)
    hits = layers.groupBy("key").agg(
        F.min_by(F.struct("layer", value.alias("value")), "layer_idx").alias("sel"),
        F.count("*").alias("hits"),
        F.size(F.collect_set(F.to_json(value))).alias("distinct_values"),
        F.collect_set(F.to_json(value)).alias("all"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer_idx", "layer"))), lambda x: x["layer"]), "|").alias("hit_sources"),
    )
    asked = hits.select("key") if words is None else words.select("key").distinct()
    t = asked.join(hits, "key", "left")
    out = t.select("key", F.col("sel.layer").alias("selected"), F.col("sel.value").alias("value"), "all", F.coalesce("hit_sources", F.lit("")).alias("hit_sources"), F.coalesce(F.col("distinct_values") > 1, F.lit(False)).alias("conflict"))
    if reference is None:
        return out.select("key", "selected", "hit_sources", "conflict")
    ref = reference.select("key", F.to_json(value).alias("want"))
    j = out.join(ref, "key", "left")
    exact = F.when(F.col("want").isNotNull(), F.coalesce(F.to_json("value") == F.col("want"), F.lit(False)))
    oracle = F.when(F.col("want").isNotNull(), F.coalesce(F.array_contains("all", F.col("want")), F.lit(False)))
    return j.select("key", "selected", "hit_sources", "conflict", exact.alias("exact"), oracle.alias("oracle"))


def cascade_by_source(rows: DataFrame) -> DataFrame:
    """(layer, incremental_hits, conflict_wins, incremental_exact, incremental_errors, hits)."""
    won = rows.where("selected is not null").groupBy(F.col("selected").alias("layer")).agg(
        F.count("*").alias("incremental_hits"),
        F.count_if("conflict").alias("conflict_wins"),
        F.count_if("exact").alias("incremental_exact"),
        F.count_if(~F.col("exact")).alias("incremental_errors"),
    )
    hits = rows.where("hit_sources <> ''").select(F.explode(F.split("hit_sources", r"\|")).alias("layer")).groupBy("layer").agg(F.count("*").alias("hits"))
    out = hits.join(won, "layer", "left")
    return out.select("layer", "hits", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("incremental_hits", "conflict_wins", "incremental_exact", "incremental_errors")])


def cascade_totals(rows: DataFrame) -> DataFrame:
    """One row: words, misses, coverage, exact matches of the selected value and of any layer's."""
    t = rows.agg(F.count("*").alias("total"), F.count_if(F.col("selected").isNull()).alias("misses"), F.count_if("exact").alias("selected_exact"), F.count_if("oracle").alias("oracle_exact"))
    return t.withColumn("coverage", F.round(safe_ratio(F.col("total") - F.col("misses"), F.col("total")), 6))
