"""Diff, verification, agreement between sources, sharing and hashes as joins and aggregates."""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.functions.values import TRANSFORMS, all_strings, canonical_bytes, safe_ratio
from lexweave.operators.lookup import VALUE


def _sides(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    left = a.select("key", F.struct(*VALUE).alias("a"))
    right = b.select("key", F.struct(*VALUE).alias("b"))
    return left.join(right, "key", how)


def _n(cond: Column, name: str) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0)).cast("long").alias(name)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_a, only_b, same, different (shape differences among them), shape_different."""
    j = _sides(a, b, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    shape = both & (F.col("a.kind") != F.col("b.kind"))
    same = both & F.col("a").eqNullSafe(F.col("b"))
    return j.agg(_n(F.col("b").isNull(), "only_a"), _n(F.col("a").isNull(), "only_b"), _n(same, "same"), _n(both & ~same, "different"), _n(shape, "shape_different"))


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def verify(asset: DataFrame, source: DataFrame) -> DataFrame:
    """One row of counts: missing, extra and what kinds of values differ; lossless if all are 0.

    A shape mismatch isn't counted as a value mismatch too. Variants with equal sets are an order mismatch even
    if their multiplicities differ. A tag that either side lacks or has as null counts as a null mismatch of its
    key, as an explicit null of the source does.
    """
    j = _sides(source, asset, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    shape = both & (F.col("a.kind") != F.col("b.kind"))
    value = both & ~shape & ~F.col("a").eqNullSafe(F.col("b"))
    tags = lambda s: _set(F.transform(F.col(f"{s}.items"), lambda i: i["tag"]))
    live = lambda s: F.transform(F.filter(F.col(f"{s}.items"), lambda i: i["sel_kind"] != "null"), lambda i: i["tag"])
    null = F.exists(F.col("a.items"), lambda i: ~(F.array_contains(live("a"), i["tag"]) & F.array_contains(live("b"), i["tag"])))
    tagged = value & (F.col("a.kind") == "tagged")
    out = j.agg(
        _n(F.col("a").isNotNull(), "source_entry_count"),
        _n(F.col("b").isNotNull(), "asset_entry_count"),
        _n(F.col("b").isNull(), "missing"),
        _n(F.col("a").isNull(), "extra"),
        _n(shape, "shape_mismatch"),
        _n(value, "value_mismatch"),
        _n(tagged & (tags("a") != tags("b")), "tag_mismatch"),
        _n(tagged & null, "null_mismatch"),
        _n(value & (F.col("a.kind") == "list") & (_set(F.col("a.variants")) == _set(F.col("b.variants"))), "variant_order_mismatch"),
    )
    return out.withColumn("lossless", F.expr("missing + extra + shape_mismatch + value_mismatch = 0"))


def entry_hashes(lexicon: DataFrame) -> DataFrame:
    """(key, sha256) of each row's canonical bytes."""
    return lexicon.select("key", F.sha2(canonical_bytes(F.col("key"), F.col("kind"), F.col("variants"), F.col("items")), 256).alias("sha256"))


def logical_sha256(lexicon: DataFrame) -> str:
    """SHA-256 of all rows' canonical bytes in key order. The hash can't be merged, so rows stream through the driver."""
    h = hashlib.sha256()
    rows = lexicon.select("key", canonical_bytes(F.col("key"), F.col("kind"), F.col("variants"), F.col("items")).alias("b")).orderBy("key").select("b")
    for r in rows.toLocalIterator():
        h.update(r["b"])
    return h.hexdigest()


def content_fingerprint(lexicon: DataFrame) -> DataFrame:
    """One row (entries, digest): a hash of content that tasks sum, for tables too large to hash in order."""
    part = F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(38,0)")
    return entry_hashes(lexicon).agg(F.count("*").alias("entries"), F.sum(part).alias("digest"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row a shared key: exact_typed, any_variant, variant_class, shape_conflict, value_conflict."""
    j = _sides(a, b, "inner")
    va, vb = (all_strings(F.col(f"{s}.variants"), F.col(f"{s}.items")) for s in "ab")
    j = j.withColumn("va", va).withColumn("vb", vb)
    exact = F.col("a").eqNullSafe(F.col("b"))
    overlap = F.size(F.array_intersect("va", "vb")) > 0
    cls = F.when(F.col("va") == F.col("vb"), "same_ordered_tuple").when(_set(F.col("va")) == _set(F.col("vb")), "same_unordered_variant_set").when(overlap, "partial_variant_overlap").otherwise("no_variant_overlap")
    return j.select("key", exact.alias("exact_typed"), overlap.alias("any_variant"), cls.alias("variant_class"), (F.col("a.kind") != F.col("b.kind")).alias("shape_conflict"), (~exact & ~overlap).alias("value_conflict"), F.array_join("va", "|").alias("left_variants"), F.array_join("vb", "|").alias("right_variants"))


def conflict_samples(a: DataFrame, b: DataFrame, limit: int = 1000) -> DataFrame:
    """The first limit keys whose values aren't equal or share no variant."""
    if limit < 0:
        raise ValueError("conflict limit must be non-negative")
    return agreement(a, b).where("not exact_typed or not any_variant").orderBy("key").limit(limit)


def _keys(df: DataFrame, name: str) -> DataFrame:
    return df.select(TRANSFORMS[name](F.col("key")).alias("k")).distinct()


def compare_sources(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """One row of overlap and agreement counts of two sources."""
    rows = agreement(a, b).agg(
        F.count("*").alias("exact_spelling_intersection"),
        _n(F.col("exact_typed"), "exact_typed_agreement"),
        _n(F.col("any_variant"), "pronunciation_any_variant_agreement"),
        _n(F.col("shape_conflict"), "shape_conflicts"),
        _n(F.col("value_conflict"), "value_conflicts"),
        _n(~F.col("exact_typed"), "conflicting_overlapping_entries"),
        *[_n(F.col("variant_class") == c, c) for c in ("same_ordered_tuple", "same_unordered_variant_set", "partial_variant_overlap", "no_variant_overlap")],
    )
    counts = a.agg(F.count("*").alias("logical_entry_count_a")).crossJoin(b.agg(F.count("*").alias("logical_entry_count_b")))
    out = counts.crossJoin(rows)  # rows of one aggregate each
    for t, name in (("lower", "lowercase_key_intersection"), ("casefold", "casefold_key_intersection"), ("nfc", "nfc_key_intersection")):
        out = out.crossJoin(_keys(a, t).join(_keys(b, t), "k", "left_semi").agg(F.count("*").alias(name)))
    union = F.col("logical_entry_count_a") + F.col("logical_entry_count_b") - F.col("exact_spelling_intersection")
    out = out.withColumn("exact_spelling_union", union).withColumn("jaccard_overlap", safe_ratio(F.col("exact_spelling_intersection"), F.col("exact_spelling_union")))
    return out.withColumn("source_a", F.lit(name_a)).withColumn("source_b", F.lit(name_b))


def pairwise(sources: dict[str, DataFrame]) -> DataFrame:
    """compare_sources for every pair, by name."""
    out = None
    for x, y in combinations(sorted(sources), 2):
        row = compare_sources(sources[x], sources[y], x, y)
        out = row if out is None else out.unionByName(row)
    return out


def sharing(sources: dict[str, DataFrame]) -> DataFrame:
    """A row a pair: keys with equal typed values, keys that share a variant, and strings that both use."""
    out = None
    for x, y in combinations(sorted(sources), 2):
        a, b = sources[x], sources[y]
        rows = agreement(a, b).agg(_n(F.col("exact_typed"), "identical_typed"), _n(F.col("any_variant"), "shared_variant"))
        sa, sb = (d.select(F.explode(all_strings(F.col("variants"), F.col("items"))).alias("s")).distinct() for d in (a, b))
        row = rows.crossJoin(sa.join(sb, "s", "left_semi").agg(F.count("*").alias("shared_strings"))).select(F.lit(x).alias("source_a"), F.lit(y).alias("source_b"), "*")
        out = row if out is None else out.unionByName(row)
    return out
