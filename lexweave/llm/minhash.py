"""Near-duplicate documents by MinHash banding, verification on whole shingle sets, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.common import Scratch, arrow_bytes, cool, cut, mix, shingles, text_slices, words

#: 20 bands of 5 minima: a pair at similarity 0.8 shares a band with probability 1 - 4e-4, at 0.85 1 - 8e-6.
BANDS, ROWS = 20, 5
#: Bits of the filter that keeps rows without candidates out of a shuffle: 8 MB.
FILTER_BITS = 1 << 26

_SEED = np.arange(1, 2 * 1024 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n multiply-add hashes on 64 bits, fixed."""
    with np.errstate(over="ignore"):
        r = mix(_SEED[: 2 * n])
    return r[:n] | np.uint64(1), r[n:]


def signatures(sets: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of n universal hashes over each set (its first 16 bits kept); sets must not be empty."""
    mul, add = _universal(n)
    out = np.empty((len(at) - 1, n), dtype=np.uint16)
    with np.errstate(over="ignore"):
        for k in range(n):
            # The least of many hashes begins with noughts: its bits are mixed before 16 are kept.
            out[:, k] = (mix(np.minimum.reduceat(sets * mul[k] + add[k], at[:-1])) >> np.uint64(48)).astype(np.uint16)
    return out


def sketches(docs: DataFrame, size: int, minima: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of every row; the last two are null for rows without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for whole in batches:
            for b in text_slices(whole, 1):
                hashed, _, _, at = words(*arrow_bytes(b.column(1)), lower=True)
                sets, own = shingles(hashed, at, size)
                counts = np.diff(own)
                full = counts > 0
                keys, signed = [None] * len(counts), [None] * len(counts)
                if full.any():
                    starts = np.concatenate([own[:-1][full], own[-1:]])
                    sig = signatures(sets, starts, minima)
                    with np.errstate(over="ignore"):
                        one = np.add.reduceat(mix(sets), starts[:-1])
                        two = np.bitwise_xor.reduceat(mix(sets * np.uint64(0xD6E8FEB86659FD93)), starts[:-1])
                    key = np.stack([one, two], 1).astype("<u8")
                    for j, d in enumerate(np.flatnonzero(full).tolist()):
                        keys[d], signed[d] = key[j].tobytes(), sig[j].view(np.int16)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.list_(pa.int16()))], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature array<short>")


def banded(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(class, bucket): a row for each band of each class's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                sig = b.column(1).flatten().to_numpy().view(np.uint16).reshape(-1, bands * rows)
                hashes = np.zeros((len(sig), bands), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
                    hashes = hashes * np.uint64(31) + np.arange(bands, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(sig)), bands))), pa.array(hashes.ravel().view(np.int64))], ["class", "bucket"])

    return classes.select("class", "signature").mapInArrow(run, "class long, bucket long")


def likely_among(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """docs without most rows whose doc_id isn't among ids (one column, count rows), so that fewer are shuffled.

    A bit for each hash of an id, in at most FILTER_BITS bits, goes to all tasks. With more ids than that tells apart
    fewer rows are left out; a row that is among ids never is.
    """
    bits = min(FILTER_BITS, 1 << max(10, (16 * max(1, count) - 1).bit_length()))
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(bits))
    words_ = ids.select(place.alias("p")).selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, cast(p % 64 AS int)) AS v").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    held = np.zeros(bits // 64, dtype=np.int64)  # at most FILTER_BITS / 64 rows
    held[words_.column("w").to_numpy()] = words_.column("v").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def among(hashed: pd.Series) -> pd.Series:
        h = hashed.to_numpy()
        return pd.Series((shared.value[h >> 6] >> (h & 63)) & 1 == 1)

    return docs.where(among(F.pmod(F.xxhash64("doc_id"), F.lit(bits))))


def agreeing(pairs: DataFrame, classes: DataFrame, percent: int, minima: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in as many places as similar sets' do but for one in 10 million."""
    p = percent / 100
    least = max(1, int(minima * p - 5.5 * (minima * p * (1 - p)) ** 0.5))
    a, b = (classes.select(F.col("class").alias(c), F.col("signature").alias(f"s{c}")) for c in "ab")
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    return pairs.join(a, "a").join(b, "b").where(equal >= least).select("a", "b").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole shingle sets have 100 * intersection >= percent * union.

    The texts, which are shorter than their sets, are joined to the pairs and shingled again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for whole in batches:
            for b in text_slices(whole, 2, 3):
                sides = []
                for c in (2, 3):
                    hashed, _, _, at = words(*arrow_bytes(b.column(c)), lower=True)
                    sides.append(shingles(hashed, at, size))
                keep = []
                (left, la), (right, ra) = sides
                for j in range(b.num_rows):
                    x, y = left[la[j] : la[j + 1]], right[ra[j] : ra[j + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    a = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    """(class, part, shingle): the distinct shingles of each of docs, a row each; part tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for whole in batches:
            for b in text_slices(whole, 1):
                hashed, _, _, at = words(*arrow_bytes(b.column(1)), lower=True)
                sets, own = shingles(hashed, at, size)
                text = np.repeat(np.arange(b.num_rows), np.diff(own))
                part = np.zeros(b.num_rows, dtype=np.uint64)
                np.add.at(part, text, mix(sets))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(part[text].view(np.int64)), pa.array(sets.view(np.int64))], ["class", "part", "shingle"])

    return docs.select("doc_id", "text").mapInArrow(run, "class long, part long, shingle long")


def rare_entries(left: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(shingle, class, component, n, most): by which shingles each of left (class, component) may meet a similar set.

    All sets order their shingles alike: the rarer among left's the earlier. Two similar sets then have a common
    one among the first n - percent% n + 1 of either, and the first they have in common, after which a set has
    room shingles left, holds their intersection to that room: its partners have at most `most` shingles. Of a
    group of copies that differ each in its own way the first shingles are their own, so few meet.
    """
    each = scratch.table(shingle_rows(texts.join(left.select(F.col("class").alias("doc_id")).hint("merge"), "doc_id"), size))
    held = scratch.table(each.groupBy("shingle").agg(F.count("*").alias("df")))
    own = F.sort_array(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "shingle"))))
    sets = each.join(held, "shingle").groupBy("class", "part").agg(F.count("*").cast("long").alias("n"), own.alias("_own"))
    alone = F.col("n") - F.size("_own")
    sets = sets.withColumn("_first", alone).withColumn("_take", F.expr(f"n - ({percent} * n + 99) div 100 + 1") - alone).where("_take > 0")
    found = sets.select("class", "n", "_first", F.posexplode(F.expr("slice(_own, 1, cast(_take as int))")).alias("_place", "_one"))
    most = F.expr(f"((100 + {percent}) * (n - _first - _place)) div {percent} - n")
    found = found.select(F.col("_one.shingle").alias("shingle"), "class", "n", most.alias("most"))
    return scratch.table(found.join(left, "class").select("shingle", "class", "component", "n", "most"))


def apart(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components that may be similar, from rare_entries.

    A shingle's entries that no other can match by size are dropped, by one sum. Entries of a shingle's main
    component are met by those of others alone, so a group of copies that is one component but for a few costs
    a few times its size.
    """
    per = entries.groupBy("shingle", "component").agg(F.count("*").alias("k"), F.min("n").alias("lo"))
    per = per.groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.min("lo").alias("lo"), F.count("*").alias("k")).where("k > 1").drop("k")
    near = cut(entries.join(per, "shingle").where("most >= lo"))
    x = near.where("component <> main").select("shingle", F.col("class").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("most").alias("mx"))
    y = near.select("shingle", F.col("class").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("most").alias("my"))
    met = x.join(y, "shingle").where("cx <> cy and ny <= mx and nx <= my")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node's smallest reachable node, by alternating large-star and small-star.

    edges (a, b) of longs. Each star takes a minimum by node (summed map-side) and one join, so a hub's edges
    are never gathered in one place. It ends when a double step changes no edge.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Rows with equal shingle sets are one class, named by its smallest doc_id. Classes that share a band's
    bucket are first compared in stars: each with the bucket's smallest class and with its most central one
    (whose buckets together are the largest, so the original of a group of copies). A group of copies so costs
    about as many comparisons as it has members. Before whole sets are compared, a pair's signatures must agree
    as far as the threshold less five and a half standard deviations.

    What is left is every class that shares a bucket with another one in a different component and wasn't
    compared with it. Any link between two of them in different components is found by the rare shingles that similar sets must share, an exact
    rule on whole sets, so no such link is lost however many members a bucket has. Sets and words are compared by
    64-bit hashes.

    Rows whose text is null or without words have an empty set, link with nothing and are kept. A text with
    fewer words than size is one shingle. Rows that share a doc_id are one node, linked by any of their texts;
    rows without a doc_id link with nothing and are kept. Columns of docs other than doc_id and text are not
    read. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        base = scratch.table(sketches(docs, size, bands * rows))
        sets = base.where("set_key is not null and doc_id is not null")
        classes = scratch.table(sets.groupBy("set_key").agg(F.min("doc_id").alias("class"), F.min_by("signature", "doc_id").alias("signature")))
        exploded = scratch.table(banded(classes, bands, rows))
        sizes = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("first"), F.max("class").alias("_last")).where("first <> _last").drop("_last")
        members = scratch.table(exploded.join(sizes, "bucket"))
        crowded = cut(members.groupBy("class").agg(F.sum("n").alias("weight")))
        ids = crowded.select(F.col("class").alias("doc_id"))
        # The same plan at every size: joins with texts are by sorting.
        found = likely_among(docs.where("doc_id is not null").select("doc_id", "text"), ids, crowded.count())
        texts = scratch.table(found.join(ids.hint("merge"), "doc_id"))
        signed = scratch.table(classes.select("class", "signature").join(crowded.select("class"), "class"))
        hub = members.where("n > 2").join(crowded, "class").groupBy("bucket").agg(F.max_by("class", F.struct("weight", -F.col("class"))).alias("hub"))
        members = scratch.table(members.join(hub, "bucket", "left"))
        hubs = members.where("hub is not null").select(F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b"))
        pairs = cut(hubs.union(members.select(F.col("first").alias("a"), F.col("class").alias("b"))).where("a <> b").distinct())
        links = cut(confirmed(agreeing(pairs, signed, percent, bands * rows), texts, size, percent))
        found = components(links).withColumnRenamed("node", "class")
        # Pairs with a bucket's smallest or central class are settled.
        own = members.where("n > 2 and class <> first and class <> hub").select("bucket", "class").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
        mixed = own.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("bucket")
        left = cut(own.join(mixed, "bucket").select("class", "component").distinct())
        met = cut(apart(rare_entries(left, texts, size, percent, scratch)).join(pairs, ["a", "b"], "left_anti"))
        more = cut(confirmed(agreeing(met, signed, percent, bands * rows), texts, size, percent))
        if more.take(1):
            found = components(links.union(more)).withColumnRenamed("node", "class")
        out = base.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "class"), "set_key", "left").join(found, "class", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id"))
        return cut(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that are not kept: of each component its smallest doc_id stays."""
    kept = near_duplicates(docs, size, percent).where("not kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_anti").select(*docs.columns)
