"""Packing token sequences into windows by the online sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import cut
from lexweave.llm.tokens import encoder, text_runs

WINDOW = 2048
#: Documents that one task places.
GROUP = 16384


class SumOfSquares:
    """Windows filled online: a piece goes where the sum of squared counts of partially filled windows ends least.

    counts[h] is twice the number of open windows filled to h; the entry for full windows is fixed at -1, which
    makes one difference of slices the change of the sum for every level at once. Ties go to the fullest window.
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.used = window, 0
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.counts[window] = -1
        self.open: list[list[int]] = [[] for _ in range(window)]

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to window - 1 tokens."""
        counts, w = self.counts, self.window
        now = counts[1 : w - size + 1]
        change = np.where(now > 0, counts[size + 1 :] - now, 1 << 40)
        best = len(change) - 1 - int(change[::-1].argmin())
        level = best + 1
        if change[best] + 2 <= counts[size] + 1:
            sequence = self.open[level].pop()
            counts[level] -= 2
        else:
            sequence, level = self.used, 0
            self.used += 1
        if level + size < w:
            counts[level + size] += 2
            self.open[level + size].append(sequence)
        return sequence, level

    def whole(self) -> int:
        self.used += 1
        return self.used - 1


def tokenised(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, tie, doc_tokens, crcs): each document's length in tokens and the crc32 of its ids in runs of window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte")
        for b in batches:
            crcs, sizes = [], []
            for _, _, texts in text_runs(b.column(1)):
                ids, at = enc.encode(texts)
                for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    sizes.append(e - a)
                    crcs.append([zlib.crc32(ids[k : min(k + window, e)].data) for k in range(a, e, window)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "tie", "doc_tokens", "crcs"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, tie long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, path: str, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Pieces of documents in sequences of at most window tokens: one row a piece.

    A document is its ids and the end id. As many whole windows as it fills stand alone; what is left over is
    placed by the sum-of-squares rule. Documents are dealt by hash to tasks of about group, each with its own
    level array, so windows that stay partially filled are a vanishing share of a group's; sequence ids are
    made gapless from the groups' counts.

    Null and empty texts are one piece, the end id. Repeated rows are documents of their own. A table without
    rows gives none. Columns of docs other than doc_id and text are not read.
    """
    counted = cut(tokenised(docs, path, window))
    rows = counted.count()
    groups = max(1, math.ceil(rows / group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "doc_id", "tie"], ignore_index=True)
        packer, out = SumOfSquares(window), []
        for doc, n, crcs, own in zip(pdf["doc_id"], pdf["doc_tokens"], pdf["crcs"], pdf["_group"], strict=True):
            for k, crc in enumerate(crcs):
                size = min(window, n - k * window)
                seq, offset = (packer.whole(), 0) if size == window else packer.place(size)
                out.append((doc, k * window, size, crc, n, own, seq, offset))
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_group", "_seq", "offset"])

    dealt = counted.withColumn("_h", F.xxhash64(F.lit("pack"), "doc_id", "tie")).withColumn("_group", F.pmod(F.col("_h"), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _group long, _seq long, offset long"
    placed = cut(dealt.groupBy("_group").applyInPandas(place, schema))
    counts = placed.groupBy("_group").agg((F.max("_seq") + 1).alias("_n"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    out = placed.join(offsets, "_group").withColumn("sequence_id", F.col("_first") + F.col("_seq"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_ids(docs: DataFrame, pieces: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The sequences themselves: (sequence_id, ids), from docs and the pieces that pack gave; doc_id must be unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte")
        for b in batches:
            for i, j, texts in text_runs(b.column(1)):
                ids, at = enc.encode(texts)
                rows = [(d, k - a, ids[k : min(k + window, e)].tolist()) for d, a, e in zip(b.column(0)[i:j].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True) for k in range(a, e, window)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "start", "ids"])

    runs = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, ids array<int>")
    joined = pieces.join(runs, (pieces["start"] == runs["start"]) & pieces["doc_id"].eqNullSafe(runs["doc_id"]))
    each = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return each.select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))
