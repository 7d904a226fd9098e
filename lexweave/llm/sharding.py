"""Sharding indivisible groups by Karmarkar-Karp differencing of partial partitions."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.common import cut, hash60, running_sum

SHARDS = 16
#: Items that one task differences at a time.
FAN_IN = 4096


def difference(sums: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions (each a list of k sums) to one by Karmarkar-Karp differencing.

    The two with the largest spread are combined again and again, the largest part of one with the smallest of
    the other. Returns the k sums, largest first, and for each input the part of the result that each of its
    parts went to. Links between combined partitions form a tree that is walked once at the end.
    """
    k = len(sums[0])
    heap, children = [], []
    for i, s in enumerate(sums):
        order = sorted(range(k), key=lambda j: -s[j])
        own = [s[j] for j in order]
        heap.append((own[-1] - own[0], i, own))
        children.append(("leaf", i, order))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        joined = [left[j] + right[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: -joined[j])
        own = [joined[j] for j in order]
        children.append(("pair", (a, b), order))
        heapq.heappush(heap, (own[-1] - own[0], len(children) - 1, own))
    _, root, total = heap[0]
    places: list[list[int]] = [[0] * k for _ in sums]
    todo = [(root, list(range(k)))]
    while todo:
        node, at = todo.pop()
        kind, what, order = children[node]
        to = [0] * k
        for rank, j in enumerate(order):
            to[j] = at[rank]
        if kind == "leaf":
            places[what] = to
        else:
            todo.append((what[0], to))
            todo.append((what[1], [to[k - 1 - j] for j in range(k)]))
    return total, places


def _level(pdf: pd.DataFrame, k: int) -> tuple[list[int], list[list[int]]]:
    return difference([[int(x) for x in s] for s in pdf["sums"]])


def assign_groups(groups: DataFrame, k: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """The shard of each group of (group, bytes) by differencing in a tree of tasks.

    Groups are dealt by hash to tasks of about fan_in; each makes one partial partition of k parts. Those are
    combined alike, fan_in at a time, until one is left: no task or driver ever holds more than a few times
    fan_in items however many groups there are. A group of any size is one item, so a giant one only widens the
    spread of its partial partition, which later combinations work against.
    """
    n = groups.count()
    groups = groups.withColumn("_node", F.pmod(F.xxhash64("group"), F.lit(max(1, math.ceil(n / fan_in)))))
    empty = F.array(*[F.lit(0).cast("long")] * (k - 1))
    items = groups.select("_node", F.col("group").alias("_item"), F.concat(F.array(F.col("bytes").cast("long")), empty).alias("sums"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_item", ignore_index=True)
        total, places = _level(pdf, k)
        out = pd.DataFrame({"_node": pdf["_node"], "_item": pdf["_item"], "places": places})
        out["sums"] = [total if i == 0 else None for i in range(len(out))]
        return out

    levels = []
    while True:
        kind = items.schema["_item"].dataType.simpleString()
        done = cut(items.groupBy("_node").applyInPandas(step, f"_node long, _item {kind}, places array<int>, sums array<long>"))
        levels.append(done.select("_node", "_item", "places"))
        heads = done.where("sums is not null").select(F.col("_node").alias("_item"), "sums")
        count = heads.count()
        if count <= 1:
            break
        items = heads.withColumn("_node", F.pmod(F.xxhash64("_item", F.lit(len(levels))), F.lit(max(1, math.ceil(count / fan_in)) if count > fan_in else 1)).cast("long"))
    top = levels[-1].select(F.col("_item").alias("_to"), F.col("places").alias("_map"))
    if len(levels) == 1:
        return top.select(F.col("_to").alias("group"), F.element_at("_map", 1).alias("shard"))
    for below in reversed(levels[:-1]):
        joined = below.join(top, below["_node"] == top["_to"])
        top = joined.select(F.col("_item").alias("_to"), F.transform("places", lambda p: F.get("_map", p)).alias("_map"))
    return top.select(F.col("_to").alias("group"), F.element_at("_map", 1).alias("shard"))


def shard(docs: DataFrame, k: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """Deal documents to k shards of near equal bytes, rows with equal texts together (law `bytes`).

    Size is the text's UTF-8 bytes plus 1. Null texts are one group of size 1 a row, apart from empty texts;
    their text_crc32 is null. slot numbers a shard's rows without gaps by the md5 of doc_id, so it is the same
    on every run. A group above a k-th of all bytes makes its shard that large; the others stay equal. Rows
    that share a doc_id are ordered by text; equal rows get neighbouring slots. Columns named like the result's
    are not read. An empty table gives no rows.
    """
    text = F.col("text")
    base = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text)).alias("group"),
            hash60(F.col("doc_id"), seed="slot").alias("_h"),
        )
    )
    rows = base.count()
    found = assign_groups(base.groupBy("group").agg(F.sum("size").alias("bytes")), k, fan_in) if rows else base.select("group", F.lit(0).alias("shard"))
    placed = base.join(found, "group")
    numbered = running_sum(placed, ["shard"], "_h", ["doc_id", "group"], F.lit(1), "slot", rows)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
