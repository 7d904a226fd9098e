"""Passages that repeat across documents, by a sparse suffix array over content-selected positions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexweave.llm.common import Scratch, arrow_bytes, cool, cut, gram_hashes, mix, text_slices, words

#: A passage has at least so many words.
MIN_WORDS = 50
#: A suffix is retained where the hash of GRAM words is the least of some WINDOW neighbouring ones.
GRAM, WINDOW = 8, 24
#: Entries of the sorted array in one task, and how many neighbours on each side an entry is held against.
ENTRIES, NEIGHBOURS = 60_000, 8


def anchors(hashed: np.ndarray, at: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Positions of the retained suffixes: every run of window grams within a text holds at least one.

    The choice depends on the words around a position alone, so equal passages retain the same suffixes but for
    those near their ends.
    """
    h = gram_hashes(hashed, gram)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    inside = np.zeros(n + 1, dtype=bool)
    starts, ends = at[:-1], np.maximum(at[:-1], at[1:] - gram + 1)
    delta = np.zeros(n + 2, dtype=np.int32)
    some = ends > starts
    np.add.at(delta, starts[some], 1)
    np.add.at(delta, np.minimum(ends[some], n), -1)
    inside = np.cumsum(delta)[:n] > 0
    h = np.where(inside, np.minimum(h, top - np.uint64(1)), top)

    def slide(x: np.ndarray, f, fill) -> np.ndarray:
        """f over each run of window entries, at its first; by doubling."""
        width = 1
        while width * 2 <= window:
            x = f(x, np.concatenate([x[width:], np.full(min(width, len(x)), fill, x.dtype)])[: len(x)])
            width *= 2
        rest = window - width
        return f(x, np.concatenate([x[rest:], np.full(min(rest, len(x)), fill, x.dtype)])[: len(x)]) if rest else x

    # The least of each window that lies in one text; short texts are one window.
    low = slide(h, np.minimum, top)
    full = np.arange(n) + window
    text = np.searchsorted(at, np.arange(n), side="right") - 1
    fits = inside & ((full <= ends[text]) | (np.arange(n) == starts[text]))
    if (some & (ends - starts < window)).any():
        for i in np.flatnonzero(some & (ends - starts < window)).tolist():
            low[starts[i]] = h[starts[i] : ends[i]].min()
    low = np.where(fits, low, np.uint64(0))
    reach = slide(low[::-1], np.maximum, np.uint64(0))[::-1]
    return np.flatnonzero(inside & (h == reach))


def core_words(min_words: int = MIN_WORDS, window: int = WINDOW) -> int:
    """Words from a retained suffix on that lie in the passage for the first suffix of any passage."""
    return min_words - window + 1


def _tie() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")


def _suffixes(docs: DataFrame, core: int) -> DataFrame:
    """(key, doc, tie, pos) of each retained suffix with core words left: the hash of those words, and where it is.

    tie, a hash of the text, tells texts of one doc_id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for whole in batches:
            for b in text_slices(whole, 1):
                hashed, _, _, at = words(*arrow_bytes(b.column(1)))
                where = anchors(hashed, at)
                text = np.searchsorted(at, where, side="right") - 1
                keep = where + core <= at[text + 1]
                where, text = where[keep], text[keep]
                with np.errstate(over="ignore"):
                    key = np.zeros(len(where), dtype=np.uint64)
                    for j in range(core):
                        key = key * np.uint64(0x9E3779B97F4A7C15) + hashed[where + j]
                    key = mix(key)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(text)), b.column(2).take(pa.array(text)), pa.array((where - at[text]).astype(np.int32))], ["key", "doc", "tie", "pos"])

    return docs.where("doc_id is not null").select("doc_id", "text", _tie()).mapInArrow(run, "key long, doc long, tie long, pos int")


def _contexts(docs: DataFrame, core: int, reach: int) -> DataFrame:
    """(key, doc, tie, pos, room, right, left): reach word hashes after the core, and before the suffix, nearest first.

    docs has doc_id, text, tie and the suffixes' keys and positions, and whether a key is hot. Words that a text
    doesn't have are numbers of its own, so they equal nothing. room is how many words the text has after the
    core, up to reach, or -1 where the key is not hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        for whole in batches:
            for b in text_slices(whole, 1):
                hashed, _, _, at = words(*arrow_bytes(b.column(1)))
                lists = b.column(3)
                counts = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                key, pos = flat.field("key").to_numpy(), flat.field("pos").to_numpy().astype(np.int64)
                hot = flat.field("hot").to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(counts)), counts)
                ids = b.column(0).to_numpy()[text]
                short = (hashed >> np.uint64(32)).astype(np.uint32)
                room = np.where(hot, np.minimum(at[text + 1] - at[text] - pos - core, reach), -1).astype(np.int32)
                sides = []
                for step in (np.arange(reach) + core, -1 - np.arange(reach)):
                    place = (at[text] + pos)[:, None] + step
                    there = (place >= at[text][:, None]) & (place < at[text + 1][:, None])
                    with np.errstate(over="ignore"):
                        own = (mix(ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
                    sides.append(np.where(there, short[np.clip(place, 0, max(len(short) - 1, 0))], own).astype(">u4"))
                packed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * reach), len(ids), [None, pa.py_buffer(np.ascontiguousarray(s))]).cast(pa.binary()) for s in sides]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), b.column(2).take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(room), *packed], ["key", "doc", "tie", "pos", "room", "right", "left"])

    return docs.mapInArrow(run, "key long, doc long, tie long, pos int, room int, right binary, left binary")


class _Entries:
    """Sorted entries as arrays."""

    def __init__(self, table: pa.Table, reach: int):
        table = table.combine_chunks()
        self.key, self.doc, self.tie, self.pos, self.room = (table.column(c).to_numpy() for c in ("key", "doc", "tie", "pos", "room"))
        self.side = {}
        for c in ("right", "left"):
            data = b"".join(table.column(c).to_pylist())
            self.side[c] = np.frombuffer(data, dtype=">u4").reshape(-1, reach).astype(np.uint32)

    def common(self, c: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of two lists of entries' contexts."""
        differ = self.side[c][a] != self.side[c][b]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])


def _level(e: _Entries) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The first entry with each entry's key and words to the right, and a function that takes an entry's partners.

    Where a text has a key several times, as in a run of repeated words, its n-th entry is held against the n-th one
    of the partner's text (counted around), so that a whole run is matched at one distance.
    """
    n = len(e.key)
    own = np.arange(n)
    other = np.ones(n, dtype=bool)
    other[1:] = (e.key[1:] != e.key[:-1]) | (e.side["right"][1:] != e.side["right"][:-1]).any(axis=1)
    top = np.maximum.accumulate(np.where(other, own, 0))
    other[1:] |= (e.doc[1:] != e.doc[:-1]) | (e.tie[1:] != e.tie[:-1])
    heads = np.flatnonzero(other)
    run = np.cumsum(other) - 1
    sizes = np.diff(np.append(heads, n))
    nth = own - heads[run]
    return top, lambda partner: heads[run[partner]] + nth % sizes[run[partner]]


def _joined(out: np.ndarray) -> np.ndarray:
    """Spans (doc, tie, start, end, first_doc, first_start), those that overlap or touch at one distance as one."""
    if not len(out):
        return out
    apart = out[:, 5] - out[:, 2]
    out = out[np.lexsort((out[:, 2], apart, out[:, 4], out[:, 1], out[:, 0]))]
    same = np.stack([out[:, 0], out[:, 1], out[:, 4], out[:, 5] - out[:, 2]])
    group = np.concatenate([[0], np.cumsum((same[:, 1:] != same[:, :-1]).any(axis=0))])
    big = out[:, 3].max() + 1
    reach = np.maximum.accumulate(out[:, 3] + group * big) - group * big
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (out[1:, 2] > reach[:-1])]))
    joined = out[first]
    joined[:, 3] = reach[np.append(first[1:], len(out)) - 1]
    return joined


def _matches(e: _Entries, core: int, min_words: int) -> pa.RecordBatch:
    """Spans of sorted entries that an earlier document has too, from neighbours and each side's earliest entry.

    Of hot keys' entries also the windows of min_words around the core that none of these spans holds: rows with
    the window's hash and where the text has it, and without a first document.
    """
    n = len(e.key)
    spare = min_words - core
    settled = np.zeros((n, spare + 1), dtype=bool)  # by how many words of the window lie left of the suffix
    order = np.lexsort((e.pos, e.doc))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    group = np.cumsum(np.concatenate([[0], e.key[1:] != e.key[:-1]]))
    own = np.arange(n)
    partners = []
    for step in range(1, NEIGHBOURS + 1):
        partners += [own - step, own + step]
    big = np.int64(n + 1)
    before = np.minimum.accumulate(rank - group * big) + group * big
    after = np.minimum.accumulate((rank - (group[-1] - group) * big)[::-1])[::-1] + (group[-1] - group) * big
    top, level = _level(e)
    partners += [level(order[before]), level(order[after]), level(top)]
    rows = []
    for p in partners:
        ok = (p >= 0) & (p < n)
        x, y = own[ok], p[ok]
        ok = (e.key[x] == e.key[y]) & (e.doc[y] < e.doc[x])
        x, y = x[ok], y[ok]
        if len(x):
            left, right = e.common("left", x, y), core + e.common("right", x, y)
            ok = left + right >= min_words
            x, y, left, right = x[ok], y[ok], left[ok], right[ok]
            settled[x] |= (np.arange(spare + 1) <= left[:, None]) & (np.arange(spare + 1) >= (min_words - right)[:, None])
            rows.append(np.stack([e.doc[x], e.tie[x], e.pos[x] - left, e.pos[x] + right, e.doc[y], e.pos[y] - left], axis=1))
    out = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 6), np.int64)
    # Of spans alike but for the partner the earliest partner's stays.
    if len(out):
        first = np.concatenate([[True], (out[1:, :4] != out[:-1, :4]).any(axis=1)])
        out = _joined(out[first])
    x, taken, hashed = _open_windows(e, own, settled, spare)
    windows = np.unique(np.stack([hashed.view(np.int64), e.doc[x], e.tie[x], e.pos[x] - taken], axis=1), axis=0)
    heads = np.flatnonzero(np.concatenate([[True], (windows[1:, :3] != windows[:-1, :3]).any(axis=1)]) if len(windows) else np.zeros(0, bool))
    starts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(windows)).astype(np.int32)), pa.array(windows[:, 3].astype(np.int32)))
    n, m = len(out), len(heads)
    columns = [pa.array(np.concatenate([out[:, i].astype(np.int64), windows[heads, 1 + i]])) for i in (0, 1)]
    columns += [pa.concat_arrays([pa.array(out[:, i].astype(np.int64)), pa.nulls(m, pa.int64())]) for i in (2, 3, 4, 5)]
    columns += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(windows[heads, 0])]), pa.concat_arrays([pa.nulls(n, starts.type), starts])]
    return pa.RecordBatch.from_arrays(columns, ["doc", "tie", "start", "end", "first_doc", "first_start", "window", "starts"])


def _open_windows(e: _Entries, own: np.ndarray, settled: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, words left of the suffix, hash) of the windows of hot entries that lie in their text and aren't settled."""
    hot = e.room[own] >= 0
    x, settled = own[hot], settled[hot]
    key = mix(e.key[x].astype(np.int64).view(np.uint64))
    ahead = {}
    with np.errstate(over="ignore"):
        for c in ("left", "right"):
            h = np.zeros((len(x), spare + 1), dtype=np.uint64)
            for j in range(spare):
                h[:, j + 1] = mix(h[:, j] * np.uint64(0x9E3779B97F4A7C15) + e.side[c][x, j] + np.uint64(1))
            ahead[c] = h
        taken = np.arange(spare + 1)
        hashed = mix(key[:, None] + ahead["left"] * np.uint64(0xD6E8FEB86659FD93) + ahead["right"][:, ::-1] * np.uint64(0x9E3779B97F4A7C15) + taken.astype(np.uint64))
    i, a = np.nonzero(~settled & (taken <= e.pos[x][:, None]) & (spare - taken <= e.room[x][:, None]))
    return x[i], a, hashed[i, a]


def _merge(found: list) -> list[tuple[int, int, int, int]]:
    """Passages (start, end, first_doc, first_start) of one text from its spans.

    Spans that overlap or touch are one passage only where they lie in the same earlier document at the same
    distance, so every passage stands there as a whole. Passages inside another one are left out; of equal ones
    the earliest document's stays.
    """
    joined: list[list[int]] = []
    for d, f, s, e in sorted((r["first_doc"], r["first_start"] - r["start"], r["start"], r["end"]) for r in found):
        if joined and joined[-1][2:] == [d, f] and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e, d, f])
    out, reached = [], -1
    for s, e, d, f in sorted(joined, key=lambda x: (x[0], -x[1], x[2], x[3])):
        if e > reached:
            out.append((s, e, d, s + f))
            reached = e
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, first_start_word, text_hash): passages that a document of smaller id has too.

    Positions count words from 0. Suffixes at content-selected positions are keyed by the words that any
    passage has from its first such position on; keys of one document alone are dropped, the others get the
    around, are sorted by key, then words to the right, document and position, and dealt to tasks by
    ranges: of the key, and of all of these but the position where a key is hot, so that a passage in a third of all
    documents is spread like any other. A text that has a key several times (a run of repeated words) is held
    against another one in step, so that the run is one passage. Each entry is compared with its neighbours and with the earliest entry before and after
    it of its key and the match is extended to the left and right. Matches of min_words or more, each within one
    document, count; those that overlap or touch in both documents alike are one passage, so a passage stands
    as a whole in its first document. Passages of a document may overlap where they come from different ones.

    A key of at most NEIGHBOURS + 1 entries is so compared in full. Of any other key, each window of min_words
    around an entry's core that no match holds yet is grouped by its hash, and found in the earliest document
    that has it. Any passage consists of such windows, and the earliest document's own ones are never held by a
    match, so nothing is missed whatever the number of entries of a key. Words are compared by 32 bits of their
    hashes, of which min_words in a row must agree, or by 64-bit hashes of windows.

    Null, empty and short texts have no passages; rows without doc_id take no part; rows that share a doc_id
    are one document, and each of their texts has its passages, told apart by text_hash (xxhash64). Repeats
    inside one document don't count. Columns of docs other than doc_id and text are not read. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    core = core_words(min_words)
    reach = min_words - core + 1
    schema = "doc long, tie long, start long, end long, first_doc long, first_start long, window long, starts array<int>"
    result = "doc_id long, start_word long, n_words long, first_doc_id long, first_start_word long, text_hash long"
    with Scratch(spark) as scratch:
        found = scratch.table(_suffixes(docs, core))
        shared = found.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.count("*") > NEIGHBOURS + 1).alias("hot")).where("lo <> hi").select("key", "hot")
        each = found.join(shared, "key").groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "pos", "hot")).alias("at"))
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _tie()).join(each.withColumnRenamed("doc", "doc_id"), ["doc_id", "tie"]).select("doc_id", "text", "tie", "at")
        entries = scratch.table(_contexts(texts, core, reach))
        n = entries.count()
        if not n:
            return spark.createDataFrame([], result)
        # A key that isn't hot stays in one range.
        inner = [F.when(F.col("room") >= 0, F.col(c)) for c in ("right", "doc")]
        ranged = entries.repartitionByRange(max(1, math.ceil(n / ENTRIES)), "key", *inner).sortWithinPartitions("key", "right", "doc", "tie", "pos")

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                yield _matches(_Entries(pa.Table.from_batches(got), reach), core, min_words)

        matched = scratch.table(ranged.mapInArrow(match, schema))
        left = matched.where("window is not null")
        least = left.groupBy("window").agg(F.min(F.struct("doc", "starts")).alias("_lo"), F.max("doc").alias("_hi")).where("_lo.doc < _hi")
        level = "transform(starts, (s, i) -> struct(cast(s as long) as start, cast(s + {n} as long) as end, _lo.doc as first_doc, cast(_lo.starts[i % size(_lo.starts)] as long) as first_start))"
        more = left.join(least, "window").where("_lo.doc < doc").select("doc", "tie", F.expr(level.format(n=min_words)).alias("found"))
        spans = matched.where("window is null").select("doc", "tie", F.array(F.struct("start", "end", "first_doc", "first_start")).alias("found"))
        spans = spans.union(more).groupBy("doc", "tie").agg(F.flatten(F.collect_list("found")).alias("found"))

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(d, s, e - s, o, f, t) for d, t, found in zip(b["doc"], b["tie"], b["found"], strict=True) for s, e, o, f in _merge(list(found))]
                yield pd.DataFrame(rows, columns=["doc_id", "start_word", "n_words", "first_doc_id", "first_start_word", "text_hash"])

        return cut(spans.mapInPandas(merge, result))


def drop_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the passages' words (of the text that has the passage's text_hash) cut out, with the white space after each cut.

    n_chars, if there, follows the text. A document of which no word is left goes. Others, and rows without
    doc_id, stay as they are.
    """
    cuts = passages.groupBy(F.col("doc_id").alias("__cut_doc"), F.col("text_hash").alias("__cut_tie")).agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("__cut_spans"))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if own is None:
                out.append(text)
                continue
            data = (text or "").encode()
            _, begin, _, _ = words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
            begin = np.append(begin, len(data))
            parts, at = [], 0
            for r in own:
                a, b = min(r["start_word"], len(begin) - 1), min(r["start_word"] + r["n_words"], len(begin) - 1)
                parts.append(data[at : begin[a]])
                at = max(at, int(begin[b]))
            out.append(b"".join([*parts, data[at:]]).decode())
        return pd.Series(out)

    joined = docs.join(cuts, (docs["doc_id"] == cuts["__cut_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == cuts["__cut_tie"]), "left")
    joined = joined.withColumn("text", cut_out("text", "__cut_spans"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__cut_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return joined.where(F.col("__cut_spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
