"""Document fingerprints from a randomised edit embedding: shared random walks over the characters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from lexweave.llm.common import Scratch, cool, cut, mix

#: Steps after which the shared random bits of the walk repeat.
PERIOD = 1 << 12
#: The first stratum has so many steps, each next one as many as all before it; SAMPLED steps of each are looked at.
STRATUM, STRATA, SAMPLED = 64, 26, 64
#: Bytes of text that one group holds, at about.
GROUP_BYTES = 6 << 20
#: Characters, and texts, that walk together.
BATCH_CHARS, BATCH_DOCS = 2 << 20, 4096
#: Bands of a fingerprint and the sampled bits of each; least likeness of two fingerprints that are linked.
BANDS, BITS, LEAST = 20, 28, 0.9
#: Members of the largest bucket that is compared whole beside others, of a larger one's block, and of a task of small ones.
SMALL, BUCKET_BLOCK, TASK_ROWS = 64, 2048, 20_000

_CLASSES = 256


def _starts() -> np.ndarray:
    """The first step of each stratum, and the step after the last one."""
    return np.concatenate([[0], STRATUM << np.arange(STRATA)]).astype(np.int64)


def _walk_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed random choices that all texts share: (stay, sampled steps, bits).

    The walk stands on a character and at each step, by a shared random bit for (step, class), stays or moves to
    the next one; the embedding repeats the character for every step it stays. stay has, for each class and step,
    how many steps until the walk moves on. The embedding is looked at in the sampled steps alone, and as one random
    bit for each (class, sampled step), so that two embeddings that differ there show it half of the time.
    """
    rng = np.random.Generator(np.random.PCG64(20240229))
    moves = rng.integers(0, 2, (_CLASSES, PERIOD), dtype=np.uint8).astype(bool)
    moves[:, -1] = True
    stay = np.zeros((_CLASSES, 2 * PERIOD), dtype=np.int32)
    twice = np.concatenate([moves, moves], axis=1)
    nxt = np.full(_CLASSES, 0, dtype=np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        nxt = np.where(twice[:, j], 1, nxt + 1)
        stay[:, j] = nxt
    starts = _starts()
    picked = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        # One step of each of SAMPLED equal runs of the stratum.
        run = (hi - lo) // SAMPLED
        picked.append(lo + np.arange(SAMPLED) * run + rng.integers(0, run, SAMPLED))
    bits = rng.integers(0, 2, (_CLASSES, STRATA * SAMPLED), dtype=np.uint8)
    return np.ascontiguousarray(stay[:, :PERIOD]).ravel(), np.concatenate(picked).astype(np.int64), bits.ravel()


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_walk_tables())
    return _TABLES


def classes(text: str) -> np.ndarray:
    """Each code point's class: ASCII has its own, others share 128 by a hash."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = 128 + ((cp * np.uint32(2654435761)) >> np.uint32(25))
    return np.where(cp < 128, cp, high).astype(np.uint8)


def walks(chars: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The step at which the walk comes to each character, for many texts at once.

    chars holds all texts' classes one after the other, at their offsets, begin the step at which each text's
    walk starts. Texts advance in lockstep, a character a turn, longest first, so a turn is a few array
    operations over the texts that still have characters.
    """
    stay = _tables()[0]
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    size, base, step = size[order], at[:-1][order], begin[order].astype(np.int32)
    out = np.empty(len(chars), dtype=np.int32)
    row = chars.astype(np.int32) * np.int32(PERIOD)
    live = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), side="right")
    for i, n in enumerate(live.tolist()):
        place = base[:n] + i
        now = step[:n]
        out[place] = now
        now += stay[row[place] + (now & (PERIOD - 1))]
    return out


def ends(chars: np.ndarray, at: np.ndarray, steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The step after each text's last character."""
    out = begin.astype(np.int64).copy()
    some = np.diff(at) > 0
    last = at[1:][some] - 1
    out[some] = steps[last] + _tables()[0][chars[last].astype(np.int64) * PERIOD + (steps[last] & (PERIOD - 1))]
    return out


@dataclass
class Prints:
    """Fingerprints: where each walk ended and, a 64-bit word a stratum, the bits of the sampled steps it passed."""

    end: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.end)

    def __getitem__(self, i) -> Prints:
        return Prints(self.end[i], self.words[i])


def sample(chars: np.ndarray, at: np.ndarray, steps: np.ndarray, end: np.ndarray) -> Prints:
    """The embeddings' bits at the sampled steps: at a step the walk stands on the last character it came to before."""
    _, picked, bits = _tables()
    n = len(end)
    out = np.zeros((n, STRATA * SAMPLED), dtype=np.uint8)
    seen = np.searchsorted(picked, end)
    total = int(seen.sum())
    if total:
        doc = np.repeat(np.arange(n, dtype=np.int64), seen)
        which = np.arange(total) - np.repeat(np.cumsum(seen) - seen, seen)
        keys = (np.repeat(np.arange(n, dtype=np.int64), np.diff(at)) << np.int64(32)) + steps
        place = np.searchsorted(keys, (doc << np.int64(32)) + picked[which], side="right") - 1
        out[doc, which] = bits[chars[place].astype(np.int64) * (STRATA * SAMPLED) + which]
    return Prints(end.astype(np.int64), np.packbits(out, axis=1, bitorder="little").view("<u8").astype(np.uint64))


def _first_bits() -> np.ndarray:
    """Words with the first k bits set, k = 0 to 64."""
    return np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)


def _passed(end: np.ndarray) -> np.ndarray:
    """How many sampled steps of each stratum lie before a step."""
    seen = np.searchsorted(_tables()[1], end)
    return np.clip(seen[..., None] - SAMPLED * np.arange(STRATA), 0, SAMPLED)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """One less the share of steps at which two embeddings differ, as far as the sampled bits tell.

    In each stratum twice the share of differing bits stands for the steps that both walks made; steps that one
    walk alone made differ. Two empty texts are alike.
    """
    least, most = np.minimum(a.end, b.end), np.maximum(a.end, b.end)
    strata = min(STRATA, max(1, int(np.searchsorted(_starts(), int(least.max()) if len(least) else 0))))
    starts = _starts()
    far = (most - least).astype(float)
    passed = _passed(least)[..., :strata]
    differ = np.bitwise_count((a.words[..., :strata] ^ b.words[..., :strata]) & _first_bits()[passed])
    both = np.clip(least[..., None] - starts[:strata], 0, np.diff(starts)[:strata])
    far += (both * np.minimum(1.0, 2.0 * differ / np.maximum(passed, 1))).sum(axis=-1)
    return np.where(most > 0, 1.0 - far / np.maximum(most, 1), 1.0)


def as_bytes(prints: Prints) -> list[bytes]:
    """The end in four bytes, then a word for each stratum that the walk came to."""
    size = np.searchsorted(_starts()[:-1], prints.end)
    words_ = prints.words.astype("<u8")
    return [e.to_bytes(4, "big") + w[:k].tobytes() for e, w, k in zip(prints.end.tolist(), words_, size.tolist(), strict=True)]


def from_bytes(prints: list[bytes]) -> Prints:
    end = np.array([int.from_bytes(p[:4], "big") for p in prints], dtype=np.int64)
    data = b"".join(p[4:].ljust(8 * STRATA, b"\0") for p in prints)
    return Prints(end, np.frombuffer(data, dtype="<u8").reshape(-1, STRATA).astype(np.uint64))


def fingerprint_texts(texts: list[str]) -> Prints:
    """Fingerprints of texts."""
    return _both(texts, None)[0]


def _offsets(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), at


def _both(texts: list[str], tails: list[tuple[int, str]] | None) -> tuple[Prints, Prints | None]:
    """Fingerprints of texts, and of the texts whose characters from a place on are replaced by another tail.

    The walk of an edited text is the text's own up to the edit, so only tails are walked again.
    """
    n = len(texts)
    own = [classes(t) for t in texts]
    chars, at = _offsets(own)
    zero = np.zeros(n, dtype=np.int64)
    steps = walks(chars, at, zero)
    prints = sample(chars, at, steps, ends(chars, at, steps, zero))
    if tails is None:
        return prints, None
    heads = np.array([k for k, _ in tails], dtype=np.int64)
    tail, tail_at = _offsets([classes(t) for _, t in tails])
    keep = (np.arange(len(chars)) - np.repeat(at[:-1], np.diff(at))) < np.repeat(heads, np.diff(at))
    head, head_at = chars[keep], np.concatenate([[0], np.cumsum(heads)])
    head_steps = steps[keep]
    turn = ends(head, head_at, head_steps, zero)
    tail_steps = walks(tail, tail_at, turn)
    size = np.diff(head_at) + np.diff(tail_at)
    all_at = np.concatenate([[0], np.cumsum(size)])
    chars2, steps2 = np.empty(all_at[-1], np.uint8), np.empty(all_at[-1], np.int32)
    to_head = np.arange(len(head)) + np.repeat(all_at[:-1] - head_at[:-1], np.diff(head_at))
    to_tail = np.arange(len(tail)) + np.repeat(all_at[:-1] + np.diff(head_at) - tail_at[:-1], np.diff(tail_at))
    chars2[to_head], steps2[to_head] = head, head_steps
    chars2[to_tail], steps2[to_tail] = tail, tail_steps
    return prints, sample(chars2, all_at, steps2, ends(tail, tail_at, tail_steps, turn))


def _edited(text: str, following: str) -> tuple[int, str]:
    """Where text is cut and what follows the cut: its last half is replaced by as much of the next text's head."""
    half = len(text) // 2
    return len(text) - half, following[:half]


ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.binary()) for c in ("sha", "own", "edited")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
PACKED = "doc_id long, n_chars long, sha binary, own binary, edited binary, near_edited double, near_next double"
#: What fingerprints() returns.
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], following: list[str]) -> pa.Table:
    """Result rows for texts and the next document's texts; both lists walk together in batches."""
    tails = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
    prints, edited = _both(texts, tails)
    if following[:-1] == texts[1:]:
        last = fingerprint_texts(following[-1:])
        nxt = Prints(np.concatenate([prints.end[1:], last.end]), np.concatenate([prints.words[1:], last.words]))
    else:
        nxt = fingerprint_texts(following)
    sha = [hashlib.sha256((t[:k] + x).encode("utf-8", "surrogatepass")).digest() for t, (k, x) in zip(texts, tails, strict=True)]
    return pa.table([ids, [len(t) for t in texts], sha, as_bytes(prints), as_bytes(edited), likeness(prints, edited), likeness(prints, nxt)], schema=ARROW)


def _legible(packed: DataFrame) -> list[Column]:
    """The contract's columns from the packed ones."""
    return ["doc_id", "n_chars", *(F.lower(F.hex(c)).alias(n) for c, n in (("sha", "edited_sha256"), ("own", "fingerprint"), ("edited", "edited_fingerprint"))), "near_edited", "near_next"]


def fingerprints(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Each document's fingerprint and that of its edited text (its last half replaced by the next one's head).

    near_edited and near_next are one less the share of steps at which the embeddings differ, as the bits sampled
    from them tell. Null texts are empty; two empty texts are alike, an empty and another one are not. Rows that
    share a doc_id follow each other by a hash of their text; rows without a doc_id come first. An only document
    is its own next one. An empty table gives no rows.
    """
    packed = _packed(docs, group_bytes)
    return packed.select(*_legible(packed))


def _packed(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """fingerprints(docs), packed in bytes.

    Documents are dealt to groups by ranges of (doc_id, hash of the text) of about group_bytes of text; the first
    document of a range also goes to the range before (the very first to the last), so each group has every next
    document it needs, and the texts, compressed, are shuffled once. Tasks know the ranges' borders, 24 bytes for
    group_bytes of text.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key")
    narrow = cut(docs.select(key, F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("tie")))
    total, rows = narrow.agg(F.sum("bytes"), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], PACKED)
    n = max(1, math.ceil(total / group_bytes))
    # A row counts once and once more for each average text it is long: at most twice as many rows.
    weighed = narrow.select("key", F.explode(F.array_repeat(F.lit(0), (1 + F.floor(F.col("bytes") / F.lit(max(1.0, total / rows)))).cast("int"))))
    points = weighed.select(F.percentile_approx("key", [i / n for i in range(1, n)], max(10000, 20 * n)).alias("p")).first()[0] if n > 1 else []
    split = spark.sparkContext.broadcast(np.sort(np.array(points or [], dtype=np.int64)))

    def group_of(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """A range for each; an id that several borders name is dealt to as many ranges by its texts' hashes."""
        lo, hi = np.searchsorted(split.value, keys, "left"), np.searchsorted(split.value, keys, "right")
        many = np.maximum(hi - lo, 1)
        part = np.floor((ties.astype(np.float64) / 2.0**64 + 0.5) * many).astype(np.int64)
        return np.where(hi - lo > 1, lo + 1 + np.clip(part, 0, many - 1), hi)

    @F.pandas_udf("long")
    def group(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(group_of(keys.to_numpy(), ties.to_numpy()))

    first = narrow.withColumn("group", group("key", "tie")).groupBy("group").agg(F.min(F.struct("key", "tie")).alias("f")).select("group", "f.key", "f.tie").orderBy("group").toArrow()
    own, first_key, first_tie = (first.column(c).to_numpy() for c in ("group", "key", "tie"))
    heads = spark.sparkContext.broadcast((own, first_key, first_tie, np.concatenate([own[-1:], own[:-1]])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        press = zstandard.ZstdCompressor(level=1).compress
        names, least_key, least_tie, before = heads.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                keys, ties = b.column(1).to_numpy(), b.column(3).to_numpy()
                to = group_of(keys, ties)
                at = np.searchsorted(names, to)
                halo = np.flatnonzero((least_key[at] == keys) & (least_tie[at] == ties))
                rows_ = pa.array(np.concatenate([np.arange(len(to)), halo]))
                pressed = pa.array([press(t) for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())
                flag = np.arange(len(rows_)) >= len(to)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([to, before[at[halo]]])), *(c.take(rows_) for c in (b.column(0), pressed, b.column(3))), pa.array(flag)], ["group", "doc_id", "text", "tie", "halo"])

    dealt = docs.select("doc_id", key, text.alias("text"), F.xxhash64(text).alias("tie")).mapInArrow(deal, "group long, doc_id long, text binary, tie long, halo boolean")

    def run(table: pa.Table) -> pa.Table:
        halo, ids, ties = (table.column(c).to_pylist() for c in ("halo", "doc_id", "tie"))
        order = sorted(range(table.num_rows), key=lambda i: (halo[i], ids[i] is not None, ids[i] or 0, ties[i]))
        order = order[: len(order) - max(0, sum(halo) - 1)]  # equal rows may each have come as the next range's first
        pressed, size_of = table.column("text").combine_chunks(), zstandard.ZstdDecompressor()
        text_of = lambda i: size_of.decompress(pressed[order[i]].as_py()).decode("utf-8", "surrogatepass")
        n_own = len(order) - (1 if any(halo) else 0)
        out, texts, size, start = [], [], 0, 0
        for i in range(n_own + 1):
            texts.append(text_of(i))
            size += len(texts[-1])
            if i and (i == n_own or size > BATCH_CHARS or len(texts) > BATCH_DOCS):
                out.append(_rows([ids[j] for j in order[start:i]], texts[:-1], texts[1:]))
                texts, size, start = texts[-1:], len(texts[-1]), i
        return pa.concat_tables(out) if out else ARROW.empty_table()

    return dealt.groupBy("group").applyInArrow(run, PACKED)


def _band_places() -> list[np.ndarray]:
    """For each level, BANDS rows of sampled steps: level k has the first k + 1 strata, drawn by how many steps stand for."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = []
    for level in range(STRATA):
        weight = np.repeat(np.diff(_starts())[: level + 1], SAMPLED).astype(float)
        out.append(np.stack([rng.choice(len(weight), BITS, replace=False, p=weight / weight.sum()) for _ in range(BANDS)]))
    return out


def band_buckets(prints: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(print, band, bucket): bits sampled from the strata a walk passed whole, and from one fewer if it hardly did.

    Two walks at likeness LEAST end within that ratio of each other, so they share a level. Walks that don't pass the
    first stratum are cut in runs of steps, more than may differ, by their bits and their ends within the run.
    """
    level = np.searchsorted(_starts()[1:], prints.end, side="right") - 1
    bits = np.unpackbits(prints.words.astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    found = []
    places = _band_places()

    def add(rows: np.ndarray, band: int, seed: int, sampled: np.ndarray) -> None:
        packed = np.zeros((len(rows), 8), dtype=np.uint8)
        packed[:, : (sampled.shape[1] + 7) // 8] = np.packbits(sampled, axis=1, bitorder="little")
        with np.errstate(over="ignore"):
            found.append((rows, np.full(len(rows), band, np.int16), mix(packed.view("<u8").ravel().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 64 + band + 1))))

    for k in range(STRATA):
        some = (level == k) | ((level == k + 1) & (prints.end * LEAST <= _starts()[min(k + 2, STRATA)]))
        rows = np.flatnonzero(some)
        for band in range(BANDS if len(rows) else 0):
            add(rows, band, k + 1, bits[rows][:, places[k][band]])
    rows = np.flatnonzero(prints.end * LEAST < STRATUM)
    runs = 1 + math.ceil((1 - LEAST) * STRATUM / LEAST)
    edges = np.linspace(0, STRATUM, runs + 1).astype(int)
    for band in range(runs if len(rows) else 0):
        # A set bit more for each step of the run that the walk made tells its end.
        steps = np.arange(edges[band], edges[band + 1])
        add(rows, BANDS + band, 0, np.concatenate([bits[rows][:, steps], (steps < prints.end[rows][:, None]).astype(np.uint8)], axis=1)[:, :64])
    none = (np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.uint64))
    return tuple(np.concatenate([f[i] for f in found] or [none[i]]) for i in range(3))


def _alike(prints: Prints, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) are alike, and their likeness."""
    like = likeness(prints[i], prints[j])
    at = np.flatnonzero(like >= least)
    return at, like[at]


def _bucket_table(prints: Prints) -> np.ndarray:
    """Each print's buckets in ascending order, a row a print; the rest of a row is filled with distinct numbers."""
    row, _, bucket = band_buckets(prints)
    order = np.lexsort((bucket, row))
    row, bucket = row[order], bucket[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    width = int(place.max()) + 1 if len(place) else 1
    out = np.full((len(prints), width), np.uint64(0))
    out[row, place] = bucket
    return out


def _first_common(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest bucket that each pair of prints shares."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(i), top)
    for c in range(table.shape[1]):
        own = table[i, c]
        shared = (own[:, None] == table[j]).any(axis=1) & (own > 0)
        out = np.where(shared, np.minimum(out, own), out)
    return out


def _links(prints: DataFrame, scratch: Scratch, least: float, count: bool) -> tuple[DataFrame, DataFrame]:
    """Classes (id, class, bits) of equal packed fingerprints (doc_id, own), and what is alike among them: pairs (a, b,
    likeness) of ids or, if count, (id, links) a task.

    Classes that agree in a band's sampled bits are compared. Small buckets are compared in full, many a task; larger
    ones block against block. A pair counts in the smallest bucket that it shares, so counts can be summed.
    """
    cls = scratch.table(prints.select(F.xxhash64("own").alias("id"), "doc_id", "own").groupBy("id").agg(F.min("doc_id").alias("class"), F.first("own").alias("bits")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                row, band, bucket = band_buckets(from_bytes(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(bucket.view(np.int64))], ["id", "bucket"])

    each = scratch.table(cls.select("id", "bits").mapInArrow(run, "id long, bucket long"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.table(each.join(sizes, "bucket"))
    parts = max(1, math.ceil(members.count() / TASK_ROWS))
    k = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    small = members.where(F.col("n") <= SMALL).select("id", "bucket", F.pmod("bucket", F.lit(parts)).alias("group"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(0).alias("mine"))
    large = members.where(F.col("n") > SMALL).withColumn("k", k).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    large = large.select("id", "bucket", F.col("bucket").alias("group"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")
    dealt = small.union(large).join(cls.select("id", "bits"), "id")

    def compare(table: pa.Table) -> pa.Table:
        ids, bucket, lo, hi, mine = (table.column(c).to_numpy() for c in ("id", "bucket", "lo", "hi", "mine"))
        p = from_bytes(table.column("bits").to_pylist())
        buckets = _bucket_table(p)
        links, found = np.zeros(len(ids), dtype=np.int64), []

        def hold(i, j):
            at, like = _alike(p, i, j, least)
            i, j = i[at], j[at]
            own = _first_common(buckets, i, j).view(np.int64) == bucket[i]
            i, j = i[own], j[own]
            if count:
                np.add.at(links, i, 1)
                np.add.at(links, j, 1)
            else:
                found.append((ids[i], ids[j], like[own]))

        if lo[0] < 0:
            order = np.argsort(bucket, kind="stable")
            for d in range(1, SMALL):
                same = np.flatnonzero(bucket[order[d:]] == bucket[order[:-d]]) if d < len(order) else np.zeros(0, np.int64)
                if not len(same):
                    break
                for at in range(0, len(same), 16384):
                    hold(order[same[at : at + 16384]], order[same[at : at + 16384] + d])
        else:
            x, y = np.flatnonzero(mine == lo[0]), np.flatnonzero(mine == hi[0])
            for i in x.tolist():
                other = y[y > i] if lo[0] == hi[0] else y
                # Walks that end too far apart can't be alike.
                other = other[(p.end[other] * least <= p.end[i]) & (p.end[i] * least <= p.end[other])]
                for at in range(0, len(other), 16384):
                    hold(np.full(len(other[at : at + 16384]), i), other[at : at + 16384])
        if count:
            return pa.table({"id": ids[links > 0], "links": links[links > 0]})
        a, b, like = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
        return pa.table({"a": a, "b": b, "likeness": like})

    schema = "id long, links long" if count else "a long, b long, likeness double"
    return cls, dealt.groupBy("group", "lo", "hi").applyInArrow(compare, schema)


def near_pairs(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Documents alike by fingerprint, as (class_a, class_b, likeness), classes being the smallest doc_id of equal ones.

    Pairs of classes that share a band and whose likeness is least or more; rows without a doc_id are left out.
    """
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.table(_packed(docs)).where("doc_id is not null")
        cls, pairs = _links(prints, scratch, least, False)
        a, b = (cls.select(F.col("id").alias(i), F.col("class").alias(f"c{i}")) for i in "ab")
        return cut(pairs.join(a, "a").join(b, "b").select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"), "likeness"))


def linked_fingerprints(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """fingerprints(docs) with class_id, the smallest doc_id of equal fingerprints, and links, how many other classes are alike.

    Classes are compared where they share a band. class_id is null where no document of the class has a doc_id. An
    empty text's class has no links.
    """
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.table(_packed(docs))
        cls, parts = _links(prints, scratch, least, True)
        links = parts.groupBy("id").agg(F.sum("links").alias("links"))
        named = cls.select("id", F.col("class").alias("class_id")).join(links, "id", "left")
        found = prints.withColumn("id", F.xxhash64("own")).join(named, "id")
        return cut(found.select(*_legible(prints), "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links")))
