"""Shared pieces of the corpus operators: durable cuts, distributed running sums, vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Bytes that separate words in every contract: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that go to a Python worker at a time: texts are long, and several batches are in memory at once.
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20


def lean(spark: SparkSession) -> None:
    """Have batches for Python workers no larger than ARROW_ROWS and ARROW_BYTES; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder is used if Spark runs in this machine alone; otherwise a RuntimeError is
    raised, as executors would each write to their own disk.
    """
    lean(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
        if not found:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="lexweave-")
            sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are computed once, written to the shared folder and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that live as long as the with-block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/scratch-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths = []

    def __exit__(self, *_) -> None:
        self.drop()


#: What this worker keeps warm between tasks: one operator's state at a time.
_WARM: dict = {}


def warm(key, make):
    """The worker's state under key, made once; state under other keys is let go."""
    if key not in _WARM:
        cool()
        _WARM[key] = make()
    return _WARM[key]


def cool() -> None:
    """Let go of what other operators left in this worker and give free memory back to the system."""
    _WARM.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hash60(*cols: Column, seed: str = "") -> Column:
    """A uniform 60-bit number from the md5 of the columns' text; any engine with md5 orders rows alike."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


def bucket_bits(rows: int, rows_per_bucket: int = 8192) -> int:
    """log2 of how many equal ranges of a uniform 60-bit hash hold about rows_per_bucket rows each."""
    return max(0, math.ceil(math.log2(max(1, rows) / rows_per_bucket)))


def running_sum(df: DataFrame, by: Sequence[str], hashed: str, ties: Sequence[str], value: Column, out: str, rows: int, rows_per_bucket: int = 8192) -> DataFrame:
    """Add to each row the sum of value over the rows of its group that sort before it by (hashed, ties).

    hashed is uniform over 60 bits, so equal ranges of it are equal buckets of every group: a group with a
    third of all rows is spread over as many tasks as it needs. Within a bucket a window sums; over buckets,
    whose sums are one short row each, another window does.
    """
    bits = bucket_bits(rows, rows_per_bucket)
    df = df.withColumn("_bucket", F.shiftright(F.col(hashed), 60 - bits).cast("int") if bits else F.lit(0)).withColumn("_value", value)
    keys = [*by, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(hashed, *ties).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_offset"))
    inner = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return inner.join(offsets, keys).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_bucket", "_value", "_inside", "_offset")


# Vectorised words -------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
        done, step = 1, np.uint64(base)
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * step
            done, step = done + take, step * step
    return out


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: A fixed random 64-bit number for each byte value.
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or next(iter(_TABLES)) < n:
        size = 1 << max(16, int(n).bit_length())
        _TABLES.clear()
        with np.errstate(over="ignore"):
            _TABLES[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    return next(iter(_TABLES.values()))


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (one more offset at the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


#: Bytes of which words are found and hashed at a time, and texts at a time.
BLOCK, BLOCK_TEXTS = 1 << 19, 512


def text_slices(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about BLOCK bytes of text, or one row."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns:
        size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    i = 0
    while i < batch.num_rows:
        before = int(ends[i - 1]) if i else 0
        j = min(i + BLOCK_TEXTS, max(i + 1, int(np.searchsorted(ends, before + BLOCK, side="right"))))
        yield batch.slice(i, j - i)
        i = j


def _word_blocks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about BLOCK bytes that end where a word can't go on."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + BLOCK
        while hi < n:
            edge = np.flatnonzero(SPACE[data[hi : hi + BLOCK]])
            later = at[np.searchsorted(at, hi) :][:1]
            stop = min([hi + int(e) for e in edge[:1]] + [int(x) for x in later if x < hi + BLOCK], default=None)
            if stop is not None:
                hi = stop
                break
            hi += BLOCK
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's 64-bit hash, first byte, byte after its end, and the offsets of each text's words.

    Words are maximal runs of bytes other than space and \\x09-\\x0D. The hash is a polynomial over the bytes,
    read off prefix sums, then mixed; lower folds A-Z alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    if n > 2 * BLOCK:
        found = []
        for lo, hi in _word_blocks(data, at):
            inner = at[np.searchsorted(at, lo, side="right") : np.searchsorted(at, hi)] - lo
            found.append((lo, *_words(data[lo:hi], np.concatenate([[0], inner, [hi - lo]]), lower)))
        begin = np.concatenate([lo + b for lo, _, b, _ in found])
        return np.concatenate([h for _, h, _, _ in found]), begin, np.concatenate([lo + e for lo, _, _, e in found]), np.searchsorted(begin, at)
    hashed, begin, end = _words(data, at, lower)
    return hashed, begin, end, np.searchsorted(begin, at)


def _words(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words() of a few bytes, without the texts' offsets."""
    n = len(data)
    solid = ~SPACE[data]
    left = np.empty(n, dtype=bool)
    left[0] = True
    left[1:] = ~solid[:-1]
    inner = at[1:-1]
    left[inner[inner < n]] = True
    begin = np.flatnonzero(solid & left)
    right = np.empty(n, dtype=bool)
    right[-1] = True
    right[:-1] = left[1:] | ~solid[1:]
    end = np.flatnonzero(solid & right) + 1
    codes = _BYTE_CODE
    if lower:
        codes = codes.copy()
        codes[65:91] = codes[97:123]
    power, inverse = _tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes[data] * power[:n], out=sums[1:])
        hashed = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _ODD)
    return hashed, begin, end


def gram_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size words, at its first word; runs may cross texts, callers mask those."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashed[:n].copy()
        for i in range(1, size):
            out = out * _ODD + hashed[i : i + n]
        return mix(out)


def shingles(hashed: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of size words, and offsets; fewer words: the whole run as one."""
    grams = gram_hashes(hashed, size)
    count = np.diff(at)
    out, lengths = [], np.zeros(len(count), dtype=np.int64)
    for i, n in enumerate(count.tolist()):
        a = at[i]
        if n >= size:
            own = np.unique(grams[a : a + n - size + 1])
        elif n:
            with np.errstate(over="ignore"):
                one = np.uint64(n)
                for h in hashed[a : a + n]:
                    one = one * _ODD + h
                own = mix(np.array([one], dtype=np.uint64))
        else:
            continue
        out.append(own)
        lengths[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
