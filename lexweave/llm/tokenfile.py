"""Token files: one id array over all documents of a file, with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import cut, shared_dir
from lexweave.llm.tokens import encoder, text_runs

MAGIC = b"LWTOKEN1"
#: A set bit in so many has its place noted, so that a select reads a short run of the upper bits.
SAMPLE = 256
#: Bytes of text that one file is meant to hold.
FILE_BYTES = 16 << 20


@dataclass
class EliasFano:
    """A non-decreasing run of integers in about 2 + log2(universe / count) bits each.

    The low bits stand packed in fixed width; the high parts are unary in a bit array, where the i-th set bit is
    at (value >> width) + i. select(i) finds it from the nearest noted set bit.
    """

    count: int
    width: int
    low: np.ndarray
    high: np.ndarray
    marks: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint64))

    def dump(self) -> bytes:
        # The marks follow from the high bits and cost 64 bits a SAMPLE values; they are stored to open a file without a scan.
        head = struct.pack("<QBQQQ", self.count, self.width, len(self.low), len(self.high), len(self.marks))
        return head + self.low.tobytes() + self.high.tobytes() + self.marks.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        count, width, a, b, c = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(count, width, low, high, np.frombuffer(data, "<u8", c, at + a + b)), at + a + b + 8 * c

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        start, left = int(self.marks[i // SAMPLE]), i % SAMPLE
        byte, skip = start // 8, start % 8
        size = 64
        while True:
            found = np.flatnonzero(np.unpackbits(self.high[byte : byte + size], bitorder="little")[skip:])
            if len(found) > left:
                break
            if byte + size >= len(self.high):
                raise ValueError("a mark of the select structure doesn't match its bits")
            size *= 2
        high = start + int(found[left]) - i
        low = 0
        if self.width:
            bit = i * self.width
            run = np.unpackbits(self.low[bit // 8 : (bit + self.width + 7) // 8], bitorder="little")[bit % 8 : bit % 8 + self.width]
            low = int((run.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum())
        return (high << self.width) | low

    def values(self) -> np.ndarray:
        """All values."""
        n, w = self.count, self.width
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:n] - np.arange(n)
        out = high.astype(np.uint64) << np.uint64(w)
        if w and n:
            bits = np.unpackbits(self.low, count=n * w, bitorder="little").reshape(n, w).astype(np.uint64)
            out |= (bits << np.arange(w, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)


def dump_file(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A file's bytes: header, document ids, boundaries, then ids in 2 bytes (4 if one needs more).

    doc_ids ascend with nulls first; they too are Elias-Fano encoded, as distances from the smallest.
    """
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    head = MAGIC + struct.pack("<BQQqQ", 4 if wide else 2, len(doc_ids), len(doc_ids) - len(known), base, len(ids))
    return head + EliasFano.encode((known - base).astype(np.uint64)).dump() + EliasFano.encode(ends.astype(np.uint64)).dump() + ids.astype("<u4" if wide else "<u2").tobytes()


class TokenFile:
    """A token file in memory; documents are reached by position through the boundaries' select."""

    def __init__(self, content: bytes):
        data = memoryview(content)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.id_bytes, self.count, self.nulls, self.base, self.tokens = struct.unpack_from("<BQQqQ", data, 8)
        self.docs, at = EliasFano.load(data, 8 + struct.calcsize("<BQQqQ"))
        self.ends, at = EliasFano.load(data, at)
        self.ids = np.frombuffer(data, "<u4" if self.id_bytes == 4 else "<u2", self.tokens, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.docs.values() + self.base).tolist()

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def boundaries(f: TokenFile) -> np.ndarray:
    """Where each document of a file ends, by select; ValueError if that differs from decoding all at once."""
    ends = np.array([f.ends.select(i) for i in range(f.count)], dtype=np.int64)
    if not np.array_equal(ends, f.ends.values()):
        raise ValueError("a token file's select structure doesn't match its boundaries")
    return ends


def _write(folder: str, name: str, content: bytes) -> None:
    """Put a file under its final name in one step, so that a repeated or lost task leaves a whole file or none."""
    fs, base = pafs.FileSystem.from_uri(folder)
    part = f"{base}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, f"{base}/{name}")


def write_tokens(docs: DataFrame, folder: str, path: str, kind: str = "word", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs (doc_id, text) as token files in ascending doc_id order and return the manifest.

    Rows are dealt to files by range of doc_id (null first, equal ids by text), one file a task, which streams
    its texts and holds only the file's ids. Null texts are empty: a document of the end id alone. The manifest
    has (file, name, n_docs, n_tokens, first_token), one row a file.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        docs_, parts, ends, used = [], [], [], 0
        for b in batches:
            docs_ += b.column(0).to_pylist()
            for _, _, texts in text_runs(b.column(1)):
                ids, at = enc.encode(texts)
                parts.append(ids.astype(np.uint16) if len(ids) and ids.max() <= 0xFFFF else ids)
                ends.append(at[1:] + used)
                used += len(ids)
        if docs_:
            number = TaskContext.get().partitionId()
            name = f"tokens-{number:08d}.lwt"
            _write(folder, name, dump_file(docs_, np.concatenate(parts), np.concatenate(ends)))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([name]), pa.array([len(docs_)], pa.int64()), pa.array([used], pa.int64())], ["file", "name", "n_docs", "n_tokens"])

    dealt = docs.select("doc_id", "text").repartitionByRange(int(files), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    manifest = cut(dealt.mapInArrow(run, "file long, name string, n_docs long, n_tokens long"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                f = TokenFile(content.as_buffer())
                ends = boundaries(f)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(f.ids[a:e].astype("<u4").data) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * f.count), pa.array(f.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], ["name", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.lwt").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = found.mapInArrow(run, "name string, doc_id long, local long, n_tokens long, ids_crc32 long")
    joined = rows.join(manifest.select("name", "first_token"), "name")
    return joined.select("doc_id", (F.col("first_token") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, kind: str = "word") -> DataFrame:
    """Write the files into the shared folder, read them back, and remove them."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_tokens(docs, folder, path, kind)
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    out = cut(read_tokens(spark, folder, manifest))
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.delete_dir(base)
    return out
