"""Token operators: exact round trips against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lexweave.llm.packing import SumOfSquares, pack, packed_ids
from lexweave.llm.tokenfile import EliasFano, TokenFile, dump_file, read_tokens, round_trip, write_tokens
from lexweave.llm.tokens import END_ID, Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ENCODERS = {"byte": Encoder(BYTE, "byte", 50), "word": Encoder(WORD, "word", 50)}


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab C\n\t.,'ßéÀ12　\xa0\x1cć\r!|$Zıİ漢😀<>endoftext", max_size=40), max_size=6))
def test_encoder_is_the_library(texts):
    for kind, path in (("byte", BYTE), ("word", WORD)):
        ids, at = ENCODERS[kind].encode([t.encode() for t in texts])
        whole = library(path)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids + [1]


@given(st.lists(st.integers(0, 10_000), max_size=600))
def test_elias_fano(values):
    v = np.sort(np.array(values, dtype=np.uint64))
    e, _ = EliasFano.load(memoryview(EliasFano.encode(v).dump()), 0)
    assert e.values().tolist() == v.tolist()
    assert [e.select(i) for i in range(0, len(v), 37)] == v[::37].tolist()
    with pytest.raises(IndexError):
        e.select(len(v))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(EliasFano.encode(ends).dump()) * 8 / len(ends) < 2 + np.log2(1000) + 1.5


def test_token_file_reaches_documents():
    ids = np.arange(100, dtype=np.uint32)
    f = TokenFile(dump_file([None, -5, 7], ids, np.array([10, 10, 100])))
    assert f.doc_ids() == [None, -5, 7] and f.document(0).tolist() == list(range(10)) and f.document(1).tolist() == [] and len(f.document(2)) == 90
    assert f.id_bytes == 2 and TokenFile(dump_file([1], ids + 70_000, np.array([100]))).id_bytes == 4


def brute_ids(path, rows):
    t = library(path)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4") for x in rows]


def test_round_trip(spark, odd):
    got = sorted((tuple(r) for r in round_trip(odd, WORD).collect()), key=lambda r: r[1])
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for g, r, ids in zip(got, rows, brute_ids(WORD, [r.text for r in rows]), strict=True):
        assert g == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_broken_marks_show(spark, docs, tmp_path):
    manifest = write_tokens(docs, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"))
    assert read_tokens(spark, f"file://{tmp_path}/t", manifest).count() == docs.count()
    (path,) = (tmp_path / "t").glob("tokens-*.lwt")
    content = bytearray(path.read_bytes())
    f = TokenFile(bytes(content))
    content[len(content) - f.ids.nbytes - f.ends.marks.nbytes] ^= 64
    path.write_bytes(bytes(content))
    with pytest.raises(Exception, match="select structure|IndexError|ValueError"):
        read_tokens(spark, f"file://{tmp_path}/t", manifest).count()


def test_round_trip_of_nothing(none):
    assert round_trip(none, WORD).collect() == []


def test_many_files_ascend(spark, docs, tmp_path):
    m = write_tokens(docs, str(tmp_path / "t"), WORD, file_bytes=20_000).collect()
    assert len(m) > 3 and sum(r.n_docs for r in m) == docs.count()
    last = None
    for r in sorted(m, key=lambda r: r.file):
        ids = TokenFile((tmp_path / "t" / r["name"]).read_bytes()).doc_ids()
        assert ids == sorted(ids) and (last is None or last < ids[0])
        last = ids[-1]


def check_pack(rows, pieces, window):
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc, ids in rows:
        own = sorted(by_doc[doc], key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= window
    assert sorted(seqs) == list(range(len(seqs)))


def test_pack(spark, docs, corpus):
    pieces = pack(docs, BYTE, window=256, group=40)
    rows = [(i, ids) for (i, _), ids in zip(corpus, brute_ids(BYTE, [t for _, t in corpus]), strict=True)]
    check_pack(rows, pieces.collect(), 256)
    ids = {r.sequence_id: r.ids for r in packed_ids(docs, pieces, BYTE, 256).collect()}
    for p in pieces.collect():
        assert zlib.crc32(np.array(ids[p.sequence_id][p.offset : p.offset + p.length], dtype="<u4").tobytes()) == p.ids_crc32


def test_pack_odd_tables(odd, none):
    pieces = pack(odd, BYTE).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in odd.select("doc_id").collect()}
    assert all(p.doc_tokens == 1 for p in pieces if p.doc_id in (1000, 1001))
    assert pack(none, BYTE).collect() == []


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(1)
    w = 32
    p, levels = SumOfSquares(w), {}
    for _ in range(300):
        size = int(rng.integers(1, w))
        counts = np.bincount([h for h in levels.values() if h < w], minlength=w + 1)[1:w]
        best = []
        for h in {0, *levels.values()}:
            if h + size <= w:
                c = counts.copy()
                if h:
                    c[h - 1] -= 1
                if h + size < w:
                    c[h + size - 1] += 1
                best.append((int((c**2).sum()), h))
        seq, offset = p.place(size)
        assert levels.get(seq, 0) == offset
        assert dict((h, s) for s, h in best)[offset] == min(best)[0]
        levels[seq] = offset + size


def test_words_that_differ_in_case_or_marks_are_one_piece():
    enc = Encoder(WORD, "word")
    texts = ["Straße straße, STRAßE! (straße) straße.,;", "Écouté écoutÉ; ÉCOUTÉ", "× ÷, À×, don't I'LL o'clock' é, É́. Ü!?", "a.b,c <|endoftext|>", ""]
    ids, at = enc.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*enc.whole.encode(t, add_special_tokens=False).ids, END_ID]
    assert sum("straße".encode() in x.lower() for x in enc.at) == 2 and sum("cout".encode() in x for x in enc.at) == 1  # the other has a parenthesis before it
