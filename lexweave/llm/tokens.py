"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once a worker.

Both vocabularies cut a text at white space before anything else, so a text's ids are those of its pieces one
after the other. A worker keeps the ids of the pieces it has met (up to a bound, then it starts anew) and only
asks the library for new ones. Texts for which the cut isn't certain go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexweave.llm.common import warm

#: Id put after each document.
END_ID = 1
#: Bytes of the pieces a worker remembers, by an estimate of PIECE_BYTES a piece (dictionary entry, key, place, count)
#: and the key's and the ids' own.
MAX_BYTES, PIECE_BYTES = 72 << 20, 130

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"([{_LETTERS}]+)([.,;:!?]*)")
#: Pieces of which the vocabularies' own cuts are these; others go to the library.
_SIMPLE = re.compile(rf"[!-~{_LETTERS}]+")
_CUTS = {
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+"),
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+"),
}
#: White space that Python and the library may take differently, as UTF-8.
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xa4]|\xe3\x80\x80|\xef\xbb\xbf")
#: How such a character begins: looking for bytes is much faster than the pattern.
_ODD_STARTS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"\xef")
_CONTROLS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")
#: For the byte-level cut: white space other than one space or one line end between words.
_UNEVEN = (b"\t", b"\r", b"\x0b", b"\x0c", b"  ", b"\n\n", b" \n", b"\n ")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


#: ASCII punctuation but for the apostrophe, with which some pre-tokens begin.
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True


def _apart(texts: pa.BinaryArray) -> pa.StringArray:
    """Texts with ASCII and Latin-1 letters in lower case, and with a space where a mark follows such a letter.

    The word vocabulary lowers texts and cuts there itself, so ids stay the same, and words that differ in case or in
    the marks after them alone are one piece.
    """
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts.view(pa.string())
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    found = _LOWER[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]]
    letter = _SMALL[found]
    lead = np.flatnonzero(found[:-1] == 0xC3) + 1
    tail = found[lead]
    latin = (tail >= 0x80) & (tail < 0xC0) & (tail & 0xDF != 0x97)  # not the signs of multiplication and division
    letter[lead[latin]] = True
    found[lead[latin & (tail < 0x9F)]] += 0x20
    gaps = np.flatnonzero(letter[:-1] & _MARKS[found[1:]]) + 1
    at = at - at[0]
    out = np.insert(found, gaps, 32)
    ends = (at + np.searchsorted(gaps, at)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(out))


class Encoder:
    """Ids of texts. kind `word`: lower-cased words with word ends; kind `byte`: byte-level with leading spaces."""

    def __init__(self, path: str, kind: str, max_bytes: int = MAX_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model, self.kind, self.max_bytes = self.whole.model, kind, max_bytes
        self.letters = dict(enumerate(_byte_letters()))
        self.parts: dict[str, list[int]] = {}
        self.at: dict[bytes, int] = {}
        self.starts, self.lengths, self.met = (np.zeros(0, np.int32) for _ in range(3))
        self.flat, self.used, self.bytes = np.zeros(0, np.uint32), 0, 0
        self.new: list[list[int]] = [[END_ID]]  # ids of pieces not in the arrays yet; the first piece stands for END_ID
        self.at[b" end"] = 0

    def _keep_new(self) -> None:
        """Put new pieces' ids into the arrays."""
        if self.new:
            n, lengths = len(self.at), np.fromiter(map(len, self.new), np.int32, len(self.new))
            ids = np.fromiter((x for own in self.new for x in own), np.uint32, int(lengths.sum()))
            if n > len(self.starts):
                more = np.zeros(max(1 << 12, n - len(self.starts), len(self.starts) // 4), np.int32)
                self.starts, self.lengths, self.met = (np.concatenate([x, more]) for x in (self.starts, self.lengths, self.met))
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(1 << 14, self.used + len(ids) - len(self.flat), len(self.flat) // 4), np.uint32)])
            first = n - len(self.new)
            ends = np.cumsum(lengths)
            self.starts[first:n], self.lengths[first:n], self.met[first:n] = self.used + ends - lengths, lengths, 0
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.new = []

    def _forget(self) -> None:
        """Let go of the pieces met once since the last time; the others' counts are halved."""
        n = len(self.at)
        keep = self.met[:n] > 1
        if keep.sum() * 2 > n:  # too many are met again: the more frequent half stays
            keep = self.met[:n] > np.median(self.met[:n])
        keep[0] = True
        starts, lengths = self.starts[:n][keep], self.lengths[:n][keep]
        ends = np.cumsum(lengths)
        self.used = int(ends[-1])
        self.flat = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(self.used)]
        self.starts, self.lengths, self.met = (ends - lengths).astype(np.int32), lengths, self.met[:n][keep] // 2
        kept = [p for p, k in zip(self.at, keep.tolist(), strict=True) if k]
        self.at = dict(zip(kept, range(len(kept)), strict=True))
        self.bytes = sum(map(len, kept)) + PIECE_BYTES * len(kept) + 4 * self.used

    def _library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _part(self, text: str) -> list[int]:
        """One pre-token's ids, straight from the library's merge model."""
        if len(text) > 2:
            return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]
        found = self.parts.get(text)
        if found is None:
            found = self.parts[text] = [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]
        return found

    def _cut(self, text: str) -> list[int]:
        """The ids of a text's pre-tokens."""
        out: list[int] = []
        for x in _CUTS[self.kind].findall(text):
            out += self._part(x)
        return out

    def _piece(self, piece: bytes) -> list[int]:
        if self.kind == "word":
            if piece.isalpha():  # ASCII letters alone, which stand for themselves
                return [t.id for t in self.model.tokenize(piece.lower().decode("ascii"))]
            text = piece.decode("utf-8", "replace")
            m = _PLAIN.fullmatch(text)
            if not m:
                return self._cut(text.lower()) if _SIMPLE.fullmatch(text) else self._library(text)
            return self._part(m[1].lower()) + (self._part(m[2]) if m[2] else [])
        if piece.isalpha():
            return [t.id for t in self.model.tokenize(self.letters[32] + piece.decode("ascii"))]
        lead, text = " ", piece.decode("utf-8", "replace")
        head: list[int] = []
        if text[:1] in "\r\n":
            head, lead, text = self._part("\n") if text[0] == "\n" else [], "", text[1:]
        m = _PLAIN.fullmatch(text)
        if not m:
            return head + (self._cut(lead + text) if _SIMPLE.fullmatch(text) else self._library(lead + text))
        return head + self._part(lead + m[1]) + (self._part(m[2]) if m[2] else [])

    def _add(self, piece: bytes) -> int:
        ids = self._piece(piece)
        k = self.at[piece] = len(self.at)
        self.new.append(ids)
        self.bytes += PIECE_BYTES + len(piece) + 4 * len(ids)
        return k

    def _certain(self, text: bytes) -> bool:
        """Whether a text may be cut into pieces; else it must go to the library whole."""
        if any(c in text for c in _CONTROLS) or not text.isascii() and any(c in text for c in _ODD_STARTS) and _ODD_SPACE.search(text):
            return False
        return self.kind == "word" or bool(text) and not (text[0] in b" \n" or text[-1] in b" \n" or any(c in text for c in _UNEVEN))

    def _cuts(self, texts: list[bytes]) -> pa.ListArray:
        """The pieces of texts; an empty piece has no ids."""
        if self.kind == "word":
            return pc.ascii_split_whitespace(_apart(pa.array(texts, pa.binary())))
        return pc.split_pattern(pa.array([b"\r" + x.replace(b"\n", b" \n") for x in texts], pa.binary()).view(pa.string()), " ")

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by END_ID, and the offsets of the texts; null is empty."""
        if self.bytes > self.max_bytes:
            self._forget()
        texts = [text or b"" for text in texts]
        certain = np.fromiter(map(self._certain, texts), bool, len(texts))
        pieces = self._cuts([text for text, c in zip(texts, certain.tolist(), strict=True) if c])
        whole = [self._library(text.decode("utf-8", "replace")) for text, c in zip(texts, certain.tolist(), strict=True) if not c]
        # Each distinct piece of these texts is looked up once.
        distinct = pieces.flatten().dictionary_encode()
        keys = distinct.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        own = list(map(self.at.get, keys))
        for j, k in enumerate(own):
            if k is None:
                own[j] = self._add(keys[j])
        counts = np.ones(len(texts), dtype=np.int64)
        counts[certain] = np.diff(pieces.offsets.to_numpy())
        counts += 1
        last = np.cumsum(counts) - 1
        picked = np.zeros(int(counts.sum()), dtype=np.int32)
        found = np.ones(len(picked), dtype=bool)
        found[last] = False
        found[last[~certain] - 1] = False
        picked[found] = np.array(own, dtype=np.int32)[distinct.indices.to_numpy()]
        picked[last[~certain] - 1] = -1 - np.arange(len(whole))
        self._keep_new()
        known = np.maximum(picked, 0)
        flat, starts, lengths = self.flat, self.starts[known], self.lengths[known]
        if whole:
            # Their ids stand after the pieces', for this call.
            sizes = np.array([len(w) for w in whole])
            flat = np.concatenate([flat[: self.used], *(np.array(w, dtype=np.uint32) for w in whole)])
            at = np.flatnonzero(picked < 0)
            lengths[at], starts[at] = sizes, self.used + np.cumsum(sizes) - sizes
        self.met[: len(self.at)] += np.bincount(known, minlength=len(self.at)).astype(np.int32)
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        ids = flat[np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)]
        return ids, np.concatenate([[0], ends[last]]).astype(np.int64)


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary."""
    return warm(("encoder", path, kind), lambda: Encoder(path, kind))


def chunks(texts: list[bytes | None], limit: int = 1 << 20):
    """Runs of texts of about limit bytes."""
    a = size = 0
    for i, x in enumerate(texts):
        size += len(x or b"") + 16
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def text_runs(column: pa.Array, rows: int = 512):
    """(first row, row after the last, texts) of runs of a column of texts, as bytes; few texts are held at a time."""
    column = column.cast(pa.binary())
    for k in range(0, len(column), rows):
        texts = column.slice(k, rows).to_pylist()
        for i, j in chunks(texts):
            yield k + i, k + j, texts[i:j]
