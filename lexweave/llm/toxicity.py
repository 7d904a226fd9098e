"""Toxicity scores of texts restored from leetspeak, spacing and repetition by a noisy channel.

A character language model is counted over all documents. Where a text looks disguised, a lattice of what each
character may stand for is decoded by Viterbi under that model, and the restored text is scored by word stems
whose weights come from labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.common import arrow_bytes, cool, lean, mix, text_slices, _tables
from lexweave.llm.quality import held_out, labelled

#: Labelled rows that the word weights are learned from: the documented bound.
SAMPLE_ROWS = 6000
#: Symbols of the language model: 0 is any non-letter, 1-26 a-z, 27-58 Latin-1 letters, 59 other letters.
SYMBOLS = 64
#: Weights are kept for words and for their first 4 to 7 bytes.
PREFIXES = (4, 5, 6, 7)
#: Bits of the table that tells most words without weight, and the least log odds that count as weight.
BITS, LEAST = 20, 1.0

# What a disguising character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¥": "y", "¡": "i", "#": "h", "%": "x", "&": "a",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "ι": "i", "κ": "k", "ν": "v", "υ": "u",
}
SEPARATORS = "._-*~'`^/\\"
ANY = "*?"
#: Log costs of the channel: a stand-in, a dropped separator, a letter restored from a mask, a run shortened.
COST_LEET, COST_DROP, COST_MASK, COST_RUN = -0.5, -0.5, -3.0, -0.7

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EDGE = ".,;:?!\"'()[]{}…«»“”‘’"
_SPACED = re.compile(r"(?<![^\W_])[^\W_@$!|+€](?:[ ._\-*~]{1,3}[^\W_]|[ ._\-*~]{1,3}[@$!|+€]){2,}(?![^\W_])")
_TOKEN = re.compile(r"\S+")

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_IS_STAND = np.zeros(256, dtype=bool)
_IS_STAND[[ord(c) for c in "0123456789@$!|+(<#%&*"]] = True
_IS_TAIL = np.zeros(256, dtype=bool)
_IS_TAIL[[ord(c) for c in "0123456789@$|+"]] = True
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[ord(c) for c in "._-*~'`^/\\"]] = True
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[ord(c) for c in " ._-*~"]] = True
_IS_PLAIN = np.zeros(256, dtype=bool)
_IS_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_IS_SINGLE = _IS_PLAIN.copy()
_IS_SINGLE[[ord(c) for c in "@$!|+"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ASCII_SYMBOL = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(_LETTERS):
    _ASCII_SYMBOL[[ord(_c), ord(_c.upper())]] = _i + 1


def symbol(c: str) -> int:
    """A character's symbol in the language model."""
    o = ord(c)
    if o < 128:
        return int(_ASCII_SYMBOL[o])
    if 0xC0 <= o <= 0xFF:
        return 27 + (o & 0x1F)
    return 59 if c.isalpha() else 0


def text_symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the code points of all texts' UTF-8 bytes, and each one's text."""
    start = (data & 0xC0) != 0x80
    out = np.where(data < 128, _ASCII_SYMBOL[data], 59).astype(np.uint8)
    latin = np.flatnonzero(data[:-1] == 0xC3)
    out[latin] = 27 + (data[latin + 1] & 0x1F)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    return out[start], doc[start]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """How often each three symbols follow each other in all documents: tasks count theirs, Spark sums them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                data, at = arrow_bytes(b.column(0).slice(i, 512))
                if len(data) < 3:
                    continue
                s, doc = text_symbols(data, at)
                if len(s) < 3:
                    continue
                code = (s[:-2].astype(np.int32) * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                total += np.bincount(code[doc[:-2] == doc[2:]], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["code", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in rows:  # at most SYMBOLS cubed rows
        out[r["code"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after two others, with shorter contexts mixed in."""
    one = counts.sum((0, 1)) + 1.0
    one = one / one.sum()
    two = counts.sum(0)
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    three = (counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20)
    return np.log(three).astype(np.float32)


class Decoder:
    """Restores disguised tokens; answers are remembered up to a bound."""

    def __init__(self, model: np.ndarray, remember: int = 200_000):
        self.model = model
        self.seen: dict[str, str] = {}
        self.remember = remember

    def viterbi(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest string through a lattice: each place offers strings (some empty) with channel costs."""
        lm = self.model
        beams: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
        for options in lattice:
            nxt: dict[tuple[int, int], tuple[float, object]] = {}
            for (a, b), (score, path) in beams.items():
                for string, cost in options:
                    x, y, total = a, b, score + cost
                    for c in string:
                        z = symbol(c)
                        total += float(lm[x, y, z])
                        x, y = y, z
                    best = nxt.get((x, y))
                    if best is None or total > best[0]:
                        nxt[x, y] = (total, (path, string) if string else path)
            beams = nxt
        end = max(beams.items(), key=lambda kv: (kv[1][0] + float(lm[kv[0][0], kv[0][1], 0]), kv[0]))
        out, path = [], end[1][1]
        while path:
            path, string = path
            out.append(string)
        return "".join(reversed(out))

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """What each run of equal characters of a lower-cased token may stand for."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            n = j - i
            if c.isalpha() and c not in LEET:
                out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, COST_RUN)] if n == 2 else [(c * 2, COST_RUN), (c, COST_RUN)])
            elif c in ANY and 0 < i and j < len(token) and n <= 2:
                out.append([(x * n, COST_MASK) for x in _LETTERS] + [("", COST_DROP)])
            elif c in LEET:
                each = [(x, COST_LEET) for x in LEET[c]]
                out.append(each if n == 1 else [*each, *((x * 2, COST_LEET) for x in LEET[c])])
            else:
                out.append([("", COST_DROP)])
            i = j
        return out

    def token(self, token: str) -> str:
        """A token's restored letters; a token that shows no disguise is returned as it is."""
        found = self.seen.get(token)
        if found is None:
            core = token.strip(_EDGE).lower()
            found = token
            if disguised(core):
                found = self.viterbi(self.lattice(core))
                parts = [p for p in re.split(r"[^\w@$!|+€*]+", core) if p != core]
                for p in parts:
                    found += " " + (self.viterbi(self.lattice(p)) if disguised(p) else p)
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen[token] = found
        return found

    def text(self, text: str) -> str:
        """A whole text with spaced-out words joined and disguised tokens restored."""
        text = _SPACED.sub(lambda m: " " + re.sub(r"[ ._\-*~]", "", m[0]) + " ", text)
        return _TOKEN.sub(lambda m: self.token(m[0]), text)


_DISGUISE = re.compile(r"[0-9@$!|+(<#%&*€£¥¡а-яіѕјα-ω]+[^\W\d_]|[^\W\d_][0-9@$|+€]|([^\W\d_])\1\1|[^\W\d_][._\-*~'`^/\\]+[^\W\d_]")


def disguised(token: str) -> bool:
    """Whether a token has letters beside stand-ins, a run of three or a separator inside."""
    return _DISGUISE.search(token) is not None


def suspects(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts may hold a disguise, from their bytes; texts that don't are scored as they are.

    Of ASCII texts these are the ones that _SPACED or _DISGUISE match; any other text is suspect.
    """
    n = len(data)
    if not n:
        return np.zeros(len(at) - 1, dtype=bool)
    letter, low = _IS_LETTER[data], _LOWER[data]
    hit = data >= 128
    first = np.zeros(n + 1, dtype=bool)  # a pattern must not run into the next text
    first[at] = True
    text = np.cumsum(first[:n])
    joint = ~first[1:n]
    hit[:-1] |= joint & ((_IS_STAND[data[:-1]] & letter[1:]) | (letter[:-1] & _IS_TAIL[data[1:]]))
    same = joint & letter[:-1] & (low[:-1] == low[1:])
    hit[:-2] |= same[:-1] & same[1:]
    # Letters with nothing but separators between them.
    solid = np.flatnonzero(~_IS_SEP[data])
    i, j = solid[:-1], solid[1:]
    hit[i[(j - i > 1) & letter[i] & letter[j] & (text[i] == text[j])]] = True
    # Three single characters with one to three gaps between them.
    solid = np.flatnonzero(~_IS_GAP[data])
    near = (np.diff(solid) > 1) & (np.diff(solid) < 5)
    i, j, k = solid[:-2], solid[1:-1], solid[2:]
    ok = near[:-1] & near[1:] & _IS_PLAIN[data[i]] & _IS_SINGLE[data[j]] & _IS_SINGLE[data[k]] & (text[i] == text[k])
    i, k = i[ok], k[ok]
    apart = (first[i] | ~_IS_PLAIN[data[i - 1]]) & (first[k + 1] | ~_IS_PLAIN[data[np.minimum(k + 1, n - 1)]])
    hit[i[apart]] = True
    places = np.flatnonzero(hit)
    return np.diff(np.searchsorted(places, at)) > 0


def stem_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of each word of all texts (one row a word: whole, then prefixes) and the words' texts.

    Words are runs of letters, lower-cased. A prefix longer than the word is the word.
    """
    n = len(data)
    if not n:
        return np.zeros((0, 1 + len(PREFIXES)), np.uint64), np.zeros(0, np.int32)
    letter = _IS_LETTER[data]
    # A capital letter of Latin-1 is \xc3 and a byte below \xa0; fold it with its small one.
    low = _LOWER[data]
    pairs = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] < 0x9F)) + 1
    low[pairs] += 32
    left = letter.copy()
    left[1:] &= ~letter[:-1]
    inner = at[1:-1][at[1:-1] < n]
    left[inner] = letter[inner]
    begin = np.flatnonzero(left)
    right = letter.copy()
    right[:-1] &= ~letter[1:] | left[1:]
    end = np.flatnonzero(right) + 1
    power, inverse = _tables(n + 1)
    with np.errstate(over="ignore"):
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes[low] * power[:n], out=sums[1:])
        out = np.empty((len(begin), 1 + len(PREFIXES)), dtype=np.uint64)
        for k, size in enumerate((None, *PREFIXES)):
            stop = end if size is None else np.minimum(end, begin + size)
            out[:, k] = mix((sums[stop] - sums[begin]) * inverse[begin] + np.uint64(0 if size is None else 7))
    return out, (np.searchsorted(at, begin, side="right") - 1).astype(np.int32)


@dataclass
class Scorer:
    """Log odds of the stems that speak for label 1, and a curve over a text's strongest word and its strong words."""

    stems: np.ndarray
    odds: np.ndarray
    curve: np.ndarray
    model: np.ndarray
    strong: float = 4.0

    def __post_init__(self):
        self.may = np.zeros(1 << BITS, dtype=bool)
        self.may[(self.stems >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def evidence(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        top, count = np.zeros(n), np.zeros(n)
        word, which = np.nonzero(self.may[(hashes >> np.uint64(64 - BITS)).astype(np.int32)])
        if len(word) and len(self.stems):
            h = hashes[word, which]
            at = np.minimum(np.searchsorted(self.stems, h), len(self.stems) - 1)
            each = np.zeros(len(hashes))
            np.maximum.at(each, word, np.where(self.stems[at] == h, self.odds[at], 0.0))
            np.maximum.at(top, doc, each)
            count = np.bincount(doc[each > self.strong], minlength=n)
        return np.stack([top, np.log1p(count), np.ones(n)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(x @ self.curve), -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Weights of a ridge-penalised logistic curve, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(-(x @ w), -35, 35)))
        g = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(w)), g)
        w -= step
        if abs(step).max() < 1e-7:
            break
    return w


def fit(texts: list[bytes], labels: list[int], model: np.ndarray) -> Scorer:
    """A scorer of label 1 from texts, restored before they are counted.

    The curve is fitted on evidence that the odds of one half of the rows give the other half. Without
    labels every text scores the smoothed share of label 1.
    """
    y = (np.array(labels, dtype=np.int64) > 0).astype(float)
    n, pos = len(y), float(y.sum())
    none = np.zeros(0, np.uint64)
    if not pos or pos == n:
        return Scorer(none, none.astype(float), np.array([0.0, 0.0, np.log((pos + 1) / (n - pos + 1))]), model)
    decoder = Decoder(model)
    rows = [np.unique(stem_hashes(*as_bytes([restore(decoder, t)]))[0]) for t in texts]

    def learn(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stems and odds from how many rows of either class have a stem; one row is no evidence."""
        a, b = max(1.0, y[which].sum()), max(1.0, (1 - y[which]).sum())
        stems, p = np.unique(np.concatenate([none, *(rows[i] for i in which if y[i])]), return_counts=True)
        stems, p = stems[p > 1], p[p > 1]
        q = np.zeros(len(stems))
        for i in which:
            if not y[i] and len(stems):
                at = np.minimum(np.searchsorted(stems, rows[i]), len(stems) - 1)
                q[at[stems[at] == rows[i]]] += 1
        odds = np.log((p + 0.5) / (a + 1)) - np.log((q + 0.5) / (b + 1))
        return stems[odds > LEAST], odds[odds > LEAST]

    x = np.zeros((n, 3))
    half = np.arange(n) % 2 == 0
    for own, rest in ((half, ~half), (~half, half)):
        s = Scorer(*learn(np.flatnonzero(own)), np.zeros(3), model)
        for i in np.flatnonzero(rest):
            x[i] = s.evidence(rows[i].reshape(-1, 1), np.zeros(len(rows[i]), np.int32), 1)[0]
    return Scorer(*learn(np.arange(n)), logistic(x, y), model)


def as_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def restore(decoder: Decoder, text: bytes) -> bytes:
    """A text restored, if its bytes show that it may be disguised."""
    if not suspects(*as_bytes([text]))[0]:
        return text
    return decoder.text(text.decode("utf-8", "replace")).encode("utf-8", "replace")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, from its whole text.

    Null and empty texts have no words and score what no evidence scores. Repeated rows get equal scores; columns
    other than doc_id and text are not read, and an empty table gives no rows.
    """
    lean(docs.sparkSession)
    model = log_model(count_trigrams(docs))
    sample = labelled(docs, labels, "toxic", rows)
    shared = docs.sparkSession.sparkContext.broadcast(fit([t for t, _ in sample], [v for _, v in sample], model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool()
        scorer = shared.value
        decoder = Decoder(scorer.model)
        for whole in batches:
            for b in text_slices(whole, 1):
                data, at = arrow_bytes(b.column(1))
                odd = suspects(data, at)
                if odd.any():
                    raw = data.tobytes()
                    texts = [raw[a:e] for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    data, at = as_bytes([decoder.text(t.decode("utf-8", "replace")).encode("utf-8", "replace") if o else t for t, o in zip(texts, odd, strict=True)])
                x = scorer.evidence(*stem_hashes(data, at), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.score(x))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
