"""Strict readers of the source formats. Each gives the lexicon schema and fails with label:line on bad input."""

from __future__ import annotations

import io
import json
import os
import re
import sqlite3
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.schema import LEXICON, no_items

#: Ends of lines as str.splitlines knows them.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SUFFIXES = {".json": "json-map", ".jsonl": "jsonl", ".txt": "words", ".dict": "cmudict", ".mfa": "mfa", ".pls": "pls", ".xml": "pls", ".sqlite": "gruut-sqlite", ".db": "gruut-sqlite"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(label, content, sha256, size) of each file; readable by any of Spark's file systems."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("label"), "content", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(label, line, text): lines numbered from 1; content that isn't UTF-8 is an error."""
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat("label", F.lit(": invalid UTF-8"))))
    each = files(spark, path).select("label", F.posexplode(F.split(text, LINE_ENDS)).alias("i", "text"), F.size(F.split(text, LINE_ENDS)).alias("n"))
    return each.where(~((F.col("i") == F.col("n") - 1) & (F.col("text") == ""))).select("label", (F.col("i") + 1).alias("line"), "text")


def _fail(cond: Column, value: Column, message: str) -> Column:
    """value, or an error with the line's label and number where cond holds."""
    return F.when(cond, F.raise_error(F.concat(F.col("label"), F.lit(":"), F.col("line"), F.lit(f": {message}")))).otherwise(value)


def group_rows(rows: DataFrame, source_id: str | None, unique: bool = False) -> DataFrame:
    """rows (line, key, pron) as list values: variants in line order, keys numbered by first line."""
    pairs = F.sort_array(F.collect_list(F.struct("line", "pron")))
    each = rows.groupBy("key").agg(F.min("line").cast("long").alias("ordinal"), F.transform(pairs, lambda x: x["pron"]).alias("variants"))
    variants = F.array_distinct("variants") if unique else F.col("variants")
    return each.select(F.lit(source_id).alias("source_id"), "ordinal", "key", F.lit("list").alias("kind"), variants.alias("variants"), no_items().alias("items"))


def _tsv_rows(spark: SparkSession, path: str, empty_ok: bool) -> DataFrame:
    f = F.split("text", "\t")
    bad = F.size(f) != 2
    empty = (F.element_at(f, 1) == "") | (F.lit(not empty_ok) & (F.try_element_at(f, F.lit(2)) == ""))
    key = _fail(bad, _fail(empty, F.element_at(f, 1), "empty field"), "expected two tab-separated fields")
    return lines(spark, path).select("line", key.alias("key"), F.try_element_at(f, F.lit(2)).alias("pron"))


def read_tsv(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """Two non-empty fields a line; repeated keys gather variants in order, with repeats."""
    return group_rows(_tsv_rows(spark, path, False), source_id)


def read_legacy_tsv(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """As tsv, but a pronunciation may be empty and repeats are dropped."""
    return group_rows(_tsv_rows(spark, path, True), source_id, unique=True)


def read_ipa_tsv(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """Two or three fields; a header in line 1 and empty lines are skipped; one / at either end of the value goes."""
    f = F.split("text", "\t")
    header = (F.col("line") == 1) & (F.lower(F.element_at(f, 1)) == "word") & F.lower(F.try_element_at(f, F.lit(2))).isin("espeak_ipa", "ipa", "pronunciation")
    pron = F.regexp_replace(F.regexp_replace(F.try_element_at(f, F.lit(2)), "^/", ""), r"/\z", "")
    key = _fail(~F.size(f).between(2, 3), _fail((F.element_at(f, 1) == "") | (pron == ""), F.element_at(f, 1), "empty field"), "expected two or three tab-separated fields")
    rows = lines(spark, path).where(F.col("text") != "").where(~F.coalesce(header, F.lit(False)))
    return group_rows(rows.select("line", key.alias("key"), pron.alias("pron")), source_id)


def read_cmudict(spark: SparkSession, path: str, source_id: str | None = None, comments: str = "skip") -> DataFrame:
    """A word and phones after white space; WORD(2) is another variant of WORD, in input order."""
    rows = lines(spark, path).where(F.trim("text") != "")
    comment = F.col("text").startswith(";;;") | F.col("text").startswith("#")
    rows = rows.where(~comment) if comments == "skip" else rows.withColumn("text", _fail(comment, F.col("text"), "comment"))
    word, phones = F.regexp_extract("text", r"^\s*(\S+)\s+(.*?)\s*$", 1), F.regexp_extract("text", r"^\s*(\S+)\s+(.*?)\s*$", 2)
    base = F.when(word.rlike(r"^.+\(\d+\)$"), F.regexp_extract(word, r"^(.+)\((\d+)\)$", 1)).otherwise(word)
    return group_rows(rows.select("line", _fail((word == "") | (phones == ""), base, "expected a word and phones").alias("key"), phones.alias("pron")), source_id)


def read_mfa(spark: SparkSession, path: str, source_id: str | None = None, comments: str = "skip") -> DataFrame:
    """Tab-separated word and phones; more fields are a probabilistic dictionary, which is an error."""
    rows = lines(spark, path).where(F.trim("text") != "")
    comment = F.col("text").startswith("#") | F.col("text").startswith(";")
    rows = rows.where(~comment) if comments == "skip" else rows.withColumn("text", _fail(comment, F.col("text"), "comment"))
    f = F.split("text", "\t")
    key, pron = F.trim(F.element_at(f, 1)), F.trim(F.try_element_at(f, F.lit(2)))
    key = _fail(F.size(f) > 2, _fail((F.size(f) < 2) | (key == "") | (pron == ""), key, "expected a word and phones"), "probabilistic dictionaries aren't supported")
    return group_rows(rows.select("line", key.alias("key"), pron.alias("pron")), source_id)


def read_words(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """A key a line; empty and repeated lines are errors, lines with # are keys."""
    rows = lines(spark, path).select("label", "line", _fail(F.col("text") == "", F.col("text"), "empty line").alias("key"))
    each = rows.groupBy("key").agg(F.min("line").cast("long").alias("ordinal"), F.max("line").alias("line"), F.first("label").alias("label"), F.count("*").alias("n"))
    return each.select(F.lit(source_id).alias("source_id"), "ordinal", _fail(F.col("n") > 1, F.col("key"), "duplicate word").alias("key"), F.lit("word").alias("kind"), F.array().cast("array<string>").alias("variants"), no_items().alias("items"))


# Formats that a parser must read whole -----------------------------------------------------------------------

Row = tuple[str, str, list[str], list[dict] | None]


def _selector(value: object) -> tuple[str, list[str]]:
    if value is None:
        return "null", []
    if isinstance(value, str):
        return "scalar", [value]
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return "list", list(value)
    raise ValueError("a selector must be a string, null or a list of strings")


def typed(key: str, value: object, lists: bool = True, tags: bool = True) -> Row:
    """A key and JSON value as a typed row: string, list of strings, or object of selectors."""
    if not key:
        raise ValueError("empty word")
    if isinstance(value, dict):
        if not tags:
            raise ValueError(f"tagged values aren't allowed: {key!r}")
        if not value or any(not t for t in value):
            raise ValueError(f"bad tags: {key!r}")
        items = []
        for tag, sel in value.items():
            kind, values = _selector(sel)
            items.append({"tag": tag, "sel_kind": kind, "values": values})
        return key, "tagged", [], items
    kind, values = _selector(value)
    if kind == "null" or (kind == "list" and not lists):
        raise ValueError(f"unsupported value: {key!r}")
    return key, kind, values, None


def parse_json_map(data: bytes, label: str, lists: bool = True, tags: bool = True) -> list[Row]:
    root = json.loads(data.decode())
    if not isinstance(root, dict):
        raise ValueError(f"{label}: the root must be an object")
    return [typed(k, v, lists, tags) for k, v in root.items()]


def parse_jsonl(data: bytes, label: str) -> list[Row]:
    out, seen = [], set()
    for n, line in enumerate(data.decode().splitlines(), 1):
        if not line.strip():
            continue
        try:
            r = json.loads(line)
            word, kind = r["word"], r["kind"]
            if word in seen:
                raise ValueError("duplicate word")
            seen.add(word)
            if kind == "word":
                row: Row = (word, "word", [], None)
            elif kind in ("scalar", "list"):
                row = typed(word, r["value"], tags=False)
                if row[1] != kind:
                    raise ValueError(f"value isn't a {kind}")
            elif kind == "tagged":
                if len({t for t, _ in r["items"]}) != len(r["items"]):
                    raise ValueError("duplicate tag")
                row = typed(word, dict(r["items"]))
            else:
                raise ValueError(f"unknown kind {kind!r}")
            if not isinstance(word, str) or not word:
                raise ValueError("empty word")
            out.append(row)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ValueError(f"{label}:{n}: {e}") from e
    return out


def parse_lxc_tsv(data: bytes, label: str) -> list[Row]:
    """Four fields: word, kind, selector, JSON. Rows of a tagged word are its selectors; repeated scalars make a list."""
    scalar: dict[str, list[str]] = {}
    tagged: dict[str, dict[str, object]] = {}
    other: dict[str, Row] = {}
    order: dict[str, None] = {}
    for n, line in enumerate(data.decode().splitlines(), 1):
        f = line.split("\t")
        try:
            if len(f) != 4 or not f[0]:
                raise ValueError("expected four tab-separated fields")
            word, kind, tag, text = f
            order.setdefault(word)
            value = json.loads(text) if text else None
            if kind == "tagged":
                if not tag or tag in tagged.get(word, {}):
                    raise ValueError("missing or repeated selector")
                _selector(value)
                tagged.setdefault(word, {})[tag] = value
            elif kind == "scalar":
                if tag or not isinstance(value, str):
                    raise ValueError("a scalar is a string without selector")
                scalar.setdefault(word, []).append(value)
            elif kind in ("list", "word"):
                if tag or word in other:
                    raise ValueError(f"bad or repeated {kind}")
                other[word] = (word, "word", [], None) if kind == "word" else typed(word, value, tags=False)
            else:
                raise ValueError(f"unknown kind {kind!r}")
        except ValueError as e:
            raise ValueError(f"{label}:{n}: {e}") from e
    out = []
    for word in order:
        if word in scalar:
            v = scalar[word]
            out.append((word, "scalar" if len(v) == 1 else "list", v, None))
        elif word in tagged:
            out.append(typed(word, tagged[word]))
        else:
            out.append(other[word])
    return out


def parse_pls(data: bytes, label: str) -> list[Row]:
    """The strict subset of PLS: one grapheme, phonemes, at most one role a lexeme, nothing else."""
    name = lambda e: e.tag.rpartition("}")[2]
    try:
        root = ET.parse(io.BytesIO(data)).getroot()
    except ET.ParseError as e:
        raise ValueError(f"{label}: {e}") from e
    if name(root) != "lexicon":
        raise ValueError(f"{label}: the root must be lexicon")
    plain: dict[str, list[str]] = {}
    roles: dict[str, dict[str, list[str]]] = {}
    for n, lexeme in enumerate(root, 1):
        if name(lexeme) != "lexeme" or lexeme.attrib:
            raise ValueError(f"{label}: lexeme {n}: unsupported element or attribute")
        parts: dict[str, list[str]] = {"grapheme": [], "phoneme": [], "role": []}
        for e in lexeme:
            text = (e.text or "").strip()
            if name(e) not in parts or len(e) or e.attrib or not text:
                raise ValueError(f"{label}: lexeme {n}: unsupported or empty {name(e)}")
            parts[name(e)].append(text)
        if len(parts["grapheme"]) != 1 or not parts["phoneme"] or len(parts["role"]) > 1:
            raise ValueError(f"{label}: lexeme {n}: one grapheme, a phoneme and at most one role are needed")
        word = parts["grapheme"][0]
        if parts["role"]:
            if word in plain:
                raise ValueError(f"{label}: lexeme {n}: mixes roles and none")
            roles.setdefault(word, {}).setdefault(parts["role"][0], []).extend(parts["phoneme"])
        else:
            if word in plain or word in roles:
                raise ValueError(f"{label}: lexeme {n}: repeated word without role")
            plain[word] = parts["phoneme"]
    one = lambda v: v[0] if len(v) == 1 else v
    return [typed(w, one(v)) for w, v in plain.items()] + [typed(w, {r: one(v) for r, v in by.items()}) for w, by in roles.items()]


def parse_gruut(data: bytes, label: str) -> list[Row]:
    """The word_phonemes table of an SQLite file, by word, order and row; roles make tagged values."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "db")
        with open(path, "wb") as out:
            out.write(data)
        db = sqlite3.connect(path)
        try:
            has_role = "role" in {r[1] for r in db.execute("PRAGMA table_info(word_phonemes)")}
            rows = db.execute(f"SELECT word, phonemes, {'role' if has_role else 'NULL'} FROM word_phonemes ORDER BY word, pron_order, rowid").fetchall()
        finally:
            db.close()
    by: dict[str, dict[str | None, list[str]]] = {}
    for word, phonemes, role in rows:
        by.setdefault(word, {}).setdefault(role, []).append(phonemes)
    out = []
    for word, roles in by.items():
        if None in roles and len(roles) > 1:
            raise ValueError(f"{label}: {word!r} mixes roles and none")
        one = lambda v: v[0] if len(v) == 1 else v
        out.append(typed(word, one(roles[None]) if None in roles else {r: one(v) for r, v in roles.items()}))
    return out


def _parsed(spark: SparkSession, path: str, source_id: str | None, parse: Callable[[bytes, str], list[Row]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, content in zip(b["label"], b["content"], strict=True):
                rows = [(source_id, i, k, kind, v, items) for i, (k, kind, v, items) in enumerate(parse(bytes(content), label))]
                yield pd.DataFrame(rows, columns=LEXICON.fieldNames())

    out = files(spark, path).select("label", "content").mapInPandas(run, LEXICON)
    return out.withColumn("items", F.coalesce("items", no_items()))


def read_json_map(spark, path, source_id=None, allow_tagged: bool = True):
    return _parsed(spark, path, source_id, lambda d, n: parse_json_map(d, n, True, allow_tagged))


def read_kokoro_json(spark, path, source_id=None, allow_lists: bool = True):
    return _parsed(spark, path, source_id, lambda d, n: parse_json_map(d, n, allow_lists, True))


def read_jsonl(spark, path, source_id=None):
    return _parsed(spark, path, source_id, parse_jsonl)


def read_lxc_tsv(spark, path, source_id=None):
    return _parsed(spark, path, source_id, parse_lxc_tsv)


def read_pls(spark, path, source_id=None):
    return _parsed(spark, path, source_id, parse_pls)


def read_gruut_sqlite(spark, path, source_id=None):
    return _parsed(spark, path, source_id, parse_gruut)


def read_legacy_json(spark, path, source_id=None):
    """Strings and non-empty lists, without repeats, all as lists."""
    rows = _parsed(spark, path, source_id, lambda d, n: parse_json_map(d, n, True, False))
    empty = F.size("variants") == 0
    variants = F.when(empty, F.raise_error(F.concat(F.lit("empty list: "), F.col("key")))).otherwise(F.array_distinct("variants"))
    return rows.withColumn("variants", variants).withColumn("kind", F.lit("list"))


READERS: dict[str, Callable[..., DataFrame]] = {
    "tsv": read_tsv, "lxc-tsv": read_lxc_tsv, "ipa-tsv": read_ipa_tsv, "json-map": read_json_map, "kokoro-json": read_kokoro_json, "json": read_kokoro_json,
    "jsonl": read_jsonl, "cmudict": read_cmudict, "mfa": read_mfa, "pls": read_pls, "gruut-sqlite": read_gruut_sqlite, "words": read_words,
    "legacy-json": read_legacy_json, "legacy-tsv": read_legacy_tsv,
}


def format_of(path: str, name: str = "auto") -> str:
    """A format by name, or by the path's suffix; tsv for others."""
    if name != "auto":
        if name not in READERS:
            raise ValueError(f"unknown format: {name}")
        return name
    return SUFFIXES.get(os.path.splitext(path)[1].lower(), "tsv")


def read_lexicon(spark: SparkSession, path: str, format: str = "auto", source_id: str | None = None, **options) -> DataFrame:
    return READERS[format_of(path, format)](spark, path, source_id, **options)


def from_pairs(spark: SparkSession, pairs: list[tuple[str, str]], source_id: str | None = None) -> DataFrame:
    """Pairs in order as list values."""
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "line long, key string, pron string")
    return group_rows(rows, source_id)


def from_mapping(spark: SparkSession, entries: dict[str, object], source_id: str | None = None) -> DataFrame:
    """A Python mapping (None: membership only) in the lexicon schema."""
    rows = [(source_id, i, *((k, "word", [], []) if v is None else (*typed(k, list(v) if isinstance(v, tuple) else v)[:3], typed(k, list(v) if isinstance(v, tuple) else v)[3] or []))) for i, (k, v) in enumerate(entries.items())]
    return spark.createDataFrame(rows, LEXICON)


def parse_spec(value: str) -> tuple[str, str, str]:
    """NAME=PATH[:FORMAT]."""
    m = re.fullmatch(r"([^=]+)=(.+?)(?::([a-z-]+))?", value)
    if not m:
        raise ValueError(f"expected NAME=PATH[:FORMAT], got {value!r}")
    return m[1], m[2], m[3] or "auto"


def source_lock(spark: SparkSession, path: str, format: str = "auto") -> dict:
    """A source's hash, size and counts, for pinning."""
    f = files(spark, path).select("sha256", "size").first()
    n = read_lexicon(spark, path, format).agg(F.count("*").alias("k"), F.sum(F.size("variants")).alias("v")).first()
    return {"sha256": f["sha256"], "size_bytes": f["size"], "logical_word_count": n["k"], "ordered_variant_count": n["v"] or 0, "format": format_of(path, format)}


def validate_lock(spark: SparkSession, path: str, lock: dict) -> list[str]:
    """Names of the lock's fields that the file contradicts."""
    now = source_lock(spark, path, lock.get("format", "auto"))
    return [k for k, v in lock.items() if k in now and now[k] != v]
