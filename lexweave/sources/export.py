"""Exports of lexicons to source formats, and the packed Parquet store with its manifest."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.operators.compare import logical_sha256, verify
from lexweave.schema import LEXICON
from lexweave.sources.readers import READERS, format_of, read_lexicon

RESERVED = frozenset({"format", "schema", "entries", "logical_sha256", "key_order", "compression"})


def _quoted(c: Column) -> Column:
    """A JSON string: backslash, quote and control characters escaped, the rest as it is."""
    one = F.to_json(F.struct(c.alias("v")))
    return F.substring(one, F.lit(6), F.char_length(one) - 6)


def _list(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, _quoted), ","), F.lit("]"))


def _sel(i: Column) -> Column:
    return F.when(i["sel_kind"] == "null", "null").when(i["sel_kind"] == "scalar", _quoted(F.element_at(i["values"], 1))).otherwise(_list(i["values"]))


def jsonl_lines(lexicon: DataFrame) -> DataFrame:
    """(key, line): one canonical record a key."""
    head = F.concat(F.lit('{"word":'), _quoted(F.col("key")), F.lit(',"kind":"'), F.col("kind"), F.lit('"'))
    items = F.array_join(F.transform("items", lambda i: F.concat(F.lit("["), _quoted(i["tag"]), F.lit(","), _sel(i), F.lit("]"))), ",")
    body = F.when(F.col("kind") == "scalar", F.concat(F.lit(',"value":'), _quoted(F.try_element_at("variants", F.lit(1))))).when(F.col("kind") == "list", F.concat(F.lit(',"value":'), _list(F.col("variants")))).when(F.col("kind") == "tagged", F.concat(F.lit(',"items":['), items, F.lit("]"))).otherwise("")
    return lexicon.withColumn("line", F.concat(head, body, F.lit("}")))


def tsv_lines(lexicon: DataFrame, allow_lossy: bool = False) -> DataFrame:
    """(key, line): a line a variant; tagged and word-only keys are an error unless they may be dropped."""
    plain = F.col("kind").isin("scalar", "list")
    error = F.raise_error(F.concat(F.lit("not expressible as TSV: "), F.col("key"))).cast("boolean")
    kept = lexicon.where(plain if allow_lossy else F.when(plain, F.lit(True)).otherwise(error))
    each = kept.select("key", *[c for c in ("ordinal",) if c in lexicon.columns], F.posexplode("variants").alias("pos", "v"))
    return each.withColumn("line", F.concat_ws("\t", "key", "v"))


def lxc_tsv_lines(lexicon: DataFrame) -> DataFrame:
    """(key, line): word, kind, selector and JSON; a line a selector for tagged values."""
    whole = F.array(F.struct(F.lit("").alias("tag"), F.when(F.col("kind") == "scalar", _quoted(F.try_element_at("variants", F.lit(1)))).when(F.col("kind") == "list", _list(F.col("variants"))).otherwise("").alias("v")))
    each = F.when(F.col("kind") == "tagged", F.transform("items", lambda i: F.struct(i["tag"].alias("tag"), _sel(i).alias("v")))).otherwise(whole)
    rows = lexicon.select("key", "kind", *[c for c in ("ordinal",) if c in lexicon.columns], F.posexplode(each).alias("pos", "s"))
    return rows.withColumn("line", F.concat_ws("\t", "key", "kind", "s.tag", "s.v"))


def word_lines(lexicon: DataFrame, allow_lossy: bool = False) -> DataFrame:
    key = F.col("key") if allow_lossy else F.when(F.col("kind") == "word", F.col("key")).otherwise(F.raise_error(F.concat(F.lit("only words can be exported without loss: "), F.col("key"))))
    return lexicon.withColumn("line", key)


def plain_json(lexicon: DataFrame) -> DataFrame:
    """(key, line): `"key": value` members of a JSON map; word-only keys are an error."""
    items = F.array_join(F.transform("items", lambda i: F.concat(_quoted(i["tag"]), F.lit(": "), _sel(i))), ", ")
    bad = F.raise_error(F.concat(F.lit("a JSON map has no word-only keys: "), F.col("key")))
    body = F.when(F.col("kind") == "scalar", _quoted(F.try_element_at("variants", F.lit(1)))).when(F.col("kind") == "list", _list(F.col("variants"))).when(F.col("kind") == "tagged", F.concat(F.lit("{"), items, F.lit("}"))).otherwise(bad)
    return lexicon.withColumn("line", F.concat(_quoted(F.col("key")), F.lit(": "), body))


def export_file(lexicon: DataFrame, path: str, format: str = "auto", allow_lossy: bool = False) -> int:
    """Write one file in a source format, in ordinal order (JSON maps by key), and return how many lines it has.

    A single file is a driver-side product: rows stream through, none are gathered.
    """
    name = format_of(path, format)
    order = ["ordinal", "key"] if "ordinal" in lexicon.columns else ["key"]
    if name in ("json-map", "json", "kokoro-json"):
        rows = plain_json(lexicon).orderBy("key")
    elif name == "jsonl":
        rows = jsonl_lines(lexicon).orderBy(*order)
    elif name == "lxc-tsv":
        rows = lxc_tsv_lines(lexicon).orderBy(*order, "pos")
    elif name == "words":
        rows = word_lines(lexicon, allow_lossy).orderBy(*order)
    elif name == "tsv":
        rows = tsv_lines(lexicon, allow_lossy).orderBy(*order, "pos")
    else:
        raise ValueError(f"no export to {name}")
    part, n = f"{path}.{uuid.uuid4().hex}", 0
    is_map = name in ("json-map", "json", "kokoro-json")
    with open(part, "w", encoding="utf-8", newline="") as out:
        out.write("{" if is_map else "")
        for r in rows.select("line").toLocalIterator():
            out.write((("," if n else "") + "\n  " + r["line"]) if is_map else r["line"] + "\n")
            n += 1
        out.write(("\n" if n else "") + "}\n" if is_map else "")
    os.replace(part, path)
    return n


def write_lines(rows: DataFrame, path: str) -> None:
    """A distributed export: text files whose names and contents sort like the keys."""
    rows.repartitionByRange("key").sortWithinPartitions("key").select("line").write.text(path)


def convert_file(spark: SparkSession, source: str, target: str, input_format: str = "auto", output_format: str = "auto", allow_lossy: bool = False) -> int:
    return export_file(read_lexicon(spark, source, input_format), target, output_format, allow_lossy)


# Store -------------------------------------------------------------------------------------------------------


def pack(lexicon: DataFrame, path: str, metadata: dict | None = None, compression: str = "zstd") -> dict:
    """Write a lexicon as Parquet sorted by key, with a manifest, and verify it against its input by reading it again.

    Sorted files give row groups with narrow key ranges, so a point lookup reads few of them; a Bloom filter on
    the key spares most of the rest.
    """
    clash = RESERVED & set(metadata or {})
    if clash:
        raise ValueError(f"reserved metadata keys: {sorted(clash)}")
    spark = lexicon.sparkSession
    table = lexicon.select(*[F.col(f.name) if f.name in lexicon.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LEXICON.fields])
    table.repartitionByRange("key").sortWithinPartitions("key").write.mode("error").option("compression", compression).option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/entries")
    stored = spark.read.parquet(f"{path}/entries")
    check = verify(stored, table).first()
    if not check["lossless"]:
        raise ValueError(f"the packed lexicon differs from its source: {check.asDict()}")
    manifest = {**(metadata or {}), "format": "lexweave", "schema": 1, "entries": check["asset_entry_count"], "key_order": "utf8", "compression": compression, "logical_sha256": logical_sha256(stored)}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def open_lexicon(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """A packed lexicon; check compares its content with the manifest's hash."""
    manifest = manifest_of(spark, path)
    if manifest.get("format") != "lexweave" or manifest.get("schema") != 1:
        raise ValueError(f"not a packed lexicon: {path}")
    table = spark.read.parquet(f"{path}/entries")
    if check and logical_sha256(table) != manifest["logical_sha256"]:
        raise ValueError(f"content differs from the manifest: {path}")
    return table


def inspect(spark: SparkSession, path: str) -> dict:
    """Entries, kinds, distinct tags, files and bytes of a packed lexicon."""
    t = open_lexicon(spark, path)
    kinds = {r["kind"]: r["count"] for r in t.groupBy("kind").count().collect()}
    tags = [r["tag"] for r in t.select(F.explode("items.tag").alias("tag")).distinct().orderBy("tag").collect()]
    f = t.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.count("*").alias("n"), F.sum("file_size").alias("b")).first()
    return {"entries": sum(kinds.values()), "kinds": kinds, "tags": tags, "files": f["n"], "bytes": f["b"] or 0}


def verify_file(spark: SparkSession, asset: str, source: str, format: str = "auto") -> dict:
    return verify(open_lexicon(spark, asset), read_lexicon(spark, source, format)).first().asDict()


def save_reduced(decisions: DataFrame, path: str, metadata: dict | None = None) -> None:
    """A reduced lexicon: literals, and membership of all keys; generated keys have no value of their own stored."""
    decisions.select("key", F.when(F.col("literal"), F.col("variants")).alias("variants"), "literal").repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/keys")
    decisions.sparkSession.createDataFrame([(json.dumps(metadata or {}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_reduced(spark: SparkSession, path: str, config=None) -> DataFrame:
    """The decisions of a saved reduction, its generated keys made again from its literals."""
    from lexweave.operators.reduction import DECISION, ReductionConfig, candidates

    t = spark.read.parquet(f"{path}/keys")
    literals = t.where("literal").select("key", "variants")
    made = candidates(t.where("not literal").select("key"), literals, config or ReductionConfig())
    out = t.join(made, "key", "left").withColumn("reason", F.lit(None).cast("string"))
    return out.select(*DECISION)


__all__ = ["READERS", "convert_file", "export_file", "inspect", "load_reduced", "open_lexicon", "pack", "save_reduced", "verify_file"]
