"""Lexicons derived from the driver's tables, so that every operator has something to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.schema import no_items

LANGS = ("en", "de", "fr", "es")


def pron(w: Column) -> Column:
    """A stand-in pronunciation that makes compounds exact, nearly exact or wrong."""
    t = lambda c: F.translate(F.lower(c), "cqxyw", "kkzif")
    n = F.char_length(w)
    long = F.concat(F.lit("ˈ"), t(F.substring(w, 1, 4)), F.lit("ˌ"), t(F.substring(w, F.lit(5), n)))
    return F.when(n < 4, t(w)).when(n < 8, F.concat(F.lit("ˈ"), t(w))).otherwise(long)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, w, n, fd): each token of a language, how often, and its first document."""
    each = table(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(tokens(F.col("text"))).alias("w"))
    return each.groupBy("lang", "w").agg(F.count("*").alias("n"), F.min("doc_id").alias("fd"))


def lex(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """A source lexicon of one variant a key."""
    each = table(spark, sf_dir, "documents").where(F.col("lang") == lang).select(F.explode(tokens(F.col("text"))).alias("key")).distinct()
    return each.select("key", F.lit("list").alias("kind"), F.array(pron(F.col("key"))).alias("variants"), no_items().alias("items"))


def lex_variants(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Lower-case keys with their surface forms, the most frequent first."""
    t = tok(spark, sf_dir)
    t = t if lang is None else t.where(F.col("lang") == lang)
    forms = t.groupBy("w").agg(F.sum("n").alias("n"))
    each = forms.groupBy(F.lower("w").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "w"))), lambda x: x["w"]).alias("variants"))
    return each.select("key", F.lit("list").alias("kind"), "variants", no_items().alias("items"))


def lex_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of conversations with a pronunciation a role."""
    each = table(spark, sf_dir, "conversations").where("role is not null").select("role", F.explode(tokens(F.col("text"))).alias("key")).distinct()
    item = F.struct(F.col("role").alias("tag"), F.lit("scalar").alias("sel_kind"), F.array(pron(F.concat("key", F.when(F.col("role") == "user", "").otherwise(F.col("role"))))).alias("values"))
    return each.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("items")).select("key", F.lit("tagged").alias("kind"), F.array().cast("array<string>").alias("variants"), "items")


def lex_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("key")).distinct()
    return each.select("key", F.lit("word").alias("kind"), F.array().cast("array<string>").alias("variants"), no_items().alias("items"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of documents labelled good, with their pronunciations."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    each = table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select(F.explode(tokens(F.col("text"))).alias("key")).distinct()
    return each.select("key", F.lit("list").alias("kind"), F.array(pron(F.col("key"))).alias("variants"), no_items().alias("items"))
