"""The fixed typed schema of a lexicon: one row a key, a tagged union as kind, variants and items."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

SELECTOR = T.StructType(
    [
        T.StructField("tag", T.StringType(), False),
        T.StructField("sel_kind", T.StringType(), False),
        T.StructField("values", T.ArrayType(T.StringType(), False), False),
    ]
)

#: kind is 'scalar' (one variant), 'list' (any number, in order), 'tagged' (items) or 'word' (membership only).
LEXICON = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("key", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("variants", T.ArrayType(T.StringType(), False)),
        T.StructField("items", T.ArrayType(SELECTOR)),
    ]
)

ITEMS_DDL = "array<struct<tag:string,sel_kind:string,values:array<string>>>"


def no_items() -> Column:
    return F.array().cast(ITEMS_DDL)


def value() -> Column:
    """A row's typed value as one comparable struct."""
    return F.struct("kind", "variants", "items")
