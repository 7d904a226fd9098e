"""Point, tagged and prefix lookup, membership, layers, aliases and overlays as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lexweave.functions.values import capitalize, first_of, variants_of

VALUE = ("kind", "variants", "items")


def lookup(queries: DataFrame, lexicon: DataFrame, tag: str = "DEFAULT", default_tag: str = "DEFAULT") -> DataFrame:
    """queries (key) with hit, the typed value, its variants under tag, and the first of them; a miss has none."""
    found = queries.join(lexicon.select("key", *VALUE, F.lit(True).alias("_hit")), "key", "left")
    chosen = variants_of(F.coalesce("kind", F.lit("miss")), F.col("variants"), F.col("items"), tag, default_tag)
    return found.select(*queries.columns, F.coalesce("_hit", F.lit(False)).alias("hit"), *VALUE, chosen.alias("selected"), first_of(chosen).alias("first"))


def members(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """queries whose key is stored."""
    return queries.join(lexicon.select("key"), "key", "left_semi")


def misses(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    return queries.join(lexicon.select("key"), "key", "left_anti")


def adversarial_misses(lexicon: DataFrame, limit: int = 256) -> DataFrame:
    """Keys near stored ones that aren't stored: last letter off, x on, case swapped, accent added, rotated."""
    k = F.col("key")
    n = F.char_length(k)
    swapped = F.array_join(F.transform(F.split(k, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")
    made = F.array(F.substring(k, F.lit(1), n - 1), F.concat(k, F.lit("x")), swapped, F.concat(k, F.lit("́")), F.concat(F.substring(k, F.lit(2), n), F.substring(k, 1, 1)))
    near = lexicon.select(F.explode(made).alias("key")).where("key <> ''").distinct()
    return misses(near, lexicon).orderBy(F.xxhash64("key"), "key").limit(limit)


def prefix_matches(texts: DataFrame, lexicon: DataFrame, longest: int, position: int = 0) -> DataFrame:
    """(text, prefix): stored keys that begin text at position. Lengths are enumerated, so the join is on equality."""
    rest = F.char_length("text") - position
    lengths = F.when(rest > 0, F.sequence(F.lit(1), F.least(F.lit(longest), rest)))
    each = texts.select("text", F.explode(lengths).alias("_n")).select("text", F.substring("text", F.lit(position + 1), F.col("_n")).alias("prefix"))
    return each.join(lexicon.select(F.col("key").alias("prefix")), "prefix", "left_semi").distinct()


def layered(layers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All layers' rows with layer and layer_idx; the first layer has index 0."""
    parts = [df.select("key", *VALUE, F.lit(name).alias("layer"), F.lit(i).alias("layer_idx")) for i, (name, df) in enumerate(layers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def layered_lookup(layers: DataFrame) -> DataFrame:
    """For each key the first layer that has it, whatever its value; min_by keeps map-side sums and no sort."""
    best = F.min_by(F.struct("layer", "layer_idx", *VALUE), "layer_idx").alias("_b")
    return layers.groupBy("key").agg(best, F.count("*").alias("layers")).select("key", "_b.*", "layers")


def layered_candidates(candidates: DataFrame, layers: DataFrame) -> DataFrame:
    """candidates (query, pos, key): the hit of the first layer that has any, in the candidates' order within it."""
    unique = candidates.groupBy("query", "key").agg(F.min("pos").alias("pos"))
    best = F.min_by(F.struct("key", "layer", "layer_idx", *VALUE), F.struct("layer_idx", "pos")).alias("_b")
    return unique.join(layers, "key").groupBy("query").agg(best).select("query", "_b.*")


def layered_order(layers: DataFrame) -> DataFrame:
    """(key, layer, place): each key once, by first layer, then the layer's own order (ordinal if there, else key)."""
    first = layers.groupBy("key").agg(F.min(F.struct("layer_idx", "layer")).alias("_f")).select("key", "_f.*")
    return first.orderBy("layer_idx", "key")


def aliases(lexicon: DataFrame) -> DataFrame:
    """Virtual keys of other case: lower-case and capitalised keys of two letters or more stand for each other.

    Stored keys win, so an alias that is stored is left out; phase is 0 for stored keys and 1 for aliases.
    """
    k = F.col("key")
    lower, upper = F.lower(k), capitalize(k)
    alias = F.when(F.char_length(k) < 2, None).when(k == lower, upper).when(k == capitalize(lower), lower)
    made = lexicon.select(alias.alias("key"), F.col("key").alias("owner"), *VALUE).where("key is not null and key <> owner")
    back = F.when(F.col("key") == F.lower("key"), capitalize(F.col("key"))).otherwise(F.lower("key"))
    made = made.where(back == F.col("owner")).join(lexicon.select("key"), "key", "left_anti")
    stored = lexicon.select("key", F.col("key").alias("owner"), *VALUE, F.lit(0).alias("phase"))
    return stored.unionByName(made.withColumn("phase", F.lit(1)))


def overlay(over: DataFrame, base: DataFrame) -> DataFrame:
    """base with over's rows in place of rows of equal key."""
    return over.select("key", *VALUE).unionByName(base.select("key", *VALUE).join(over.select("key"), "key", "left_anti"))


def ordinals(lexicon: DataFrame, block: int = 256, ranges: int | None = None) -> DataFrame:
    """(key, ordinal, block, place): each key's number in code-point order, and its block of so many.

    Keys are numbered within ranges of the first two characters, then ranges are offset by running counts, so no
    task sorts the whole table.
    """
    head = F.substring("key", 1, 2)
    t = lexicon.select("key", head.alias("_head"))
    inside = t.withColumn("_n", F.row_number().over(Window.partitionBy("_head").orderBy("key")))
    counts = t.groupBy("_head").agg(F.count("*").alias("_c"))
    before = counts.select("_head", F.coalesce(F.sum("_c").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    n = (F.col("_o") + F.col("_n") - 1).cast("long")
    return inside.join(before, "_head").select("key", n.alias("ordinal"), F.floor(n / block).cast("long").alias("block"), (n % block).cast("long").alias("place"))


def prefix_length_index(lexicon: DataFrame) -> DataFrame:
    """(head, lengths): the key lengths that occur for each first character, ascending."""
    return lexicon.groupBy(F.substring("key", 1, 1).alias("head")).agg(F.sort_array(F.collect_set(F.char_length("key"))).alias("lengths"))


def interned(lexicon: DataFrame) -> DataFrame:
    """(value, id): each distinct pronunciation string numbered from 0 in code-point order."""
    values = lexicon.select(F.explode("variants").alias("key")).distinct()
    return ordinals(values).select(F.col("key").alias("value"), F.col("ordinal").alias("id"))
