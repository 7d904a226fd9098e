"""Stream-static lookup: an extension, as lexicons themselves are finite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.operators.durable import cut


def stream_lookup(spark: SparkSession, path: str, lexicon: DataFrame, key: str = "event_type", by: str = "event_type") -> DataFrame:
    """(key, hit, n): a file stream's rows joined to a lexicon, counted by key, run until the input is read."""
    static = cut(lexicon.select("key"))
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    joined = source.select(F.col(key).alias("key")).join(static.withColumn("hit", F.lit(True)), "key", "left")
    counted = joined.groupBy("key", F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"))
    table = f"lookup_{uuid.uuid4().hex}"
    q = counted.writeStream.outputMode("complete").format("memory").queryName(table).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(table)
