"""New records linked as they arrive: a stream-static join on core name and address, repeats dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as t


def _keyed(records: DataFrame) -> DataFrame:
    """(country, key, address, entity_id): what two records must share; an absent country or address counts as empty."""
    has = lambda c, x: (x if c in records.columns else F.lit("")).alias(c)
    return records.select(has("country", F.col("country")), t.core_key("name").alias("key"), has("address", t.norm_addr("address")), "entity_id").filter("key is not null")


def unique_keys(queries: DataFrame) -> DataFrame:
    """(country, key, address, q_id) of the core names, with the address if there is one, that one query bears."""
    q = _keyed(queries).groupBy("country", "key", "address").agg(F.count("*").alias("n"), F.first("entity_id").alias("q_id"))
    return q.filter("n = 1").drop("n")


def link_stream(records: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_id, p_id) for streamed records whose country, core name and address belong to one query."""
    r = _keyed(records).withColumnRenamed("entity_id", "p_id")
    return r.join(unique_keys(queries), ["country", "key", "address"]).select("q_id", "p_id")


def drop_repeats(stream: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Drive a stream over all its present input into a memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder, or a single file by its name in its folder, as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")
