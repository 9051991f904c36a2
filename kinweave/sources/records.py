"""Readers and writers of record tables.

A record is (entity_id, name, address, country), all strings; an empty field
is the empty string and the text NA stays text.  Ground truth and match lists
are long tables (q_id, p_id) inside the engine and comma lists at its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, header: bool = True) -> DataFrame:
    """A tab-separated table of strings (gzip by its name); empty fields are empty strings, quotes are doubled."""
    options = {"sep": "\t", "header": header, "quote": '"', "escape": '"', "multiLine": True}
    return spark.read.schema(schema).options(**options).csv(path).fillna("")


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """One or several sources as one table of records."""
    out = None
    for path in paths:
        t = read_tsv(spark, path)
        out = t if out is None else out.unionByName(t)
    return out.select("entity_id", F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")


def explode_truth(truth: DataFrame, ids: str = "matched_entity_ids", q: str = "source1_entity_id") -> DataFrame:
    """(q_id, p_id) of a comma list; empty lists give no row."""
    return truth.select(F.col(q).alias("q_id"), F.explode(F.split(ids, ",")).alias("p_id")).filter("p_id <> ''")


def truth_counts(truth: DataFrame, ids: str = "matched_entity_ids", q: str = "source1_entity_id") -> DataFrame:
    """(q_id, n_true), also of queries without a match."""
    return truth.select(F.col(q).alias("q_id"), F.size(F.filter(F.split(ids, ","), lambda x: x != "")).cast("long").alias("n_true"))


def match_lists(queries: DataFrame, pairs: DataFrame, order: list[Column], column: str = "matched_entity_ids") -> DataFrame:
    """One row for each query, its distinct partners as a comma list, best first; empty without partners."""
    ranked = pairs.select("q_id", "p_id", F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("p_id")).alias("o"))
    lists = ranked.groupBy("q_id").agg(F.array_sort(F.collect_list("o")).alias("o"))
    lists = lists.select("q_id", F.array_join(F.array_distinct(F.transform("o", lambda x: x["p_id"])), ",").alias(column))
    return queries.select("q_id").join(lists, "q_id", "left").withColumn(column, F.coalesce(column, F.lit("")))


def append_matches(lists: DataFrame, found: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """Comma lists (q_id, ids) with the ids of ``found`` (q_id, p_id, step) behind them: by step, then id, each once."""
    more = found.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("step", "p_id"))).alias("more"))
    old = F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")
    new = F.coalesce(F.transform("more", lambda x: x["p_id"]), F.array().cast("array<string>"))
    return lists.join(more, "q_id", "left").select("q_id", F.array_join(F.array_distinct(F.concat(old, new)), ",").alias(column))


def country_rows(scored: DataFrame) -> DataFrame:
    """(q_id, ids), only for queries with a match, ids by falling score; to be written without a header, queries in order."""
    ranked = scored.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "p_id"))).alias("o"))
    return ranked.select("q_id", F.array_join(F.transform("o", lambda x: x["p_id"]), ",").alias("ids"))


def write_rows(rows: DataFrame, path: str) -> None:
    """The rows of :func:`country_rows`, sorted by query, without a header."""
    write_tsv(rows.orderBy("q_id"), path, header=False)


def write_json(df: DataFrame, path: str) -> None:
    """Decisions and reports, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text_blob(records: DataFrame, words_for_signs: bool = True) -> DataFrame:
    """(entity_id, country, text): the folded name and address as one text, as encoders and pair scorers read it."""
    from kinweave.functions.text import fold

    return records.select("entity_id", "country", F.concat_ws(" | ", fold("name", words_for_signs), fold("address", words_for_signs)).alias("text"))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").options(sep="\t", header=header, quote='"', escape='"', emptyValue="").csv(path)


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as records: source by doc_id % 3, name the first five words, address all the others."""
    return as_document_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def as_document_records(docs: DataFrame) -> DataFrame:
    words = F.split(F.col("text"), " ")
    src = (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int")
    return docs.select(
        "doc_id", F.concat(F.lit("S"), src, F.lit("-"), F.col("doc_id")).alias("entity_id"), src.alias("src"),
        F.array_join(F.slice(words, 1, 5), " ").alias("name"), F.array_join(F.slice(words, F.lit(6), F.greatest(F.size(words) - 5, F.lit(0))), " ").alias("address"),
        F.col("lang").alias("country"), F.md5(F.col("text").cast("binary")).alias("content"),
    )


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table as records: a number and a street from size and brand; two countries, by type."""
    src = (F.pmod(F.col("p_partkey"), F.lit(3)) + 1).cast("int")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("doc_id"), F.concat(F.lit("S"), src, F.lit("-"), F.col("p_partkey")).alias("entity_id"), src.alias("src"),
        F.col("p_name").alias("name"), F.concat(F.col("p_size"), F.lit(" "), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lit(" street")).alias("address"),
        F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), F.lit("size")).otherwise(F.lit("line")).alias("country"),
    )


def scored_pairs(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    """lineitem as scored candidate pairs (q, p, s), one row a pair; ``ties``: few distinct scores."""
    s = F.col("l_discount") * 10 if ties else F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber") * 7, F.lit(1000)) / 1000
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("p"), s.alias("s"))
    return t.groupBy("q", "p").agg(F.max("s").alias("s"))
