r"""Line dedup across documents, with DataFrame functions only.

Each text is exploded into normalised lines (white space stripped at both
ends, A-Z lower-cased); lines are hashed; the distinct documents of each hash
are counted (for a threshold of two, a least id below the greatest one tells);
lines whose hash is in at least ``min_docs`` documents are dropped except in
the document of least id; the rest is put together by position.

What moves: the hashes are made once and stored.  The first shuffle carries
(hash, doc_id) pairs, pre-aggregated within each document and each task, so a
line that a third of all documents share arrives as one row per task.  The
second brings the owners of repeated hashes back to their documents; hashes of
more than 1/2000 of these rows are dealt finer, so no line meets in one task.
The last joins the dropped hashes of each document with its text.

Defined results: a null or empty text has one empty line; very long texts and
lines are taken whole; a null id stands after every other id and counts as one
document; rows that repeat an id are parts of one document, and each keeps its
own row; keys shorter than ``min_chars`` code points are never dropped; other
columns pass through, and one that bears a result's name is replaced by the
result in ``dedup_lines`` and kept as it is in ``keep_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, join_spread, table

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """(d, t, h, g): the 128-bit hashes of the distinct line keys of each row that are long enough to be dropped; t is the text's hash."""
    key = F.transform(_lines(F.col(text)), line_key)  # an array of its own, so each key is made once
    key = F.array_distinct(F.filter(key, lambda x: F.char_length(x) >= min_chars))
    hashed = F.transform(key, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x, F.lit(2)).alias("g")))
    return docs.select(*_row_key(doc_id, text), F.explode(hashed).alias("k")).select("d", "t", "k.h", "k.g")


def _row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(doc_id), F.lit(_LAST)).alias("d"), F.xxhash64(F.col(text)).alias("t")


def repeated_lines(each: DataFrame, min_docs: int = 2) -> DataFrame:
    """(h, g, n, owner): hashes of the line keys in at least ``min_docs`` documents, the rows that have them, and the least id."""
    some = [F.count("*").alias("n"), F.min("d").alias("owner")]
    if min_docs == 2:  # two distinct ids differ in least and greatest
        seen = each.groupBy("h", "g").agg(*some, F.max("d").alias("last")).filter("owner < last")
    else:
        seen = each.groupBy("h", "g").agg(*some, F.count_distinct("d").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return seen.select("h", "g", "n", "owner")


def _judged(docs: DataFrame, min_chars: int, min_docs: int, doc_id: str, text: str) -> DataFrame:
    """(row, lines, kept): each row of ``docs`` as a struct, its lines, and those that stay."""
    each = cut(_keys(docs, min_chars, doc_id, text))
    again = cut(repeated_lines(each, min_docs))
    drop = join_spread(each, again, ["h", "g"], ["d", "t"]).filter("owner <> d").groupBy("d", "t").agg(F.collect_set("h").alias("h"))
    row = docs.select(F.struct("*").alias("row"), *_row_key(doc_id, text)).join(drop, ["d", "t"], "left")
    row = row.select("row", _lines(F.col("row").getField(text)).alias("lines"), "h")
    keyed = F.transform("lines", lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    stays = F.filter(keyed, lambda x: (F.char_length(x["key"]) < min_chars) | ~F.array_contains("h", F.xxhash64(x["key"])))
    kept = F.when(F.col("h").isNull(), F.col("lines")).otherwise(F.transform(stays, lambda x: x["line"]))
    return row.select("row", "lines", kept.alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the columns ``n_lines``, ``n_dropped`` and ``kept_text`` added (or replaced)."""
    added = {
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": (F.size("lines") - F.size("kept")).cast("long"),
        "kept_text": F.array_join("kept", "\n"),
    }
    old = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return _judged(docs, min_chars, min_docs, doc_id, text).select(*old, *(v.alias(k) for k, v in added.items()))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH line AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(trim(lines[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), again AS (
  SELECT key, min(doc_id) AS owner FROM line WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT l.doc_id, l.pos, l.line, a.owner IS NOT NULL AND a.owner <> l.doc_id AS gone
  FROM line l LEFT JOIN again a ON l.key = a.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def keep_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines gone from the text, and ``n_chars`` counted again; all other columns as they are."""
    out = _judged(docs, min_chars, min_docs, doc_id, text).select("row", F.array_join("kept", "\n").alias("kept"))
    new = {text: F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
