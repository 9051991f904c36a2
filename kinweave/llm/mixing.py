r"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a hash order and read as one stream of
words, cut into blocks of equal size.  Slot i of the schedule takes the source
whose interval of the cumulative target weights holds the golden-ratio point
frac((i + 1) * 0.618...); slots are ranked within their source, and slot rank
r takes block r of the source's stream, starting over at its end.  A schedule
of golden-ratio points keeps every prefix of the mix close to the target
weights, not only the whole.

Sizes: words of ``[^\x20\x09-\x0D]+``.  Targets: the sources share
``total_share`` of all words by weight, each at most ``max_epochs`` times its
own size, the excess reshared by weight among the others.

How it scales: texts are read once, for their sizes, which are stored; rows
equal in id and text are one row with a number of copies from there on.  The
position of a document in its source's stream is the sum of whole hash chunks
before its own plus a running sum inside its chunk, so no window ever spans a
source; slots are ranked the same way, by ranges.  Blocks, slots and documents
meet in equi-joins on (source, block).

Defined results: a null text has size 0 and takes nothing; very long texts are
counted whole and cut by blocks like others; a null source is a source of its
own, last in order; a source without words has target 0; rows that repeat an
id are one document each, ordered by their text's hash, and equal ones share
evenly what they take; rows without id are ordered by that hash alone; an empty
table gives an empty mix; other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import cut, table

GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
CHUNKS = 4096


def word_count(text: Column) -> Column:
    r"""The number of ``[^\x20\x09-\x0D]+`` in a text (null: 0)."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, r"[\x20\x09-\x0D]+"))).cast("long")


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, tie, place, copies, chunk), one row an id and text: place is the hash order inside a source."""
    tie = F.xxhash64(F.col(text))
    place = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("no id "), tie.cast("string"))).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), tie.alias("tie"), place.alias("place"))
    rows = rows.groupBy("doc_id", "source", "size", "tie", "place").agg(F.count("*").alias("copies"))
    return rows.withColumn("chunk", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target), one row a source: the water level of the capped shares."""
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("i", F.row_number().over(by_name)).withColumn("w", F.element_at(cycle, (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    # by rising cap per weight, a source is capped if the level that the rest would reach is not below its cap
    rising = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("total", F.lit(total_share) * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)  # levels fall after the first uncapped source
    target = F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("w"))
    return per.select("source", "source_size", "i", target.alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, i, rank): slot takes the rank-th block of source ``i``'s stream.

    Golden-ratio points and source intervals meet in an equi-join on the cells
    of a grid over [0, 1).  A source's slots beyond its target are void (left
    out), and blocks that its slots did not reach are appended after the
    schedule, so every source gets its whole target.
    """
    spark = targets.sparkSession
    w = Window.orderBy("i")
    share = targets.withColumn("high", F.sum("target").over(w) / F.sum("target").over(Window.partitionBy()))
    share = share.withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0))).filter("high > low")
    n = int(targets.agg(F.ceil(F.sum("target") / block)).first()[0] or 0)
    cell = lambda x: F.least(F.floor(x * CHUNKS), F.lit(CHUNKS - 1)).cast("int")
    bins = share.select("i", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    turn = (F.col("slot") + 1) * F.lit(GOLDEN)
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", turn - F.floor(turn))
    slots = slots.withColumn("cell", cell(F.col("point")))
    hit = slots.join(bins, "cell").filter("low <= point and point < high").select("slot", "i", F.floor(F.col("slot") / CHUNKS).alias("range"))
    counts = hit.groupBy("i", "range").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("i").orderBy("range")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("i", "range").orderBy("slot")) - 1
    ranked = hit.withColumn("inside", inside).join(counts.select("i", "range", "before"), ["i", "range"])
    ranked = ranked.select("slot", "i", (F.col("before") + F.col("inside")).alias("rank"))
    need = targets.select("i", n_blocks(F.col("target"), F.col("source_size"), block).alias("need"))
    ranked = ranked.join(need, "i").filter("rank < need").select("slot", "i", "rank")
    got = need.join(counts.groupBy("i").agg(F.sum("n").alias("got")), "i", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    late = got.select("i", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(late.select((F.lit(n) + F.col("rank")).alias("slot"), "i", "rank"))


def n_blocks(target: Column, size: Column, block: int) -> Column:
    """How many blocks of a stream of ``size`` words, read again and again, hold ``target`` words."""
    words = F.round(target).cast("long")
    per_pass = F.ceil(size / block)
    passes = F.floor(words / F.greatest(size, F.lit(1)))
    return F.when(words <= 0, F.lit(0)).otherwise(passes * per_pass + F.ceil((words - passes * size) / block)).cast("long")


def mix(docs: DataFrame, block: int = 4096, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, max_epochs: float = 2.0,
        text: str = "text", doc_id: str = "doc_id", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(pieces, documents).

    pieces: (slot, doc_id, place, tie, first, words): the words
    first .. first + words - 1 of a document, or of its copies in a row, stand
    in that slot of the mix.
    documents: (doc_id, source, size, copies, source_size, target, place, tie).
    """
    sized = cut(sizes(docs, text, doc_id, source))
    targets = source_targets(sized, weights, total_share, max_epochs)
    named = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    named = named.withColumn("all", F.col("size") * F.col("copies"))
    chunk = named.groupBy("i", "chunk").agg(F.sum("all").alias("words"))
    chunk = chunk.withColumn("before", F.sum("words").over(Window.partitionBy("i").orderBy("chunk")) - F.col("words"))
    inner = Window.partitionBy("i", "chunk").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("inside", F.coalesce(F.sum("all").over(inner), F.lit(0)))
    placed = placed.join(chunk.select("i", "chunk", "before"), ["i", "chunk"]).withColumn("at", F.col("before") + F.col("inside"))
    b = F.lit(block)
    part = placed.filter("all > 0").select("doc_id", "place", "tie", "i", "at", "all", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("all") - 1) / b))).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * b)
    part = part.select("doc_id", "place", "tie", "i", "block", (start - F.col("at")).alias("first"), (start - F.col("block") * b).alias("offset"),
                       (F.least(F.col("at") + F.col("all"), (F.col("block") + 1) * b) - start).alias("words"))
    slots = schedule(targets, block).join(targets.select("i", "target", "source_size"), "i")
    per_pass = F.ceil(F.col("source_size") / b)
    turn = F.floor(F.col("rank") / per_pass)
    slots = slots.withColumn("block", F.col("rank") - turn * per_pass)
    left = F.round("target").cast("long") - turn * F.col("source_size") - F.col("block") * b
    slots = slots.select("slot", "i", "block", F.least(left, b).alias("take"))
    joined = part.join(slots, ["i", "block"])
    pieces = joined.withColumn("words", F.least(F.col("words"), F.col("take") - F.col("offset"))).filter("words > 0")
    return pieces.select("slot", "doc_id", "place", "tie", "first", "words"), placed.select("doc_id", "source", "size", "copies", "source_size", "target", "place", "tie")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of ``docs``."""
    pieces, placed = mix(docs, **options)
    taken = pieces.groupBy("place", "tie").agg(F.sum("words").alias("taken"))
    out = placed.join(taken, ["place", "tie"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    # one row a copy again, in two steps so that no long list is made
    many = F.lit(10_000).cast("long")
    zero = F.lit(0).cast("long")
    out = out.withColumn("_a", F.explode(F.sequence(zero, F.floor((F.col("copies") - 1) / many)))).withColumn("_a", F.col("_a") * many)
    out = out.withColumn("_b", F.explode(F.sequence(zero, F.least(many, F.col("copies") - F.col("_a")) - 1)))
    share = F.floor(F.col("taken") / F.col("copies")) + F.when(F.col("_a") + F.col("_b") < F.col("taken") % F.col("copies"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), share.cast("long").alias("taken"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS place FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([3.0, 1.0, 2.0][CAST((i - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM per
), level AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER rising, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER rising, 0)) AS level
  FROM weighed WINDOW rising AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), target AS (
  SELECT source, source_size,
         CASE WHEN level * w >= cap THEN cap ELSE w * max(CASE WHEN level * w < cap THEN level END) OVER () END AS target FROM level
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(size * (goal // source_size) + greatest(0, least(size, goal % source_size - start)) AS BIGINT) END AS taken
FROM placed
"""


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents that the mix takes words from."""
    out = taken_words(docs, **options)
    return out.filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")
