"""Per-query and per-candidate window features of scored pairs (q, p, s).

Ties are broken by id, so every rank is determined by the rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(pairs: DataFrame, by: str = "q", tie: str = "p", score: str = "s", name: str = "rank") -> DataFrame:
    """0-based rank by falling score within ``by``."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return pairs.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def top_k(pairs: DataFrame, k: int, by: str = "q", tie: str = "p", score: str = "s") -> DataFrame:
    """The best k rows of each group; Spark limits each group before the shuffle."""
    return ranked(pairs, by, tie, score).filter(F.col("rank") < k)


def rank_gap(pairs: DataFrame) -> DataFrame:
    """rank, distance to the best score, and number of candidates of the query."""
    w = Window.partitionBy("q")
    return ranked(pairs).withColumn("gap", F.max("s").over(w) - F.col("s")).withColumn("n_cands", F.count("*").over(w))


def contention(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """How queries compete for a candidate: claimants, rank among them, margin to the best (or to the runner-up), margin to the next.

    ``k`` keeps each query's best k claims.
    """
    claims = top_k(pairs, k).drop("rank") if k else pairs
    w = Window.partitionBy("p").orderBy(F.desc("s"), "q")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = claims.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).withColumn("nclaim", F.count("*").over(whole))
    best, second = F.first("s").over(whole), F.coalesce(F.nth_value("s", 2).over(whole), F.lit(-1.0))
    c = c.withColumn("gap", F.col("s") - F.when(F.col("rank") == 0, second).otherwise(best))
    return c.withColumn("gap_next", F.col("s") - F.coalesce(F.lead("s").over(w), F.lit(0.0)))


def with_contention(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """The pairs with their contention columns, 0 where a pair is no claim."""
    names = {"nclaim": "c_nclaim", "rank": "c_rank", "gap": "c_gap", "gap_next": "c_gap_next"}
    c = claims.select("q", "p", *(F.col(a).cast("double").alias(b) for a, b in names.items()))
    return pairs.join(c, ["q", "p"], "left").fillna(0.0, list(names.values()))


def logit_features(pairs: DataFrame, score: str = "s") -> DataFrame:
    """Of a second scorer's logits: rank, distance to the best, margin (a lone logit competes with -12), mean of the query."""
    w = Window.partitionBy("q").orderBy(F.desc(score), "p")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first(score).over(whole), F.coalesce(F.nth_value(score, 2).over(whole), F.lit(-12.0))
    out = ranked(pairs, score=score, name="ce_rank").withColumn("ce_gap_best", best - F.col(score))
    out = out.withColumn("ce_margin", F.col(score) - F.when(F.col("ce_rank") == 0, second).otherwise(best))
    return out.withColumn("ce_mean_q", F.avg(score).over(whole))


def order_statistics(pairs: DataFrame) -> DataFrame:
    """Context of a first-stage probability among its query's: rank, best, gap, runner-up, how many are confident, sum."""
    w = Window.partitionBy("q").orderBy(F.desc("s"), "p")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ranked(pairs, name="s2_rank").withColumn("s2_p1", F.first("s").over(whole))
    out = out.withColumn("s2_gap1", F.col("s2_p1") - F.col("s")).withColumn("s2_p2", F.coalesce(F.nth_value("s", 2).over(whole), F.lit(0.0)))
    return out.withColumn("s2_nconf", F.sum((F.col("s") >= 0.5).cast("long")).over(whole)).withColumn("s2_sump", F.sum("s").over(whole))
