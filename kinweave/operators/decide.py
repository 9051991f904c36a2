"""Decisions: gate and extra thresholds, one owner for each candidate, the macro F0.5 metric and threshold tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.windows import ranked


def gate_extra(pairs: DataFrame, gate: float, extra: float) -> DataFrame:
    """A query's best pair stays from ``gate`` on; its others from ``extra`` on, if the best one passed the gate."""
    w = Window.partitionBy("q")
    r = ranked(pairs).withColumn("p1", F.max("s").over(w))
    return r.filter((F.col("p1") >= gate) & ((F.col("rank") == 0) | (F.col("s") >= extra))).drop("p1")


def one_owner(pairs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Each candidate (of each group of the columns ``within``) goes to the query that scores it highest; ties go to the least id."""
    keys = [*within, "p"]
    best = pairs.groupBy(*keys).agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("q").alias("q"))).alias("best"))
    return pairs.join(best.select(*keys, "best.q"), [*keys, "q"], "left_semi")


def outcome(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, n_pred, n_hit, n_true) of every query that the truth or the prediction has; ``truth`` is (q, p)."""
    hit = pairs.select("q", "p").join(truth.select("q", "p").withColumn("y", F.lit(1)), ["q", "p"], "left")
    pred = hit.groupBy("q").agg(F.count("*").alias("n_pred"), F.count("y").alias("n_hit"))
    return truth.groupBy("q").agg(F.count("p").alias("n_true")).join(pred, "q", "full_outer").fillna(0, ["n_pred", "n_hit", "n_true"])


def f05(n_pred, n_hit, n_true):
    """F0.5 of one query; without truth, 1 if nothing is predicted."""
    p, r = n_hit / n_pred, n_hit / n_true
    return F.when(n_true == 0, F.when(n_pred == 0, F.lit(1.0)).otherwise(F.lit(0.0))).when(n_hit > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(F.lit(0.0))


def macro_f05(pairs: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """The mean F0.5 over every query, (macro_f05, n_queries)."""
    o = queries.select("q").join(outcome(pairs, truth), "q", "left").fillna(0, ["n_pred", "n_hit", "n_true"])
    f = f05(F.col("n_pred"), F.col("n_hit"), F.col("n_true"))
    return o.agg(F.avg(f).alias("macro_f05"), F.count("*").alias("n_queries"))


def grid(start_percent: int, stop_percent: int, step_permille: int) -> list[float]:
    return [x / 1000 for x in range(10 * start_percent, 10 * stop_percent + 1, step_permille)]


def _steps(pairs: DataFrame, truth: DataFrame, queries: DataFrame, levels: list[float]) -> DataFrame:
    """Every query's pairs by falling score, with what is kept down to each: (q, n_true, rank, s, level, below, n_pred, n_hit).

    ``level`` counts the thresholds that the pair passes, ``below`` those that
    the next one passes; so at thresholds below + 1 ... level exactly the pairs
    down to this one are kept.  A query without pairs has one row without rank.
    """
    y = pairs.join(truth.select("q", "p").withColumn("y", F.lit(1)), ["q", "p"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    level = F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col("s")))
    w = Window.partitionBy("q").orderBy(F.desc("s"), "p")
    y = ranked(y).withColumn("level", level).withColumn("below", F.coalesce(F.lead("level").over(w), F.lit(0)))
    y = y.withColumn("n_pred", F.col("rank") + 1).withColumn("n_hit", F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n_true = truth.groupBy("q").agg(F.count("p").alias("n_true"))
    return queries.select("q").join(n_true, "q", "left").join(y.drop("p", "y"), "q", "left").fillna(0, ["n_true"])


def _without():
    """The metric of a query that keeps nothing."""
    return F.when(F.col("n_true") == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def tune_gate_extra(pairs: DataFrame, truth: DataFrame, queries: DataFrame, gates: list[float], extras: list[float]) -> DataFrame:
    """(gate, extra, macro_f05) of the whole grid, from two rows a pair.

    At (g, e) a query keeps nothing if its best score is below g, else its best
    pair and its pairs from e on.  Its metric is constant between the scores of
    its pairs, so each pair brings the two ends of its stretch of extra
    thresholds; they are summed by gate level, and the grid is put together
    from those sums, whose number does not depend on the data.
    """
    n_e, n_g = len(extras), len(gates)
    rows = _steps(pairs, truth, queries, extras)
    p1 = rows.filter("rank = 0").select("q", F.size(F.filter(F.array(*map(F.lit, gates)), lambda g: g <= F.col("s"))).alias("gate_level"))
    rows = rows.join(p1, "q", "left").withColumn("gate_level", F.coalesce("gate_level", F.lit(0)))
    value = f05(F.col("n_pred"), F.col("n_hit"), F.col("n_true"))
    top = F.when(F.col("rank") == 0, F.lit(n_e)).otherwise(F.col("level"))
    end = rows.filter("rank is not null and gate_level > 0").select("gate_level", value.alias("v"), (F.col("below") + 1).alias("low"), (top + 1).alias("high"))
    ends = end.select("gate_level", F.explode(F.array(F.struct(F.col("low").alias("at"), F.col("v").alias("v")), F.struct(F.col("high").alias("at"), (-F.col("v")).alias("v")))).alias("x"))
    sums = ends.groupBy("gate_level", "x.at").agg(F.sum("x.v").alias("v")).groupBy("gate_level").agg(F.collect_list(F.struct("at", "v")).alias("ends"))
    first = rows.filter("rank is null or rank = 0").groupBy("gate_level").agg(F.sum(_without()).alias("without"), F.count("*").alias("n"))
    cell = first.join(sums, "gate_level", "left").select("gate_level", "without", "n", "ends", F.explode(F.sequence(F.lit(1), F.lit(n_e))).alias("i"))
    got = F.aggregate(F.filter("ends", lambda x: x["at"] <= F.col("i")), F.lit(0.0), lambda a, x: a + x["v"])
    cell = cell.select("gate_level", "without", "n", "i", F.coalesce(got, F.lit(0.0)).alias("got"), F.explode(F.sequence(F.lit(1), F.lit(n_g))).alias("j"))
    total = cell.groupBy("i", "j").agg((F.sum(F.when(F.col("gate_level") >= F.col("j"), F.col("got")).otherwise(F.col("without"))) / F.sum("n")).alias("macro_f05"))
    return total.select(F.element_at(F.array(*map(F.lit, gates)), F.col("j")).alias("gate"), F.element_at(F.array(*map(F.lit, extras)), F.col("i")).alias("extra"), "macro_f05")


def tune_threshold(pairs: DataFrame, truth: DataFrame, queries: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, macro_f05) when all pairs from the threshold on are kept; the ends of stretches are summed as above.

    With a column ``country`` beside the queries' ``q``: (country, threshold, macro_f05) of each country's queries.
    """
    n = len(thresholds)
    by = ["country"] if "country" in queries.columns else []
    rows = _steps(pairs, truth, queries, thresholds)
    rows = rows.join(queries.select("q", *by), "q") if by else rows
    one = lambda n: F.lit(n).alias("one")
    stretch = rows.filter("rank is not null").select(*by, f05(F.col("n_pred"), F.col("n_hit"), F.col("n_true")).alias("v"), (F.col("below") + 1).alias("low"), (F.col("level") + 1).alias("high"), one(0))
    rest = rows.filter("rank is null or rank = 0").select(*by, _without().alias("v"), (F.coalesce("level", F.lit(0)) + 1).alias("low"), F.lit(n + 1).alias("high"), one(1))
    low = F.struct(F.col("low").alias("at"), F.col("v").alias("v"), F.col("one").alias("one"))
    high = F.struct(F.col("high").alias("at"), (-F.col("v")).alias("v"), F.lit(0).alias("one"))
    ends = stretch.unionByName(rest).select(*by, F.explode(F.array(low, high)).alias("x"))
    sums = ends.groupBy(*by, "x.at").agg(F.sum("x.v").alias("v"), F.sum("x.one").alias("one")).groupBy(*by).agg(F.collect_list(F.struct("at", "v")).alias("ends"), F.sum("one").alias("n"))
    at = sums.select(*by, "ends", "n", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    got = F.aggregate(F.filter("ends", lambda x: x["at"] <= F.col("i")), F.lit(0.0), lambda a, x: a + x["v"])
    return at.select(*by, F.element_at(F.array(*map(F.lit, thresholds)), F.col("i")).alias("threshold"), (got / F.col("n")).alias("macro_f05"))


def country_thresholds(tuned: DataFrame, unseen: DataFrame | None = None) -> DataFrame:
    """(country, threshold, macro_f05): each country's best threshold, the least of equal ones.

    A country of ``unseen``, (country), that was not tuned gets the highest threshold of the others and no metric.
    """
    best = tuned.groupBy("country").agg(F.min(F.struct((-F.round("macro_f05", 9)).alias("f"), F.col("threshold"))).alias("b"))
    best = best.select("country", "b.threshold", (-F.col("b.f")).alias("macro_f05"))
    if unseen is None:
        return best
    most = best.agg(F.max("threshold").alias("threshold"))
    new = unseen.select("country").distinct().join(best, "country", "left_anti").join(F.broadcast(most))  # one row
    return best.unionByName(new.select("country", "threshold", F.lit(None).cast("double").alias("macro_f05")))


def best_row(tuned: DataFrame, *ties) -> DataFrame:
    """The grid row of highest metric; ``ties`` order equal ones (least threshold first, or highest gate, then highest extra)."""
    return tuned.orderBy(F.desc(F.round("macro_f05", 9)), *ties).limit(1)


def target_rate(pairs: DataFrame, n_queries: int, target: float, owned: float = 0.995) -> DataFrame:
    """(threshold, rate): the threshold of .300 ... .990 whose expected matches a query come nearest the target."""
    steps = [x / 1000 for x in range(300, 995, 5)]
    level = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("s")))
    kept = pairs.withColumn("level", level).groupBy("level").agg(F.count("*").alias("n"))
    kept = kept.select("n", F.explode(F.sequence(F.lit(1), F.col("level"))).alias("j")) if steps else kept
    kept = kept.filter("j >= 1").groupBy("j").agg(F.sum("n").alias("n"))
    rate = F.col("n") * owned / n_queries
    out = kept.select(F.element_at(F.array(*map(F.lit, steps)), F.col("j")).alias("threshold"), rate.alias("rate"))
    return out.orderBy(F.round(F.abs(F.col("rate") - target), 9), "threshold").limit(1)
