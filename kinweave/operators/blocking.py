"""Candidate joins: TF-IDF top-k over an inverted index, exact dense top-k in blocks, key joins with one owner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import text as t
from kinweave.operators.windows import top_k
from kinweave.sources.checkpoints import cut


def term_table(records: DataFrame, terms: Column | None = None, id_column: str = "entity_id") -> DataFrame:
    """(id, country, term), one row a distinct term of a record."""
    terms = t.terms("name", "address") if terms is None else F.array_distinct(terms)
    return records.select(F.col(id_column).alias("id"), "country", F.explode(terms).alias("term"))


def document_frequency(pool_terms: DataFrame, n_pool: DataFrame, max_df_share: float = 0.0005, min_max_df: int = 50) -> DataFrame:
    """(country, term, df, idf) of the terms in at most max(min_max_df, share of the country's pool) records.

    ``n_pool`` is (country, n).  The cut also bounds the postings that a term
    can bring to the join.
    """
    df = pool_terms.groupBy("country", "term").agg(F.count("*").alias("df")).join(n_pool, "country")
    most = F.greatest(F.lit(min_max_df), F.floor(F.col("n") * max_df_share))
    return df.filter(F.col("df") <= most).select("country", "term", "df", F.ln(F.col("n") / F.col("df")).alias("idf"))


def tfidf_topk(queries: DataFrame, pool: DataFrame, k: int, terms: Column | None = None, **limits) -> DataFrame:
    """(q_id, p_id, score, rank): the k pool records of highest cosine of binary TF-IDF vectors, within a country.

    An inverted index join on (country, term); the frequency cut keeps every
    term's postings short, and partial sums combine before the shuffle by pair.
    """
    pool_terms = cut(term_table(pool, terms))  # used for frequencies, then for weights
    idf = document_frequency(pool_terms, pool.groupBy("country").agg(F.count("*").alias("n")), **limits).select("country", "term", "idf")

    def weighted(table: DataFrame) -> DataFrame:
        w = table.join(idf, ["country", "term"])
        norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("id")))
        return w.withColumn("norm", norm).filter("norm > 0").select("id", "country", "term", (F.col("idf") / F.col("norm")).alias("w"))

    q, p = weighted(term_table(queries, terms)), weighted(pool_terms)
    pairs = q.select("country", "term", F.col("id").alias("q_id"), F.col("w").alias("qw")).join(
        p.select("country", "term", F.col("id").alias("p_id"), F.col("w").alias("pw")), ["country", "term"]
    )
    score = pairs.groupBy("q_id", "p_id").agg(F.round(F.sum(F.col("qw") * F.col("pw")), 6).alias("score"))
    return top_k(score, k, "q_id", "p_id", "score")


def _packed(vectors: DataFrame, block: int, name: str) -> DataFrame:
    """(country, ids, vectors): the vectors of each country dealt into rows of about ``block``."""
    n = vectors.groupBy("country").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))  # one row a country
    rows = vectors.join(F.broadcast(n), "country").groupBy("country", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    pairs = rows.agg(F.collect_list(F.struct("id", "embedding")).alias("rows"))
    return pairs.select("country", F.col("rows.id").alias(f"{name}_id"), F.col("rows.embedding").alias(f"{name}_v"))


def dense_topk(queries: DataFrame, pool: DataFrame, k: int, block: int = 4096, skip_same: bool = False) -> DataFrame:
    """(q_id, p_id, score, rank): the k pool vectors of highest cosine in the query's country, exactly.

    Both sides, (id, embedding) and optionally country, are dealt into blocks
    of about ``block`` vectors of a country; every query block meets the pool
    blocks of its country in one matrix product that keeps its local top k, and
    a grouped limit merges them.  Memory is one pair of blocks, and no pair of
    vectors is ever a row.  ``skip_same``: a vector is no neighbour of itself.
    """
    named = lambda v: v.select("id", "embedding", F.col("country") if "country" in v.columns else F.lit("").alias("country"))
    q, p = _packed(named(queries), block, "q"), _packed(named(pool), block, "p")
    kinds = queries.schema["id"].dataType.simpleString(), pool.schema["id"].dataType.simpleString()

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qi, qv, pi, pv = (batch.column(c)[i].values for c in range(4))
                a, b = _matrix(qv), _matrix(pv)
                score = a @ b.T
                if skip_same:
                    place = {x: j for j, x in enumerate(pi.to_pylist())}
                    same = [(r, place[x]) for r, x in enumerate(qi.to_pylist()) if x in place]
                    if same:
                        score[tuple(np.array(same).T)] = -np.inf
                own = min(k + 1, score.shape[1])
                at = np.argpartition(-score, own - 1, 1)[:, :own]
                # everything at least as good as the k-th stays, so ties are decided by the merge
                least = np.sort(np.take_along_axis(score, at, 1), 1)[:, -min(k, own)]
                r, c = np.nonzero((score >= least[:, None] - 1e-6) & np.isfinite(score))
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(r)), pi.take(pa.array(c)), pa.array(score[r, c])], names=["q_id", "p_id", "score"])

    found = q.join(p, "country").select("q_id", "q_v", "p_id", "p_v").mapInArrow(search, f"q_id {kinds[0]}, p_id {kinds[1]}, score double")
    return top_k(found.withColumn("score", F.round("score", 6)), k, "q_id", "p_id", "score")


def _matrix(rows: pa.ListArray) -> np.ndarray:
    """Unit rows in double."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def candidate_union(dense: DataFrame, lexical: DataFrame, kd: int, kl: int) -> DataFrame:
    """Pairs in the first kd of one list or the first kl of the other; a missing rank is 99, a missing score 0."""
    d = dense.select("q_id", "p_id", F.col("rank").alias("d_rank"), F.col("score").alias("bi_score"))
    l = lexical.select("q_id", "p_id", F.col("rank").alias("l_rank"), F.col("score").alias("l_score"))
    both = d.join(l, ["q_id", "p_id"], "full_outer").filter((F.col("d_rank") < kd) | (F.col("l_rank") < kl))
    in_both = (F.col("d_rank").isNotNull() & F.col("l_rank").isNotNull()).cast("int")
    return both.select(
        "q_id", "p_id", F.coalesce("d_rank", F.lit(99)).cast("long").alias("d_rank"), F.coalesce("l_rank", F.lit(99)).cast("long").alias("l_rank"),
        F.coalesce("bi_score", F.lit(0.0)).alias("bi_score"), F.coalesce("l_score", F.lit(0.0)).alias("l_score"), in_both.alias("in_both"),
    )


def unique_owner(pairs: DataFrame, q: str = "q_id", p: str = "p_id") -> DataFrame:
    """Pairs of candidates that exactly one query claims.

    A count per candidate with partial sums, not a window: a candidate that
    very many queries claim is a single row after its own task.
    """
    one = pairs.groupBy(p).agg(F.count("*").alias("n"), F.first(q).alias(q)).filter("n = 1")
    return one.select(q, p)


def recall_at_k(found: DataFrame, truth: DataFrame, k: list[int]) -> DataFrame:
    """(k, recall, n_true): the share of true pairs among the first k candidates of their queries."""
    hit = truth.join(found.select("q_id", "p_id", "rank"), ["q_id", "p_id"], "left")
    each = F.explode(F.array(*(F.lit(x).cast("long") for x in k))).alias("k")
    return hit.select("rank", each).groupBy("k").agg(F.avg(F.coalesce(F.col("rank") < F.col("k"), F.lit(False)).cast("double")).alias("recall"), F.count("*").alias("n_true"))


def pool_coverage(found: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(country, coverage, n): the share of each country's pool records that are among the first k candidates of any query."""
    seen = found.filter(F.col("rank") < k).select(F.col("p_id").alias("entity_id")).distinct().withColumn("seen", F.lit(1.0))
    n = pool.select("entity_id", "country").join(seen, "entity_id", "left")
    return n.groupBy("country").agg(F.avg(F.coalesce("seen", F.lit(0.0))).alias("coverage"), F.count("*").alias("n"))


def sample_by_hash(df: DataFrame, share: float, id_column: str = "entity_id") -> DataFrame:
    """A Bernoulli sample that depends on the ids only: the first 32 bits of their MD5 as a fraction."""
    bits = F.conv(F.substring(F.md5(F.col(id_column).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return df.filter(bits < int(share * 2**32))


def first_by_hash(df: DataFrame, n: int, by: str | None = None, id_column: str = "entity_id") -> DataFrame:
    """At most n rows, of each group if ``by`` is given, in hash order."""
    place = F.md5(F.col(id_column).cast("string").cast("binary"))
    if by is None:
        return df.orderBy(place, id_column).limit(n)
    w = Window.partitionBy(by).orderBy(place, id_column)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
