"""URL rules by a sort-merge range join.

A host is written with its labels reversed (``org.example.``), so every rule
covers one interval of reversed hosts: its own and all subdomains.  URLs and
rule intervals are dealt to key ranges, sorted, and swept once; a stack holds
the rules whose intervals contain the current key, innermost last.  Intervals
of reversed hosts nest or are disjoint, so the stack is the chain of fitting
hosts; of their rules whose path starts the URL's path the longest wins.

A rule interval that spans several ranges is dealt to each of them, so ranges
sweep independently.  The range bounds are a physical choice only: they come
from a sample of the keys, each key ends in a hash of its row so that one URL
that a third of all rows share is still cut into several ranges, and results
do not depend on them.  The driver holds a sample of about 200 keys a range, cut
to 512 characters each, and of them one bound a range; a key finds its range in
two steps of some 90 comparisons for 2,000 ranges.

Defined results: a null url, or one without ``://``, has an empty host and
path and fits no rule; no rule means ``default``; equal rules (same host and
path) are a tie that ``block`` wins, and rules without host or path are none;
repeated rows are judged alike; very long URLs are taken whole; other columns
pass through, and one that bears a result's name is replaced by the result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import table

#: The rules of op9, as (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``a.b.c`` as ``c.b.a.``: a host's subdomains are exactly the keys that start with its own."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges`` - 1 increasing keys that cut the rows about evenly, from a hash sample of about 200 a range."""
    n = keys.count()
    share = min(1.0, 200.0 * ranges / max(n, 1))
    low = int(share * 2**31)
    sample = keys.filter(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(2**31)) < low) if share < 1 else keys
    got = sorted(r.key for r in sample.select(F.substring("key", 1, 512).alias("key")).toLocalIterator())
    step = max(1, len(got) // ranges)
    return sorted(set(got[step::step]))[: ranges - 1]


def _place(bounds: list[str], key: Column) -> Column:
    """The number of bounds at or below a key: first among every step-th bound, then among those between."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    coarse = below(F.lit(bounds[::step]))
    fine = F.element_at(F.array(*(F.lit(bounds[i : i + step]) for i in range(0, len(bounds), step))), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + below(fine))


def match_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict`` added (or replaced).

    ``rules`` has the columns host, path and verdict.
    """
    spark = urls.sparkSession
    ranges = ranges or min(2000, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    added = ("host", "path", "rule", "verdict")
    u = urls.select(F.struct("*").alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    plain = [F.col("row").getField(f.name) for f in urls.schema if isinstance(f.dataType, T.AtomicType)]
    tail = F.concat(F.lit("\x01"), "path", F.lit("\x01"), F.hex(F.xxhash64(*plain)))
    u = u.withColumn("key", F.concat(reversed_host(F.col("host")), tail))
    bounds = _bounds(u.select("key"), ranges)
    place = lambda key: _place(bounds, key)
    u = u.select(place(F.col("key")).alias("part"), F.lit(1).alias("kind"), "key", "host", "path", F.lit(None).cast("string").alias("verdict"), "row")
    r = rules.filter("host is not null and path is not null").select(
        F.lower("host").alias("host"), "path", "verdict", reversed_host(F.lower("host")).alias("key")
    )
    r = r.withColumn("part", F.explode(F.sequence(place(F.col("key")), place(F.concat("key", F.lit("\U0010ffff"))))))
    r = r.select("part", F.lit(0).alias("kind"), "key", "host", "path", "verdict", F.lit(None).cast(u.schema["row"].dataType).alias("row"))
    both = u.unionByName(r).repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")
    schema = both.select("row", "host", "path", F.lit("").alias("rule"), "verdict").schema
    for f in schema:
        f.nullable = True

    def sweep(batches):
        stack: list[tuple[str, list[tuple[str, str, str]]]] = []  # (host key, rules of that host)
        part = None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            at, rule, verdict = [], [], []
            for i, (p, kind, key, host, path, said) in enumerate(zip(*cols, strict=True)):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append((path, said, host))
                    continue
                fit = [(len(h) + len(x), len(h), s == "block", s, h + x) for _, own in stack for x, s, h in own if path.startswith(x)]
                best = max(fit, default=None)
                at.append(i)
                rule.append(best and best[4])
                verdict.append(best[3] if best else default)
            if at:
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([out.column(6), out.column(3), out.column(4), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["row", "host", "path", "rule", "verdict"])

    out = both.select("part", "kind", "key", "host", "path", "verdict", "row").mapInArrow(sweep, schema)
    old = [F.col("row").getField(c).alias(c) for c in urls.columns if c.lower() not in added]
    return out.select(*old, *added)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return match_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH rule(rhost, rpath, said) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), best AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.said,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS n
  FROM parsed p LEFT JOIN rule r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM best WHERE n = 1
"""
