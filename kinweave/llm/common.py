"""What the corpus operators share: table access, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests, local mode) a temporary one is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="kinweave-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_column(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Fail early, with a clear message, on a missing id or text column."""
    if name not in df.columns:
        raise ValueError(f"column {name} is missing; have {df.columns}")
    return df


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root = least node.

    Alternating large-star / small-star contraction: every round is one shuffle
    by node of the remaining edges, hubs are reduced by a map-side ``min`` and a
    join with the result, and the lineage is cut in the shared folder.  Only a
    one-row convergence figure reaches the driver.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b and a is not null and b is not null")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def batches_with(batches: Iterable, rows: int):
    """Arrow batches cut to at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def add_columns(df: DataFrame, kernel, fields: str, text: str, lower: bool = False, limit: int | None = None) -> DataFrame:
    """``df`` with the columns that ``kernel`` computes from each text.

    ``kernel(block)`` gets a :class:`~kinweave.llm.textvec.Block` and returns
    arrays in the order of ``fields`` (a DDL string).  A result replaces an
    input column of the same name (compared without case, as Spark does).
    Runs partition by partition with no shuffle; a null text counts as empty.
    ``lower``: the kernel sees lower-cased texts.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    from kinweave.llm import textvec

    added = StructType.fromDDL(fields)
    taken = {f.name.lower() for f in added}
    at = next(i for i, f in enumerate(df.schema) if f.name == text)
    keep = [i for i, f in enumerate(df.schema) if f.name.lower() not in taken]
    schema = StructType([df.schema[i] for i in keep] + list(added))
    types = [to_arrow_type(f.dataType) for f in added]
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            column = textvec.strings(batch.column(at))
            for block in textvec.blocks(pc.utf8_lower(column) if lower else column, limit or textvec.BLOCK):
                new = [x if isinstance(x, pa.Array) else pa.array(x) for x in kernel(block)]
                new = [x if x.type == t else x.cast(t) for x, t in zip(new, types, strict=True)]
                old = [batch.column(i).slice(block.first, block.n) for i in keep]
                yield pa.RecordBatch.from_arrays(old + new, names=names)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a compressed Parquet table in the same shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], counts: DataFrame | None = None, share: int = 2000, least: int = 100, how: str = "inner") -> DataFrame:
    """The join of ``left`` with ``right`` (unique keys), in which no key meets in one task.

    ``counts`` (by default ``right``) bears in ``n`` how many rows of ``left``
    each key has.  Keys of more than 1/``share`` of those rows and more than
    ``least``, ``share`` keys at most, are broadcast to mark their rows; these
    are dealt that many times finer by a hash of the columns ``by``, and
    ``right`` repeats such keys as often, 2 * ``share`` times in all at most.
    """
    counts = right if counts is None else counts
    most = max(least, (counts.agg(F.sum("n")).first()[0] or 0) / share)
    ways = F.ceil(F.col("n") / F.lit(float(most))).cast("long").alias("_ways")
    hot = F.broadcast(counts.filter(F.col("n") > most).select(*keys, ways))
    way = F.pmod(F.xxhash64(*by), F.coalesce("_ways", F.lit(1).cast("long"))).alias("_way")
    a = left.join(hot, keys, "left").select(*left.columns, way)
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("_ways", F.lit(1).cast("long")) - 1)
    b = right.join(hot, keys, "left").select(*right.columns, F.explode(every).alias("_way"))
    return a.join(b, [*keys, "_way"], how).drop("_way")
