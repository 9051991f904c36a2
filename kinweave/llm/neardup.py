"""Near-duplicate detection by improved consistent weighted sampling.

Documents are weighted sets of five-word shingles.  A shingle weighs
(1 + ln tf) * (1 + idf) / 2, where idf falls from 1, for shingles in at most
1/128 of all documents, to 0 for one that every document has; weights are
rounded to 1/32.  Document frequencies are counted over all documents in a
count-min table of fixed size (2 x 2**18 counters, added up in blocks), so
the model that goes to every task has the same few MB at any input size.

Improved consistent weighted sampling (Ioffe 2010) draws 56 samples a text;
two texts agree on a sample with the probability of their weighted Jaccard
similarity.  Four samples make a band, 14 bands are joined; a pair at 0.8
meets in a band with probability 0.9994.  Pairs that meet and agree in fewer
than 0.55 of the samples are left out: a pair at 0.8 does so with a
probability of about 1e-6.  All others are verified by their weighted Jaccard
similarity, exact but for shingles of one pair whose 32-bit hashes collide.

Links, not pairs: texts with the same words are one node from the start.  In
each bucket all members are compared with its least and its greatest node,
which a map-side ``min`` and ``max`` find; verified links form components.
Then, only in buckets that still hold several components, the nodes outside
the largest one meet all nodes of other components, block by block: each block
of 128 texts goes to the blocks that it meets, a kernel compares them, and only
links become rows.  So a bucket of copies that a third of all rows share costs
one comparison a row, no bucket is capped, and links between different texts
are found wherever they meet.  Joins on buckets spread the frequent ones.

Defined results: words are runs of letters and digits, lower-cased; a text of
one to four words has one shingle of them all; very long texts are taken
whole; a text without words (null, empty, punctuation) and a null id are
classes of their own; rows that repeat an id belong to one class, and so do
the classes that they link; the class id is the least doc_id of the class;
other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import textvec as tv
from kinweave.llm.common import add_columns, components, cut, join_spread, table

SIZE, BANDS, ROWS = 5, 14, 4
SAMPLES = BANDS * ROWS
RARE = 128  # a shingle in at most 1/RARE of the documents has the full idf
UNIT = 32  # weights are multiples of 1/UNIT
MIN_SIMILARITY = 0.8
_BITS, _PIECE = 18, 1024
_LIMIT = 1 << 18
_MEET = 128  # texts in a block of a bucket
_ID, _N, _TH = "kinweave: id", "kinweave: rows", "kinweave: text"  # beside the columns of a table


def shingles(block: tv.Block, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit shingle, text index, tf, words' hash): the distinct shingles in order of their texts."""
    start, end, text = block.runs(tv.NOT_ALNUM)
    word = block.hashes(start, end)
    n_words = tv.count_in(text, block.n)
    gram, at = tv.grams(word, text, size)
    key = [gram >> np.uint64(16) | text[at].astype(np.uint64) << np.uint64(48)]
    for n in np.unique(n_words[(n_words > 0) & (n_words < size)]):
        short, at = tv.grams(word, text, int(n))
        own = n_words[text[at]] == n
        key.append(short[own] >> np.uint64(16) | text[at[own]].astype(np.uint64) << np.uint64(48))
    key = np.sort(np.concatenate(key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    first = np.searchsorted(text, np.arange(block.n))
    place = (np.arange(len(word)) - first[text]).astype(np.uint64) if len(word) else np.zeros(0, np.uint64)
    sums = np.stack([_per_text(tv.mix(word ^ tv.mix(place + np.uint64(salt))), text, block.n) for salt in (1 << 40, 1 << 41)])
    return key & np.uint64(2**48 - 1), (key >> np.uint64(48)).astype(np.int64), tf, sums


def _per_text(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    bound = np.searchsorted(text, np.arange(n + 1))
    return total[bound[1:]] - total[bound[:-1]]


def _cells(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = tv.mix(shingle)
    return (h >> np.uint64(64 - _BITS)).astype(np.int64), (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def frequencies(docs: DataFrame, text: str = "text", size: int = SIZE) -> np.ndarray:
    """The count-min table of shingle document frequencies: 2 x 2**18 counters; the last entry of a third row is the number of texts."""

    def count(batches):
        import pyarrow.compute as pc

        sums, n = np.zeros((2, 1 << _BITS), np.int64), 0
        for batch in batches:
            for block in tv.blocks(pc.utf8_lower(tv.strings(batch.column(0))), _LIMIT):
                shingle, owner, _, _ = shingles(block, size)
                n += np.count_nonzero(np.bincount(owner, minlength=block.n))
                for row, cell in enumerate(_cells(shingle)):
                    sums[row] += np.bincount(cell, minlength=1 << _BITS)
        if n:
            flat = sums.ravel().astype(np.int64)
            pieces = [x.tobytes() for x in flat.reshape(-1, _PIECE)] + [np.int64(n).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("counts"):
                own = np.frombuffer(x.as_py(), np.int64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "counts"])

    parts = docs.select(text).mapInArrow(count, "piece int, counts binary")
    parts = parts.groupBy("piece").applyInArrow(add, "piece int, counts binary")
    table_ = np.zeros((3, 1 << _BITS), np.int64)
    for r in parts.collect():  # 513 rows at most
        own = np.frombuffer(r.counts, np.int64)
        if len(own) == 1:
            table_[2, -1] = own[0]
        else:
            table_.reshape(-1)[r.piece * _PIECE : (r.piece + 1) * _PIECE] = own
    return table_


class Model:
    """Shingle weights and the fixed random tables of the sampler; about 10 MB."""

    def __init__(self, counts: np.ndarray):
        n = max(int(counts[2, -1]), 1)
        rare = np.log(np.maximum(n / np.maximum(counts[:2], 1), 1)) / np.log(RARE)
        self.idf = np.minimum(rare, 1).astype(np.float32)

    def weights(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Whole multiples of 1/UNIT, 1 at least."""
        a, b = _cells(shingle)
        idf = np.maximum(self.idf[0][a], self.idf[1][b])
        return np.maximum(np.rint((1 + np.log(tf)) * (1 + idf) / 2 * UNIT), 1).astype(np.uint16)


def _gamma2(n: int) -> np.ndarray:
    """n quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


_tables: dict[int, tuple] = {}
_FINE = 64  # quantiles of r and levels of beta


def _sampler(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed tables for weights up to ``most``: ln c by 16 bits; -r (t - beta + 1) and t by weight and by 12 bits that choose (r, beta)."""
    rows = 256 if most < 256 else 1 << int(most).bit_length()  # texts in which a shingle stands over 1,000 times need more
    if rows not in _tables:
        r = np.repeat(_gamma2(_FINE), _FINE)
        beta = np.tile((np.arange(_FINE) + 0.5) / _FINE, _FINE)
        ln_s = np.log(np.arange(rows).clip(1) / UNIT)[:, None]
        t = np.floor(ln_s / r + beta)
        _tables[rows] = np.log(_gamma2(1 << 16)).astype(np.float32), (-r * (t - beta + 1)).astype(np.float32).ravel(), t.astype(np.int32).ravel()
    return _tables[rows]


def sample(shingle: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x SAMPLES values; texts without shingles have zeros."""
    out = np.zeros((n, SAMPLES), np.uint32)
    m = len(shingle)
    if not m:
        return out
    ln_c_of, part_of, t_of = _sampler(weight.max())
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    texts, size = owner[start], np.diff(np.append(start, m))
    base = tv.mix(shingle)
    short = (base >> np.uint64(32)).astype(np.uint32)
    row = weight.astype(np.int64) << 12
    z, y, i = np.empty(m, np.uint32), np.empty(m, np.uint32), np.empty(m, np.int64)
    ln_a, ln_c = np.empty(m, np.float32), np.empty(m, np.float32)
    for j in range(SAMPLES):
        np.multiply(short, np.uint32((2 * j + 1) * 0x9E3779B1 % 2**32), out=z)
        np.right_shift(z, np.uint32(15), out=y)
        np.bitwise_xor(z, y, out=z)
        np.multiply(z, np.uint32(0x85EBCA77), out=z)
        np.right_shift(z, np.uint32(13), out=y)
        np.bitwise_xor(z, y, out=z)
        np.multiply(z, np.uint32(0xC2B2AE3D), out=z)
        np.right_shift(z, np.uint32(16), out=y)
        np.bitwise_and(z, np.uint32(4095), out=z)
        np.take(ln_c_of, y, out=ln_c, mode="clip")
        np.add(row, z, out=i)
        np.take(part_of, i, out=ln_a, mode="clip")
        np.add(ln_a, ln_c, out=ln_a)
        least = np.minimum.reduceat(ln_a, start)
        hit = np.flatnonzero(ln_a == np.repeat(least, size))
        who = owner[hit]
        first = np.ones(len(hit), bool)
        first[1:] = who[1:] != who[:-1]
        hit = hit[first]  # shingles are sorted: a tie goes to the least
        value = tv.mix(base[hit] + t_of[i[hit]].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out[texts, j] = (value >> np.uint64(32)).astype(np.uint32)
    return out


def similarity(a: bytes, b: bytes) -> float:
    """The weighted Jaccard similarity of two packed vectors."""
    (ha, wa), (hb, wb) = _unpack(a), _unpack(b)
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    low = np.minimum(wa[same], wb[at[same]]).sum()
    total = wa.sum() + wb.sum() - low
    return float(low / total) if total else 0.0


def _unpack(v: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(v) // 6
    return np.frombuffer(v, np.uint32, n), np.frombuffer(v, np.uint16, n, 4 * n).astype(np.int64)


def _pack(shingle: np.ndarray, weight: np.ndarray) -> bytes:
    h = (tv.mix(shingle) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(h, kind="stable")
    return h[order].tobytes() + weight[order].astype(np.uint16).tobytes()


def _signed(docs: DataFrame, model, doc_id: str, text: str) -> DataFrame:
    """(id, h, g, sig) of the texts that have words."""

    def kernel(block):
        shingle, owner, tf, sums = shingles(block)
        sig = sample(shingle, owner, model.value.weights(shingle, tf), block.n)
        some = np.bincount(owner, minlength=block.n) > 0
        sig = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * SAMPLES, pa.int32()), pa.array(sig.ravel().view(np.int32)))
        return [pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(some), sig]

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("id is not null")
    return add_columns(rows, kernel, "h long, g long, some boolean, sig array<int>", "text", lower=True, limit=_LIMIT).filter("some").select("id", "h", "g", "sig")


def _vectors(docs: DataFrame, wanted: DataFrame, model, doc_id: str, text: str) -> DataFrame:
    """(id, v): packed shingle weights of the wanted documents."""

    def kernel(block):
        shingle, owner, tf, _ = shingles(block)
        weight = model.value.weights(shingle, tf)
        bound = np.searchsorted(owner, np.arange(block.n + 1))
        return [pa.array([_pack(shingle[i:j], weight[i:j]) for i, j in zip(bound[:-1], bound[1:], strict=True)], pa.binary())]

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    return add_columns(rows, kernel, "v binary", "text", lower=True, limit=_LIMIT).select("id", "v")


def _verified(pairs: DataFrame, docs: DataFrame, model, doc_id: str, text: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs at or above the threshold."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    v = _vectors(docs, wanted, model, doc_id, text)
    both = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

    def judge(batches):
        for batch in batches:
            sim = [similarity(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    ids = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "va", "vb").mapInArrow(judge, f"a {ids}, b {ids}, similarity double").filter(F.col("similarity") >= threshold)


def _meeting(threshold: float):
    """Links between two blocks of a bucket: of each pair of components there, the first pair of texts at the threshold."""

    def meet(batches):
        for batch in batches:
            ids = batch.column(1).type.value_type.field("id").type
            a, b = [], []
            for band, xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kx, ky = (np.array([r["keys"] for r in side], np.int64) for side in (xs, ys))
                wx, wy = (np.array([_unpack(r["v"])[1].sum() for r in side], float) for side in (xs, ys))
                # a pair that meets in several bands is compared in the first
                first = np.argmax(kx[:, None] == ky[None], 2) == band
                near = np.minimum(wx[:, None], wy[None]) >= threshold * np.maximum(wx[:, None], wy[None])
                done = set()
                for i, j in np.argwhere(first & near).tolist():
                    x, y = xs[i], ys[j]
                    pair = (x["root"], y["root"])
                    if x["root"] != y["root"] and (y["big"] or x["id"] < y["id"]) and pair not in done and similarity(x["v"], y["v"]) >= threshold:
                        done.add(pair)
                        a.append(min(x["id"], y["id"]))
                        b.append(max(x["id"], y["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids)], names=["a", "b"])

    return meet


def _agree(x: str, y: str, share: float):
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda s: s))
    return same >= int(share * SAMPLES)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, class_id), one row for each row of ``docs``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(frequencies(docs, text)))
    signed = cut(_signed(docs, model, doc_id, text))
    node = cut(signed.groupBy("h", "g").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.count("*").alias("n")))
    named = join_spread(signed.select("id", "h", "g"), node.select("h", "g", "n", F.col("id").alias("node")), ["h", "g"], ["id"]).select("id", "node")
    named = cut(named)
    bands = F.array(*(F.xxhash64(F.lit(k), F.slice("sig", k * ROWS + 1, ROWS)) for k in range(BANDS)))
    member = node.select("id", F.posexplode(bands).alias("band", "key"))
    bucket = member.groupBy("band", "key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).filter("low < high")
    member = cut(join_spread(member, cut(bucket), ["band", "key"], ["id"]).drop("n"))
    pairs = member.select(F.col("low").alias("a"), F.col("id").alias("b")).unionByName(member.select(F.col("id").alias("a"), F.col("high").alias("b")))
    pairs = pairs.filter("a < b").distinct()
    sig = node.select("id", "sig")
    pairs = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = cut(pairs.filter(_agree("sa", "sb", 0.55)).select("a", "b").distinct())
    links = _verified(pairs, docs, model, doc_id, text, threshold).select("a", "b").distinct()
    several = cut(named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).filter("a < z"))
    if not several.isEmpty():  # ids with several texts: their nodes are linked
        same = join_spread(named, several, ["id"], ["node"]).filter("a < node").select("a", F.col("node").alias("b"))
        links = links.unionByName(same.distinct())
    links = cut(links)
    root = cut(components(links))

    # buckets that still hold several components
    of = member.select("band", "key", "id").join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    size = of.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    size = size.groupBy("band", "key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("kinds"))
    size = cut(size.filter("kinds > 1").drop("kinds"))
    of = cut(join_spread(of, size, ["band", "key"], ["id"]))
    if not of.isEmpty():
        v = _vectors(docs, of.select("id").distinct(), model, doc_id, text)
        member = of.join(node.select("id", bands.alias("keys")), "id").join(v, "id").withColumn("big", F.col("root") == F.col("largest"))
        item = F.collect_list(F.struct("id", "root", "big", "keys", "v"))
        blocks = lambda n: F.ceil(n / F.lit(_MEET))
        block = lambda n: F.pmod(F.xxhash64("id"), blocks(n))
        x = member.filter("not big").groupBy("band", "key", "n", block(F.col("n") - F.col("most")).alias("x")).agg(item.alias("xs"))
        y = member.groupBy("band", "key", block(F.col("n")).alias("y")).agg(item.alias("ys"))
        x = x.select("band", "key", "xs", F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col("n")) - 1)).alias("y"))
        met = x.join(y, ["band", "key", "y"]).select("band", "xs", "ys")
        ids = docs.schema[doc_id].dataType.simpleString()
        more = cut(met.mapInArrow(_meeting(threshold), f"a {ids}, b {ids}").distinct())
        if not more.isEmpty():
            root = components(links.unionByName(more))

    found = named.join(root, "node", "left").groupBy("id").agg(F.min(F.coalesce("root", "node")).alias("root"))
    out = docs.select(F.col(doc_id).alias("doc_id")).join(found, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = 500_000) -> DataFrame:
    """One document of each class stays: the one of least id (and every row without an id).

    Of rows with one id and text one stays; an id's other texts stay with it.
    Texts are not shuffled while at most ``max_broadcast`` ids go.
    """
    gone = cut(classes(docs, doc_id, text).filter("class_id <> doc_id").select(F.col("doc_id").alias(_ID)).distinct())
    twice = cut(docs.groupBy(F.col(doc_id).alias(_ID)).agg(F.count("*").alias(_N)).filter((F.col(f"`{_N}`") > 1) & F.col(f"`{_ID}`").isNotNull()).select(f"`{_ID}`"))
    same = F.col(doc_id) == F.col(f"`{_ID}`")
    out = docs.join(_sent(gone.unionByName(twice), max_broadcast), same, "left_anti")
    if not twice.isEmpty():
        rest = docs.join(_sent(twice, max_broadcast), same, "left_semi").join(_sent(gone, max_broadcast), same, "left_anti")
        out = out.unionByName(rest.withColumn(_TH, F.xxhash64(text)).dropDuplicates([doc_id, _TH]).select(*docs.columns))
    return out


def _sent(ids: DataFrame, most: int) -> DataFrame:
    """The ids, to be sent to all tasks if they are at most so many, and joined with a shuffle otherwise."""
    return F.broadcast(ids) if ids.count() <= most else ids


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
