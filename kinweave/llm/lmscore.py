"""Cross-entropy difference of two n-gram models (Moore and Lewis 2010).

The target model is counted over the documents marked as good, the background
model over all documents.  Both are interpolated bigram models of the same
order and smoothing over one vocabulary; a document's score is the mean over
its tokens of the target loss minus the background loss, in nats, so lower
means more like the target.

Words and bigrams that occur at least ``least`` times in the background enter
the models, at any corpus size; all other words are the unknown word.

No model is gathered or sent: what is known of the n-grams grows with the
input and stays distributed.  The scored documents are dealt into blocks of a
few MB by a hash of their rows.  A block sends its distinct words and bigrams,
sorted, delta-coded and with its own counts, to the tasks of their hash
ranges; a range adds up what all blocks sent and answers each of them with the
sums, in the order it asked; a block meets its answers and scores its texts.
A frequent word arrives once per block.  Only five sums over the vocabulary
reach the driver.  Documents that are not their own background are asked for
without counts, and the background's counts are sent beside them.

Defined results: tokens are runs of letters and digits, lower-cased; a null or
empty text has no tokens and the score 0; without any target document the
target model is uniform; repeated rows are counted as often as they stand
there; very long texts are taken whole; documents with a null id are counted
and scored as background; rows equal in all columns share a block; other
columns pass through, and one that bears a result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import textvec as tv
from kinweave.llm.common import table

LEAST = 2  # occurrences of a word or bigram of the models
LAMBDA = 0.6  # share of the bigram estimate
ALPHA = 0.5  # added to every word's count
_FLUSH = 1_500_000
_BLOCK_BYTES = 8 << 20  # of text in a block, at most, on average
_LEAST_BYTES = 64 << 10  # and at least
_BIGRAM = np.uint64(0x94D049BB133111EB)


def _tokens(block: tv.Block) -> tuple[np.ndarray, np.ndarray]:
    start, end, text = block.runs(tv.NOT_ALNUM)
    return block.hashes(start, end) | np.uint64(1), text  # words are odd, bigrams even


def _bigrams(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the second word)."""
    second = np.flatnonzero(text[1:] == text[:-1]) + 1
    return tv.mix(word[second - 1] * _BIGRAM + word[second]) & ~np.uint64(1), second


def _packed(key: np.ndarray, good: np.ndarray, bits: int, counted: bool = True):
    """(range, bytes): the distinct keys of each hash range with their counts in all and in good texts, or with 0."""
    order = np.argsort(key)
    key, good = key[order], good[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    all_n = np.diff(np.append(at, len(key))).astype(np.uint32)
    good_n = np.add.reduceat(good.astype(np.uint32), at).astype(np.uint32)
    if not counted:
        all_n[:], good_n[:] = 0, 0
    key = key[at]
    bounds = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
    for r in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[r], bounds[r + 1])
        step = np.diff(key[own], prepend=np.uint64(0))
        # bytes of equal weight stand together, so that the shuffle's compression sees the zeros
        planes = [x.view(np.uint8).reshape(len(step), -1).T.tobytes() for x in (step, all_n[own], good_n[own])]
        yield int(r), b"".join(planes)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 16
    plane = np.frombuffer(raw, np.uint8)
    turn = lambda x, width, kind: np.ascontiguousarray(x.reshape(width, n).T).view(kind).ravel()
    return np.cumsum(turn(plane[: 8 * n], 8, np.uint64), dtype=np.uint64), turn(plane[8 * n : 12 * n], 4, np.uint32), turn(plane[12 * n :], 4, np.uint32)


def _n_blocks(docs: DataFrame, text: str) -> int:
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-total // _BLOCK_BYTES), min(2 * parts, total // _LEAST_BYTES))


def _keys(texts: pa.Array, flag: np.ndarray, pairs: bool = True):
    """(key, good) of the words, and of the bigrams, of each part of the texts."""
    for block in tv.blocks(pc.utf8_lower(tv.strings(texts))):
        word, owner = _tokens(block)
        own = flag[block.first : block.first + block.n]
        yield word, own[owner]
        if pairs:
            pair, second = _bigrams(word, owner)
            yield pair, own[owner[second]]


def _flags(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int8()).to_numpy(zero_copy_only=False).astype(bool)


def _count_packs(docs: DataFrame, bits: int, pairs: bool) -> DataFrame:
    """(block, range, pack) of the texts of (text, good), some million keys at a time; block -1 wants no answer."""

    def count(batches):
        keys, marks, n = [], [], 0

        def flush():
            out = list(_packed(np.concatenate(keys), np.concatenate(marks), bits))
            keys.clear()
            marks.clear()
            return pa.RecordBatch.from_arrays([pa.array([-1] * len(out), pa.int64()), pa.array([r for r, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["block", "range", "pack"])

        for batch in batches:
            for key, good in _keys(batch.column(0), _flags(batch.column(1)), pairs):
                keys.append(key)
                marks.append(good)
                n += len(key)
                if n >= _FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return docs.mapInArrow(count, "block long, range int, pack binary")


def _word_sums(docs: DataFrame, bits: int, least: int) -> tuple:
    """Over all words: how many are in the vocabulary, their occurrences in all and in good texts, and those of all words."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for pack in batch.column("pack"):
                own = _unpacked(pack.as_py())
                total = own if total is None else _added(total, own)
        if total is not None:
            _, n, g = total
            keep = n >= least
            sums = [int(x.sum(dtype=np.int64)) for x in (keep, n[keep], g[keep], n, g)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["words", "kept", "kept_good", "n", "n_good"])

    sums = _count_packs(docs, bits, False).groupBy("range").applyInArrow(add, "words long, kept long, kept_good long, n long, n_good long")
    return tuple(x or 0 for x in sums.agg(*(F.sum(c) for c in sums.columns)).first())


def _added(a, b):
    key = np.concatenate([a[0], b[0]])
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[at], *(np.add.reduceat(np.concatenate([x, y])[order].astype(np.int64), at) for x, y in zip(a[1:], b[1:], strict=True)))


def _answers(packs: DataFrame, least: int) -> DataFrame:
    """(block, range, counts): for each pack of a block, the sums over all packs of its keys; 0 below ``least``."""

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = [], []
        for batch in batches:
            block += batch.column("block").to_pylist()
            own += [_unpacked(pack.as_py()) for pack in batch.column("pack")]
        _, at = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
        n, good = (np.bincount(at, np.concatenate([x[i] for x in own])).astype(np.uint64) for i in (1, 2))
        good[n < least] = 0
        n[n < least] = 0
        bound = np.cumsum([0] + [len(x[0]) for x in own])
        planes = lambda x: x.view(np.uint8).reshape(len(x), 8).T.tobytes()
        for i in range(0, len(own), 1000):
            asked = [k for k in range(i, min(i + 1000, len(own))) if block[k] >= 0]
            out = [planes(n[at[bound[k] : bound[k + 1]]]) + planes(good[at[bound[k] : bound[k + 1]]]) for k in asked]
            arrays = [pa.array([block[k] for k in asked], pa.int64()), pa.array([key[0].as_py()] * len(asked), pa.int32()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "range", "counts"])

    return packs.groupBy("range").applyInArrow(answer, "block long, range int, counts binary")


def _counts(ranges: pa.Array, packs: pa.Array) -> np.ndarray:
    """2 x keys: the answers of one block, in key order."""
    packs, out = packs.to_pylist(), []
    for k in np.argsort(ranges.to_numpy(zero_copy_only=False)):
        plane = np.frombuffer(packs[k], np.uint8).reshape(2, 8, -1)
        out.append(np.ascontiguousarray(plane.transpose(0, 2, 1)).view(np.uint64)[:, :, 0])
    return np.concatenate(out, 1).astype(np.float64) if out else np.zeros((2, 0))


class Models:
    """Both models: the documents they are counted over, and [background, target] sums over the vocabulary."""

    def __init__(self, docs: DataFrame, good: str, text: str, least: int):
        self.docs, self.good, self.text, self.least = docs, good, text, least
        self.bits = max(4, min(16, (_n_blocks(docs, text) - 1).bit_length()))
        n_words, *kept, n, n_good = _word_sums(self.counted(), self.bits, least)
        self.total = np.array([n, n_good], np.float64)
        self.unknown = np.maximum(self.total - kept, 0)
        self.size = n_words + 1

    def counted(self) -> DataFrame:
        return self.docs.select(F.col(self.text).alias("text"), F.coalesce(F.col(self.good), F.lit(False)).alias("good"))


def _losses(word: np.ndarray, pair: np.ndarray, second: np.ndarray, total: np.ndarray, unknown: np.ndarray, size: int) -> np.ndarray:
    """2 x tokens: the loss of each token under the background and the target model.

    ``word`` and ``pair`` (2 x tokens, 2 x bigrams) count them in both models; ``second`` is the place of each bigram's second word.
    """
    n = np.where(word[0] > 0, word, unknown[:, None])
    p = (n + ALPHA) / (total + ALPHA * size)[:, None]
    if len(second):
        before = n[:, second - 1]
        seen = np.divide(pair, before, out=np.zeros_like(pair), where=before > 0)
        # a context without counts leaves all the weight to the word
        share = np.where(before > 0, LAMBDA, 0.0)
        p[:, second] = share * np.minimum(seen, 1) + (1 - share) * p[:, second]
    return -np.log(p)


def train(docs: DataFrame, good: str, text: str = "text", least: int = LEAST) -> Models:
    return Models(docs, good, text, least)


def score(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``target_loss``, ``background_loss`` and ``score`` (means per token; 0 without tokens)."""
    added = ("n_tokens", "target_loss", "background_loss", "score")
    own = docs is models.docs and text == models.text  # then one pack both counts and asks
    bits, model = models.bits, (models.total, models.unknown, models.size)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        F.pmod(F.xxhash64(*hashed), F.lit(_n_blocks(docs, text))).alias("block"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        (F.coalesce(F.col(models.good), F.lit(False)) if own else F.lit(False)).alias("good"),
    )
    names = docs.columns
    at = names.index(text)

    def ask(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [x for batch in batches for x in _keys(batch.column("row").field(at), _flags(batch.column("good")))]
        if sum(len(k) for k, _ in keys):
            out = list(_packed(np.concatenate([k for k, _ in keys]), np.concatenate([g for _, g in keys]), bits, own))
            arrays = [pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array([r for r, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "range", "pack"])

    packs = rows.groupBy("block").applyInArrow(ask, "block long, range int, pack binary")
    if not own:
        packs = packs.unionByName(_count_packs(models.counted(), bits, True))
    schema = rows.select("row", F.lit(0).cast("long").alias("n_tokens"), *(F.lit(0.0).alias(c) for c in added[1:])).schema
    for f in schema:
        f.nullable = True

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.column("row").combine_chunks()
        row = pa.concat_arrays(row.chunks) if isinstance(row, pa.ChunkedArray) else row
        parts = [(b, *_tokens(b)) for b in tv.blocks(pc.utf8_lower(tv.strings(row.field(at))))]
        pairs = [_bigrams(word, owner) for _, word, owner in parts]
        key = np.concatenate([np.zeros(0, np.uint64)] + [x for (_, word, _), (pair, _) in zip(parts, pairs, strict=True) for x in (word, pair)])
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = np.diff(key[order]) != 0
        known = np.empty(len(key), np.int64)
        known[order] = np.cumsum(new) - 1
        count = _counts(right.column("range"), right.column("counts"))
        if count.shape[1] != new.sum():
            raise RuntimeError(f"{count.shape[1]} counts for {new.sum()} n-grams")
        out, i = [], 0
        for (block, word, owner), (pair, second) in zip(parts, pairs, strict=True):
            j, k = i + len(word), i + len(word) + len(pair)
            loss = _losses(count[:, known[i:j]], count[:, known[j:k]], second, *model)
            n, i = tv.count_in(owner, block.n), k
            back, target = (np.bincount(owner, x, block.n) / np.maximum(n, 1) for x in loss)
            out.append((n, target, back, target - back))
        new = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
        return pa.table([row, new[0].cast(pa.int64()), *new[1:]], names=schema.names)

    scored = rows.groupBy("block").cogroup(_answers(packs, models.least).groupBy("block")).applyInArrow(losses, schema)
    return scored.select(*(F.col("row").getField(c).alias(c) for c in names if c.lower() not in added), *added)


def with_good(docs: DataFrame, good_ids: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """``docs`` and whether their doc_id is among ``good_ids``; the ids are broadcast only if they are few."""
    ids = good_ids.select("doc_id").filter("doc_id is not null").distinct().withColumn("good", F.lit(True))
    return docs.join(F.broadcast(ids) if ids.count() <= max_broadcast else ids, "doc_id", "left")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the target is every document labelled as of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = with_good(docs, table(spark, sf_dir, "labels").filter("quality = 1"))
    return score(docs, train(docs, "good")).select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))
