"""Encoders and pair scorers that are trained here: hashed character grams, numpy, no outside models.

:class:`Encoder` embeds a text as the mean of learned vectors of its hashed
words and character 3-grams; it is trained by a symmetric contrastive loss over
batches of one country.  :class:`PairScorer` is a logistic model over hashed
words that two texts share or that one has alone; it is trained on hard
negatives.  Training takes a bounded number of pairs (``max_pairs``, in hash
order) on the driver, both models have a fixed size whatever the corpus, and
they are applied partition by partition, batches sorted by length.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH = 2048


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def _hash(x: str, size: int) -> int:
    return zlib.crc32(x.encode()) % size


@lru_cache(maxsize=200_000)
def _word_grams(w: str, size: int) -> frozenset[int]:
    return frozenset(_hash(x, size) for x in (w, *(f"#{w}#"[i : i + 3] for i in range(len(w)))))


def grams(text: str, size: int) -> np.ndarray:
    """The hashed words and character 3-grams of a text (one feature at least); those of a word are remembered."""
    found = set().union(*(_word_grams(w, size) for w in set(_words(text))))
    return np.array(sorted(found) or [0])


def _by_length(texts: list[str], f) -> list:
    """``f`` of batches of texts of like length, the results in the order of the texts."""
    order = np.argsort([len(t or "") for t in texts], kind="stable")
    out: list = [None] * len(texts)
    for i in range(0, len(order), _BATCH):
        own = order[i : i + _BATCH]
        for k, x in zip(own.tolist(), f([texts[k] for k in own.tolist()]), strict=True):
            out[k] = x
    return out


class Encoder:
    """Unit vectors of texts; ``table`` holds a vector a feature."""

    def __init__(self, size: int = 1 << 14, width: int = 32, seed: int = 1):
        self.table = np.random.default_rng(seed).normal(0, 1, (size, width)).astype(np.float32)

    def _means(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts, or of their grams."""
        rows = [t if isinstance(t, np.ndarray) else grams(t, len(self.table)) for t in texts]
        n = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        start = np.cumsum(n) - n
        return np.add.reduceat(self.table[flat], start, 0) / n[:, None], flat, n

    def encode(self, texts: list[str]) -> np.ndarray:
        x = self._means(texts)[0] if len(texts) else np.zeros((0, self.table.shape[1]), np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def step(self, left: list[str], right: list[str], rate: float, scale: float) -> float:
        """One descent on the mean cross entropy of finding each text's partner in the batch, both ways."""
        sides = [self._means(x) for x in (left, right)]
        norms = [np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m, _, _ in sides]
        a, b = (m / n for (m, _, _), n in zip(sides, norms, strict=True))
        logits = scale * a @ b.T
        soft = [np.exp(x - x.max(1, keepdims=True)) for x in (logits, logits.T)]
        soft = [x / x.sum(1, keepdims=True) for x in soft]
        eye = np.eye(len(a), dtype=np.float32)
        g = scale * ((soft[0] - eye) + (soft[1] - eye).T) / (2 * len(a))
        for own, other, (_, flat, n), norm, grad in ((a, b, sides[0], norms[0], g), (b, a, sides[1], norms[1], g.T)):
            d = grad @ other
            d = (d - own * (d * own).sum(1, keepdims=True)) / norm / n[:, None]
            np.subtract.at(self.table, flat, rate * np.repeat(d, n, 0).astype(np.float32))
        return float(-(np.log(np.diag(soft[0]) + 1e-12) + np.log(np.diag(soft[1]) + 1e-12)).mean() / 2)


class PairScorer:
    """A logit for two texts, from hashed words that both have, or that one lacks."""

    def __init__(self, size: int = 1 << 14):
        self.weight, self.seen = np.zeros(size + 4), np.full(size + 4, 1e-3)

    def features(self, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.weight) - 4
        x, y = set(_words(a)), set(_words(b))
        g, h = set(grams(a, 1 << 20).tolist()), set(grams(b, 1 << 20).tolist())
        both, all_ = len(g & h), max(len(g | h), 1)
        at = [_hash(f"={w}", size) for w in x & y] + [_hash(f"-{w}", size) for w in x ^ y]
        value = [1 / max(len(x | y), 1)] * len(at)
        return np.array([*at, *range(size, size + 4)]), np.array([*value, 1.0, both / all_, len(x & y) / max(len(x | y), 1), float(x == y)])

    def logits(self, left: list[str], right: list[str]) -> np.ndarray:
        return np.array([self.weight[i] @ v for i, v in (self.features(a, b) for a, b in zip(left, right, strict=True))])

    def fit(self, left: list[str], right: list[str], label: list[float], rounds: int = 6, rate: float = 0.5, warm_up: float = 0.03, batch: int = 256, seed: int = 1) -> None:
        """Adaptive descent on the cross entropy; the rate rises over the first ``warm_up`` of the steps."""
        rows = [self.features(a, b) for a, b in zip(left, right, strict=True)]
        y = np.asarray(label, float)
        rnd, done, steps = np.random.default_rng(seed), 0, max(1, rounds * -(-len(rows) // batch))
        for _ in range(rounds):
            order = rnd.permutation(len(rows))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                done += 1
                at, value = (np.concatenate([rows[k][j] for k in own]) for j in (0, 1))
                n = np.array([len(rows[k][0]) for k in own])
                z = np.add.reduceat(self.weight[at] * value, np.cumsum(n) - n)
                g = np.bincount(at, np.repeat(1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own], n) * value / len(own), len(self.weight))
                self.seen += g * g
                self.weight -= rate * min(1.0, done / (warm_up * steps)) * g / np.sqrt(self.seen)


def _bounded(df: DataFrame, columns: list[str], most: int) -> list:
    return df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(most).collect()


def train_encoder(pairs: DataFrame, max_pairs: int = 100_000, rounds: int = 8, batch: int = 256, rate: float = 20.0, scale: float = 20.0, seed: int = 1) -> Encoder:
    """From matching texts (country, q_text, p_text), at most ``max_pairs`` of them; every batch is of one country."""
    model, rnd = Encoder(seed=seed), np.random.default_rng(seed)
    by: dict = {}
    known: dict = {}  # each distinct text is read once, not in every round
    for r in _bounded(pairs, ["country", "q_text", "p_text"], max_pairs):
        for text in (r.q_text, r.p_text):
            if text not in known:
                known[text] = grams(text, len(model.table)).astype(np.int32)
        by.setdefault(r.country, []).append((known[r.q_text], known[r.p_text]))
    del known
    for _ in range(rounds):
        lots = [own[i : i + batch] for rows in by.values() for own in [[rows[k] for k in rnd.permutation(len(rows))]] for i in range(0, len(rows), batch)]
        for k in rnd.permutation(len(lots)):
            if len(lots[k]) > 1:
                model.step(*map(list, zip(*lots[k], strict=True)), rate, scale)
    return model


def train_scorer(pairs: DataFrame, max_pairs: int = 200_000, **options) -> PairScorer:
    """From labelled texts (q_text, p_text, y), at most ``max_pairs`` of them."""
    rows = _bounded(pairs, ["q_text", "p_text", "y"], max_pairs)
    model = PairScorer()
    if rows:
        model.fit([r.q_text for r in rows], [r.p_text for r in rows], [float(r.y) for r in rows], **options)
    return model


def encode(df: DataFrame, model: Encoder, text: str = "text", out: str = "embedding") -> DataFrame:
    """The table with an embedding of each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            vectors = _by_length(batch.column(at).to_pylist(), shared.value.encode)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def scorer(model: PairScorer):
    """A :class:`~kinweave.operators.models.Scorer`: adds the logit of q_text and p_text."""

    def score(pairs: DataFrame, out: str = "score") -> DataFrame:
        shared = pairs.sparkSession.sparkContext.broadcast(model)
        at = [pairs.columns.index(c) for c in ("q_text", "p_text")]
        schema = T.StructType([*pairs.schema, T.StructField(out, T.DoubleType())])

        def run(batches):
            for batch in batches:
                left, right = (batch.column(i).to_pylist() for i in at)
                both = [f"{a}\x00{b}" for a, b in zip(left, right, strict=True)]
                logits = _by_length(both, lambda x: shared.value.logits(*zip(*(t.split("\x00", 1) for t in x), strict=True)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logits, pa.float64())], names=schema.names)

        return pairs.mapInArrow(run, schema)

    return score


def save(model: Encoder | PairScorer, spark, path: str) -> None:
    """Write a model as a table that any store can hold."""
    rows = [(type(model).__name__, name, list(x.shape), bytearray(np.ascontiguousarray(x, np.float64).tobytes())) for name, x in vars(model).items()]
    spark.createDataFrame(rows, "kind string, name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Encoder | PairScorer:
    rows = spark.read.parquet(path).collect()  # one row an array of one model
    model = object.__new__({"Encoder": Encoder, "PairScorer": PairScorer}[rows[0].kind])
    for r in rows:
        x = np.frombuffer(r.data, np.float64).reshape(r.shape).copy()
        setattr(model, r.name, x.astype(np.float32) if r.kind == "Encoder" else x)
    return model
