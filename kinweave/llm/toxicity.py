"""Toxicity by a weighted lexicon.

Texts are folded (lower case, accents and homoglyphs to Latin letters, digits
and signs that stand for letters to those letters, invisible characters gone)
and scanned once by an Aho-Corasick automaton of lexicon words and exception
phrases.  A match counts if it is a whole word and lies in no exception
phrase.  Weighted matches, normalised by length, make the features of a
logistic model.

Training uses a bounded sample of the labelled documents outside the held-out
fold (``max_sample``, in hash order of their ids).  Lexicon words are the
seeds below and words of the sample that mark toxic documents; a word's
support counts different documents only, so copies of one text do not make a
lexicon.  Every word with a support of ``min_support`` toxic documents and a
share of ``min_share`` is kept; a sample with fewer toxic documents than
``min_support`` teaches no word beside the seeds.  Weights are smoothed log odds.

Defined results: a null or empty text has no matches and gets the score of its
empty features; very long texts are scanned whole, in one pass; without labels of both kinds the seeds weigh alike and the
model is fixed; equal texts have equal scores; repeated rows are scored alike;
neither ids nor other columns enter a score; other columns pass through, and
one that bears a result's name is replaced by the result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import textvec as tv
from kinweave.llm.common import table

#: Words that insult people, in four languages.
SEEDS = (
    "arschloch asshole bastard bitch clown connard crap cretin cretino degenerate disgusting dumb dumbass estupido fool"
    " freak garbage gilipollas idiot idiota idiote imbecile imbecil jerk kretin loser lowlife maricon moron pathetic"
    " pendejo pig puta putain retard salope scum scumbag slut stupid stupide trash trottel useless vermin whore worthless"
).split()
#: Phrases in which such a word insults nobody.
EXCEPTIONS = (
    "circus clown", "class clown", "clown car", "clown fish", "garbage bag", "garbage bin", "garbage can", "garbage collection",
    "garbage collector", "garbage truck", "guinea pig", "pig iron", "piggy bank", "pond scum", "rodeo clown", "trash bag",
    "trash bin", "trash can", "trash collection",
)
#: Letters of other scripts that look like Latin ones.
_LOOKS_LIKE = dict(zip("аеорсухіѕјԁһԛԝвкмнтαβεικνορτυχγω", "aeopcyxisjdhqwbkmhtabeiknoptuxyw", strict=True))
#: Digits and signs used as letters.
_STANDS_FOR = dict(zip("0134578@$€", "oieastbase", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"


def _fold_table() -> dict[int, str | None]:
    """Code point to folded letters: by compatibility decomposition for Latin, full-width and mathematical letters."""
    table_: dict[int, str | None] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x24B6, 0x24EA)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain and plain != chr(code) and plain.isascii():
            table_[code] = plain
    table_ |= {code: None for code in range(0x300, 0x370)} | {ord(c): None for c in _INVISIBLE}
    table_ |= {ord(k): v for k, v in _LOOKS_LIKE.items()} | {ord(k): v for k, v in _STANDS_FOR.items()}
    # l, I and 1 are written for one another
    return {k: v and v.translate(_STAND).replace("l", "i") for k, v in table_.items()} | {ord("l"): "i"}


_STAND = str.maketrans(_STANDS_FOR)
_FOLD = _fold_table()
_INNER_MARK = re.compile(r"(?<=[a-z0-9])[!|](?=[a-z0-9])")


def fold(text: str) -> str:
    text = text.lower()
    if "!" in text or "|" in text:
        text = _INNER_MARK.sub("i", text)
    return text.translate(_FOLD)


class Lexicon:
    """Folded words with weights, exception phrases, and the logistic model over their matches."""

    def __init__(self, weights: dict[str, float], coefficients=(-4.0, 2.0, 1.0)):
        self.weights, self.coefficients = dict(weights), np.asarray(coefficients, float)
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.coefficients

    def __setstate__(self, state):
        self.weights, self.coefficients = state
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for word, w in self.weights.items():
                a.add_word(word, (len(word), w))
            for phrase in EXCEPTIONS:
                a.add_word(fold(phrase), (len(phrase), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the whole-word matches outside exception phrases, in folded text."""
        hits, spared = [], []
        if not self.weights:
            return []
        n = len(text)
        for last, (size, w) in self.automaton().iter(text):
            start, end = last - size + 1, last + 1
            if (start == 0 or not text[start - 1].isalnum()) and (end == n or not text[end].isalnum()):
                (spared if w is None else hits).append((start, end, w))
        if not spared:
            return hits
        # phrases in order of their starts, with the furthest end so far
        spared.sort()
        starts, ends = [s for s, *_ in spared], list(accumulate((e for _, e, _ in spared), max))
        return [h for h in hits if not (i := bisect_right(starts, h[0])) or ends[i - 1] < h[1]]

    def features(self, texts, n_words: np.ndarray) -> np.ndarray:
        mass = np.array([sum(w for *_, w in self.matches(fold(t))) for t in texts], float)
        return np.stack([np.ones(len(mass)), np.log1p(np.maximum(mass, 0)), np.log1p(100 * np.maximum(mass, 0) / (n_words + 20))], 1)

    def score(self, texts, n_words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts, n_words) @ self.coefficients, -30, 30)))


def words_per_text(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64)] + [tv.count_in(b.runs(tv.SPACE)[2], b.n) for b in tv.blocks(column)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression (the first column, the intercept, is free)."""
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def sample_of(docs: DataFrame, labels: DataFrame, max_sample: int, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, toxic) of at most ``max_sample`` labelled documents, the first by hash of their ids."""
    picked = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64(doc_id), doc_id).limit(max_sample)
    return docs.select(doc_id, text).join(F.broadcast(picked), doc_id).select(F.col(text).alias("text"), "toxic")


def train(docs: DataFrame, labels: DataFrame, max_sample: int = 40_000, min_support: int = 6, min_share: float = 0.8, **columns) -> Lexicon:
    """A lexicon from the labelled documents; ``labels`` must not hold held-out rows."""
    sample = sample_of(docs, labels, max_sample, **columns)

    def words(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                own = batch.slice(i, 500)
                word, mark, toxic = [], [], []
                for t, y in zip(tv.strings(own.column(0)).to_pylist(), own.column(1).to_pylist(), strict=True):
                    each = re.findall(r"[^\W\d_]{3,}", fold(t))
                    found = set(each)
                    if found:
                        # copies and near copies of a text mostly share the word triple of least hash
                        least = min(xxhash.xxh64_intdigest(" ".join(each[k : k + 3])) for k in range(max(1, len(each) - 2))) - 2**63
                        word += found
                        mark += [least] * len(found)
                        toxic += [y] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(mark, pa.int64()), pa.array(toxic, pa.int32())], names=["word", "mark", "toxic"])

    found = sample.mapInArrow(words, "word string, mark long, toxic int")
    each = found.groupBy("word", "mark").agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"))
    each = each.groupBy("word").agg(F.sum("toxic").alias("support"), F.count("*").alias("of"), F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    seeds = sorted({fold(w) for w in SEEDS})
    good = F.col("word").isin(seeds) | ((F.col("support") >= min_support) & (F.col("support") >= min_share * F.col("of")) & (F.col("n_toxic") >= min_share * F.col("n")))
    rows = each.filter(good).orderBy(F.desc("support"), "word").collect()  # the sample bounds them
    totals = sample.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in totals}
    weights = dict.fromkeys(seeds, 1.0)
    if not (n.get(0) and n.get(1)):
        return Lexicon(weights)
    prior = np.log(n[1] / n[0])
    for r in rows:
        odds = np.log((r.n_toxic + 0.5) / (r.n - r.n_toxic + 0.5)) - prior
        weights[r.word] = float(np.clip(odds / 3, 0.0, 3.0))
    lexicon = Lexicon({w: x for w, x in weights.items() if x > 0})

    def features(batches):
        for batch in batches:
            x = lexicon.features(tv.strings(batch.column(0)).to_pylist(), words_per_text(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column(1)], names=["a", "b", "toxic"])

    rows = sample.mapInArrow(features, "a double, b double, toxic int").toArrow()  # max_sample rows at most
    a, b, y = (rows.column(i).to_numpy().astype(float) for i in range(3))
    order = np.lexsort((y, b, a))  # sums in one order: reruns agree to the last digit
    a, b, y = a[order], b[order], y[order]
    lexicon.coefficients = fit_logistic(np.stack([np.ones(len(a)), a, b], 1), y)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``n_matches`` added (or replaced)."""
    names = [c for c in docs.columns if c.lower() not in ("score", "n_matches")]
    at = names.index(text)
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = rows.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("n_matches")).schema
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        own = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = tv.strings(part.column(at))
                n_words, mass, count = words_per_text(texts), [], []
                for t in texts.to_pylist():
                    found = own.matches(fold(t))
                    mass.append(sum(w for *_, w in found))
                    count.append(len(found))
                mass = np.maximum(np.array(mass, float), 0)
                x = np.stack([np.ones(len(mass)), np.log1p(mass), np.log1p(100 * mass / (n_words + 20))], 1)
                y = 1 / (1 + np.exp(-np.clip(x @ own.coefficients, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y), pa.array(count, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = train(docs, table(spark, sf_dir, "labels").filter(fold_of() != 0))
    out = score(docs, lexicon)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_matches")
