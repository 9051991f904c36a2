"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a window of tokens; ignored positions may
differ.  Every window of the benchmark is hashed under each mask, every window
of the training texts is hashed the same way, and equal hashes join.  Around
each hit, the text and the item are compared token by token on the hit's
diagonal, and the best segment that tolerates substitutions decides.  An item
shorter than ``min_tokens`` tokens has no room for substitutions: its whole
token sequence is hashed and must stand in the text as it is.

The benchmark side is measured first.  Up to ``max_broadcast`` bytes of item
text are indexed at once and sent to all tasks; a larger benchmark is dealt
into blocks of about that size by a hash of its rows, and each block is held
against all texts in a pass of its own.  Texts are never shuffled, and hits
never leave the task that finds them, so a passage that a third of all
documents share costs what it occupies.

Tokens are runs of letters and digits, lower-cased.  Defined results: a null
or empty text, or an item without tokens, never matches; very long texts are
searched whole; items with equal text
all match; an item's best segment in a text is reported once (ties:
the longest, then the first); repeated rows are judged alike, row by row; other columns pass through, but
``find_leaks`` replaces one named ``leaks``, and ``drop_leaked`` keeps it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import textvec as tv
from kinweave.llm.common import add_columns, table

#: Masks (1: compared, 0: ignored).  The first takes runs of six; each other one ignores some positions inside.
MASKS = ("111111", "1101011", "11010011", "110010111", "10110101", "11101")
_TABLE_BITS = 24


@dataclass(frozen=True)
class Overlap:
    """When a segment counts: at least ``min_match`` equal tokens, or ``min_share`` of a shorter item, and never
    fewer than ``min_tokens``; equal tokens make up at least ``min_identity`` of it.  Shorter items match whole."""

    min_match: int = 12
    min_share: float = 0.7
    min_tokens: int = 8
    min_identity: float = 0.75


def tokens(block: tv.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the tokens of an already lower-cased block."""
    start, end, text = block.runs(tv.NOT_ALNUM)
    return block.hashes(start, end), text


def _seed(word: np.ndarray, mask: str, salt: int) -> np.ndarray:
    m = len(word) - len(mask) + 1
    out = np.full(m, (2 * salt + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += word[k : k + m] * np.uint64(pow(0xD1B54A32D192ED03, k + 1, 2**64))
    return out


def _seeds(word: np.ndarray, text: np.ndarray):
    """For each mask: the hashes of the windows that lie in one text, and where they start."""
    for salt, mask in enumerate(MASKS):
        if len(word) >= len(mask):
            inside = np.flatnonzero(text[: len(text) - len(mask) + 1] == text[len(mask) - 1 :])
            yield _seed(word, mask, salt), inside


def _run(word: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words."""
    return _seed(word, "1" * size, size)


class Index:
    """The hashed seeds of some benchmark items."""

    def __init__(self, ids: list, texts: list[str], rule: Overlap):
        self.ids, self.items = [], []
        seed, item, at = [], [], []
        short: dict[int, list] = {}
        for block in tv.blocks(pc.utf8_lower(pa.array(texts, pa.string()))):
            word, text = tokens(block)
            bound = np.searchsorted(text, np.arange(block.n + 1))
            for k in range(block.n):
                own = word[bound[k] : bound[k + 1]]
                if not len(own):
                    continue
                self.ids.append(ids[block.first + k])
                self.items.append(own)
                if len(own) < rule.min_tokens:
                    short.setdefault(len(own), []).append((int(_run(own, len(own))[0]), len(self.items) - 1))
                    continue
                for hashes, inside in _seeds(own, np.zeros(len(own), np.int64)):
                    seed.append(hashes[inside])
                    at.append(inside)
                    item.append(np.full(len(inside), len(self.items) - 1))
        self.seed = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int64)

        #: (length, sorted hashes of whole sequences, their items) of the items below min_tokens
        self.short = [(size, np.array([h for h, _ in x], np.uint64), np.array([i for _, i in x])) for size, x in ((n, sorted(y)) for n, y in sorted(short.items()))]

    def table(self) -> np.ndarray:
        bits = np.zeros(1 << _TABLE_BITS, bool)
        bits[self.seed >> np.uint64(64 - _TABLE_BITS)] = True
        return bits


def _segment(same: np.ndarray, min_identity: float) -> tuple[int, int, int]:
    """(matches, length, start) of the stretch with the most matches net of their share of mismatches."""
    gain = np.where(same, 1.0 - min_identity, -min_identity)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return int(same[start:end].sum()), end - start, start


def _whole(word: np.ndarray, text: np.ndarray, index: Index):
    """(text, item, where) of the first place of each short item in each text."""
    for size, hashes, items in index.short:
        if len(word) < size:
            continue
        at = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :])
        run = _run(word, size)[at]
        low, high = (np.searchsorted(hashes, run, side) for side in ("left", "right"))
        hit = np.flatnonzero(high > low)
        # of a text's places of one sequence the first
        _, first = np.unique(np.stack([text[at[hit]], low[hit]], 1), axis=0, return_index=True)
        for k in hit[first].tolist():
            for i in items[low[k] : high[k]].tolist():
                if np.array_equal(word[at[k] : at[k] + size], index.items[i]):
                    yield int(text[at[k]]), i, int(at[k])


def _leaks(block: tv.Block, index: Index, bits: np.ndarray, rule: Overlap) -> list[list]:
    out: list[list] = [[] for _ in range(block.n)]
    word, text = tokens(block)
    found = []
    for seed, inside in _seeds(word, text):
        hit = inside[bits[seed[inside] >> np.uint64(64 - _TABLE_BITS)]]
        low = np.searchsorted(index.seed, seed[hit], "left")
        many = np.searchsorted(index.seed, seed[hit], "right") - low
        hit, low, many = hit[many > 0], low[many > 0], many[many > 0]
        if len(hit):
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            hit = np.repeat(hit, many)
            found.append(np.stack([text[hit], index.item[k], hit - index.at[k]], 1))
    bound = np.searchsorted(text, np.arange(block.n + 1))
    best: dict = {(t, i): (len(index.items[i]), len(index.items[i]), int(bound[t]) - at, 0) for t, i, at in _whole(word, text, index)}
    for t, i, diagonal in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
        item = index.items[i]
        first, last = max(diagonal, int(bound[t])), min(diagonal + len(item), int(bound[t + 1]))
        same = word[first:last] == item[first - diagonal : last - diagonal]
        n, length, start = _segment(same, rule.min_identity)
        if n >= max(rule.min_tokens, min(rule.min_match, rule.min_share * len(item))):
            start += first
            got = (n, length, -(start - int(bound[t])), start - diagonal)
            if got > best.get((t, i), (0,)):
                best[t, i] = got
    for (t, i), (n, length, start, at) in sorted(best.items()):
        out[t].append({"item_id": index.ids[i], "n_match": n, "n_tokens": length, "item_tokens": len(index.items[i]), "doc_start": -start, "item_start": at})
    return out


_LEAK = "array<struct<item_id:bigint,n_match:int,n_tokens:int,item_tokens:int,doc_start:int,item_start:int>>"


def _item_blocks(items: DataFrame, max_broadcast: int):
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-n_bytes // max_broadcast) or 1
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield part.collect()  # bounded by max_broadcast


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               rule: Overlap = Overlap(), max_broadcast: int = 8 << 20) -> DataFrame:
    """``docs`` with the column ``leaks``: the benchmark items found in each text."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    columns = [c for c in docs.columns if c.lower() != "leaks"]
    row = docs.select(F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    row = row.withColumn("leaks", F.array().cast(_LEAK))
    context = docs.sparkSession.sparkContext
    for part in _item_blocks(items, max_broadcast):
        shared = context.broadcast(Index([r.item_id for r in part], [r.text for r in part], rule))

        def kernel(block, shared=shared):
            index = shared.value
            if not hasattr(index, "bits"):
                index.bits = index.table()
            return [pa.array(_leaks(block, index, index.bits, rule), _ARROW)]

        new = add_columns(row, kernel, f"more {_LEAK}", "text", lower=True)
        row = new.withColumn("leaks", F.concat("leaks", "more")).drop("more")
    return row.select(*(F.col("row").getField(c).alias(c) for c in columns), "leaks")


_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("n_match", pa.int32()), ("n_tokens", pa.int32()), ("item_tokens", pa.int32()), ("doc_start", pa.int32()), ("item_start", pa.int32())]))


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found, with all their columns."""
    row = docs.select(F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    clean = find_leaks(row, items, **options).filter(F.size("leaks") == 0)
    return clean.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
