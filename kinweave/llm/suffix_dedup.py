"""Exact substring dedup: remove every byte of a 400-byte string that starts anywhere else.

Which strings can repeat.  Each window of 400 bytes is assigned to the 32-byte
gram of least hash inside it (its anchor); equal windows have equal anchors at
equal offsets.  The windows of one anchor occurrence are a segment, about 120
starts long.  Anchors that occur once cannot hold a repeat and are dropped
after a count; equal segments become one segment with a multiplicity, so that
copies are pre-aggregated before anything is dealt by content.

Which strings do repeat.  All segments that are left are dealt by anchor to
logarithmic families of suffix arrays.  A batch of segments gets a suffix
array: its window starts in the order of their first 400 bytes, eight bytes
compared at a time, neighbours that agree in all of them being repeats.  The
batch is then scanned against the levels of the family, from long match to
long match, and what is new becomes the newest level; levels of about equal
size are merged, so there are logarithmically many and every suffix is moved
logarithmically often.  Segments arrive in order of their anchors, and a family
ends with an anchor once it holds a few MB, so memory does not grow with the
input of a task.

A passage that very many documents share has as many different edges, all of
one anchor.  Anchors of more than 1/2000 of all different segments (at most
2,000 anchors) are not dealt whole: fingerprints of their windows are dealt by
range instead, in packs, and each range counts its own.  Joins on anchors and
segments spread the frequent ones likewise.

Defined results: a null or empty text has no bytes and no spans; texts under
400 bytes lose nothing, and very long ones are cut up like others, whole;
matches overlap freely and are judged on the input; rows that repeat an id and
text are separate texts, so both lose what they share; other columns pass
through, and one that bears a result's name is replaced by the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import textvec as tv
from kinweave.llm.common import join_spread, stored, table

LENGTH, GRAM = 400, 32
SHARE = 2000  # an anchor of more than 1/SHARE of all different segments is dealt window by window
_LIMIT = 1 << 20
_FAMILY = 4 << 20
_LOW28 = np.uint64((1 << 28) - 1)


def segments(block: tv.Block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text index, anchor, segment hash, low, high): the window starts low..high of a text that share an anchor."""
    none = np.zeros(0, np.int64)
    nothing = none, none.astype(np.uint64), none.astype(np.uint64), none, none
    m, span = len(block.buf) - gram + 1, length - gram + 1
    if m < span:
        return nothing
    sums = block.sums()
    h = tv.mix((sums[gram:] - sums[:-gram]) * tv.powers(m, True))
    # least (hash, place) of every ``span`` grams: prefix minima of one stretch and suffix minima of the one before
    rows = -(-m // span)
    code = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    code[:m] = h & ~_LOW28 | np.arange(m, dtype=np.uint64)
    code = code.reshape(rows, span)
    before = np.minimum.accumulate(code, 1).ravel()
    after = np.minimum.accumulate(code[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[: m - span + 1], before[span - 1 : m])
    anchor = (least & _LOW28).astype(np.int64)
    owner = np.repeat(np.arange(block.n), np.diff(block.off))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= block.off[1:][owner])
    if not len(start):
        return nothing
    anchor, owner = anchor[start], owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    low, high, owner = start[first], start[np.append(first[1:], len(start)) - 1], owner[first]
    return owner, h[anchor[first]], block.hashes(low, high + length, sums), low - block.off[owner], high - block.off[owner]


class SuffixArray:
    """Starts in a text, in the order of the ``length`` bytes from each, without repeats; ``number`` names them outside."""

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length = text, length
        self.last = -(-length // 8) - 1  # words of eight bytes; of the last one only the first bytes count
        self.rest = np.uint64(8 * (8 * (self.last + 1) - length))
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        #: the eight bytes from each place, as numbers that compare as the bytes do
        self.words = np.array(np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(text) + 1,), (1,))).byteswap(True)
        self.at = self.number = np.zeros(0, np.int64)

    def word(self, at: np.ndarray, k) -> np.ndarray:
        """The k-th word of each suffix."""
        w = self.words.take(at + 8 * k)
        if self.rest:
            w = np.where(k == self.last, w >> self.rest, w)
        return w

    def agree(self, at: np.ndarray, other: SuffixArray, there: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The common prefix, in whole words, of suffixes here and there that agree in the first k."""
        k = k.copy()
        open_ = np.flatnonzero(k <= self.last)
        x, y, j = at[open_], there[open_], k[open_]
        while len(open_):
            same = np.flatnonzero(self.word(x, j) == other.word(y, j))
            open_, x, y, j = open_[same], x[same], y[same], j[same] + 1
            k[open_] = j
            if len(j) and j.max() > self.last:
                same = np.flatnonzero(j <= self.last)
                open_, x, y, j = open_[same], x[same], y[same], j[same]
        return k

    def sort(self, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take over the starts; (numbers of repeats left out, numbers of those that stand for them)."""
        first = self.word(at, 0)
        order = np.argsort(first)
        first = first[order]
        new = np.concatenate([[True], first[1:] != first[:-1]])[: len(at)]
        alike = np.zeros(len(at), bool)  # like the one before in all words
        idx, group, k = _ties(new, np.ones(len(at), np.int64), self.last)
        while len(idx):
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(start, len(idx)))
            common = self.agree(at[order[idx]], self, np.repeat(at[order[idx[start]]], size), k)
            k = np.repeat(np.minimum.reduceat(common, start), size)
            whole = k > self.last
            alike[np.setdiff1d(idx[whole], idx[start], assume_unique=True)] = True
            idx, group, k = idx[~whole], group[~whole], k[~whole]
            w = self.word(at[order[idx]], k)
            o = np.lexsort((w, group))
            order[idx], w = order[idx[o]], w[o]
            new = np.ones(len(idx), bool)
            new[1:] = (group[1:] != group[:-1]) | (w[1:] != w[:-1])
            k += 1
            alike[idx[~new & (k > self.last)]] = True
            tied, group, k = _ties(new, k, self.last)
            idx = idx[tied]
        head = np.flatnonzero(~alike)
        self.at, self.number, self.first = at[order[head]], number[order[head]], first[head]
        return number[order[alike]], np.repeat(self.number, np.diff(np.append(head, len(at))) - 1)

    def find(self, batch: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of a sorted batch: the number of the one here that matches in all bytes, else -1, and its place in this order."""
        low, high = (np.searchsorted(self.first, batch.first, side) for side in ("left", "right"))
        found, place = np.full(len(low), -1), low.copy()
        open_ = np.flatnonzero(high > low)
        low, high, k = low[open_], high[open_], 1
        while len(open_):
            one = high - low == 1
            if one.any():
                at, there, own = self.at[low[one]], batch.at[open_[one]], open_[one]
                n = self.agree(at, batch, there, np.full(len(own), k))
                whole = n > self.last
                found[own[whole]] = self.number[low[one][whole]]
                own, at, there, n = own[~whole], at[~whole], there[~whole], n[~whole]
                place[own] = low[one][~whole] + (self.word(at, n) < batch.word(there, n))
                open_, low, high = open_[~one], low[~one], high[~one]
            w = batch.word(batch.at[open_], k)
            low, high = self._bound(low, high, w, k, False), self._bound(low, high, w, k, True)
            place[open_] = low
            go = high > low
            open_, low, high, k = open_[go], low[go], high[go], k + 1
        return found, place

    def _bound(self, low: np.ndarray, high: np.ndarray, w: np.ndarray, k: int, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (go := low < high).any():
            middle = (low + high) // 2
            own = self.word(self.at.take(middle, mode="clip"), k)
            up = go & ((own <= w) if right else (own < w))
            low, high = np.where(up, middle + 1, low), np.where(go & ~up, middle, high)
        return low

    def merged(self, other: SuffixArray, place: np.ndarray) -> SuffixArray:
        """This one with the suffixes of another, whose places here are known."""
        out = SuffixArray.__new__(SuffixArray)
        out.length, out.last, out.rest = self.length, self.last, self.rest
        size = len(self.text)
        out.text, out.words = np.concatenate([self.text, other.text]), np.concatenate([self.words[:size], other.words])
        out.at, out.number, out.first = np.insert(self.at, place, other.at + size), np.insert(self.number, place, other.number), np.insert(self.first, place, other.first)
        return out


def _ties(new: np.ndarray, k: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, group, words compared) of the elements that are alike so far and have words left."""
    tied = ~new
    tied[:-1] |= ~new[1:]
    idx = np.flatnonzero(tied & (k <= last))
    return idx, np.cumsum(new)[idx], k[idx]


class IndexFamily:
    """Levels of suffix arrays whose sizes at least double from the newest to the oldest."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels, self.repeat, self.n_bytes = length, [], np.zeros(0, bool), 0

    def add(self, block: tv.Block) -> None:
        """Index the windows of a batch of segments and mark all that repeat."""
        starts = np.maximum(np.diff(block.off) - self.length + 1, 0)
        total, before = int(starts.sum()), len(self.repeat)
        at = np.arange(total) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(block.off[:-1], starts)
        self.repeat = np.concatenate([self.repeat, np.zeros(total, bool)])
        self.n_bytes += len(block.buf)
        batch = SuffixArray(block.buf, self.length)
        for pair in batch.sort(at, np.arange(before, before + total)):
            self.repeat[pair] = True
        for level in self.levels:
            known, _ = level.find(batch)
            old = known >= 0
            self.repeat[known[old]] = True
            self.repeat[batch.number[old]] = True
            batch.at, batch.number, batch.first = batch.at[~old], batch.number[~old], batch.first[~old]
        while self.levels and len(self.levels[-1].at) <= 2 * len(batch.at):
            level = self.levels.pop()
            batch = level.merged(batch, level.find(batch)[1])
        self.levels.append(batch)


def _runs(repeat: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[False], repeat, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1 + length).tolist()


_FOUND = "anchor long, seg long, n long, first array<int>, last array<int>"
_SPANS = pa.list_(pa.int32())


def _found(rows: list) -> pa.RecordBatch:
    anchor, seg, n, first, last = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(seg, pa.int64()), pa.array(n, pa.int64()), pa.array(first, _SPANS), pa.array(last, _SPANS)], names=["anchor", "seg", "n", "first", "last"])


def _index(length: int, family_bytes: int):
    """Rows (grp, anchor, seg, n, part) in order of grp, the anchor, are segments; those without anchor are packs of a range."""

    def answered(family, names):
        at, out = 0, []
        for anchor, seg, n, size in names:
            repeat = family.repeat[at : at + size]
            at += size
            first, last = _runs(repeat | (n > 1), length)
            if first:
                out.append((anchor, seg, n, first, last))
        return out

    def run(batches):
        family, names, packs, grp = IndexFamily(length), [], [], None
        for batch in batches:
            packed = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(packed).tolist():
                if packs and batch.column(0)[i].as_py() != grp:
                    yield from _counted(packs, length)
                    packs = []
                grp = batch.column(0)[i].as_py()
                packs.append(batch.column(4)[i].as_py())
            rows = batch.filter(pa.array(~packed))
            anchors = rows.column(1).to_numpy(zero_copy_only=False)
            keys = [rows.column(i).to_pylist() for i in (1, 2, 3)]
            for block in tv.blocks(_as_text(rows.column(4)), _LIMIT):
                if names and family.n_bytes >= family_bytes and anchors[block.first] != names[-1][0]:
                    if out := answered(family, names):
                        yield _found(out)
                    family, names = IndexFamily(length), []
                own = slice(block.first, block.first + block.n)
                size = np.maximum(np.diff(block.off) - length + 1, 0).tolist()
                names += zip(*(k[own] for k in keys), size, strict=True)
                family.add(block)
        if packs:
            yield from _counted(packs, length)
        if out := answered(family, names):
            yield _found(out)

    return run


def _as_text(column: pa.Array) -> pa.Array:
    """A binary column viewed as strings; the bytes may cut a character."""
    valid, offsets, data = column.buffers()
    return pa.Array.from_buffers(pa.string(), len(column), [valid, offsets, data], offset=column.offset)


_WINDOW = np.dtype([("key", "<u8"), ("proof", "<u8"), ("piece", "<u4"), ("start", "<u4")])
_PIECE = np.dtype([("anchor", "<i8"), ("seg", "<i8"), ("n", "<i8")])


def _packs(pieces: list, length: int, bits: int):
    """(range, pack) of the windows of some segments (bytes, anchor, seg, n): fingerprints in order, and whose they are."""
    for block in tv.blocks(_as_text(pa.array([p[0] for p in pieces], pa.binary())), _LIMIT):
        starts = np.diff(block.off) - length + 1
        piece = np.repeat(np.arange(block.n), starts)
        start = np.arange(len(piece)) - np.repeat(np.cumsum(starts) - starts, starts)
        at, sums = start + block.off[:-1][piece], block.sums()
        window = np.empty(len(piece), _WINDOW)
        window["key"], window["piece"], window["start"] = block.hashes(at, at + length, sums), piece, start
        window["proof"] = tv.mix(block.hashes(at, at + length // 2, sums) + np.uint64(1))
        window = window[np.argsort(window["key"], kind="stable")]
        bound = np.searchsorted(window["key"] >> np.uint64(63 - bits) >> np.uint64(1), np.arange((1 << bits) + 1))
        names = np.array([p[1:] for p in pieces[block.first : block.first + block.n]], np.int64).view(_PIECE).ravel()
        for r in np.flatnonzero(np.diff(bound)).tolist():
            own = window[bound[r] : bound[r + 1]].copy()
            used, own["piece"] = np.unique(own["piece"], return_inverse=True)
            yield r, len(used).to_bytes(8, "little") + names[used].tobytes() + own.tobytes()


def _counted(packs: list[bytes], length: int):
    """The repeated windows of one range."""
    names, windows, n = [], [], 0
    for raw in packs:
        size = int.from_bytes(raw[:8], "little")
        names.append(np.frombuffer(raw, _PIECE, size, 8))
        own = np.frombuffer(raw, _WINDOW, offset=8 + size * _PIECE.itemsize).copy()
        own["piece"] += n
        windows.append(own)
        n += size
    name, window = np.concatenate(names), np.concatenate(windows)
    order = np.lexsort((window["proof"], window["key"]))
    key, proof, many = window["key"][order], window["proof"][order], name["n"][window["piece"][order]] > 1
    same = (key[1:] == key[:-1]) & (proof[1:] == proof[:-1])
    many[1:] |= same
    many[:-1] |= same
    hit = window[order[many]]
    hit = hit[np.lexsort((hit["start"], hit["piece"]))]
    if len(hit):
        piece, first = np.unique(hit["piece"], return_index=True)
        starts = [x.astype(np.int64) for x in np.split(hit["start"], first[1:])]
        yield _found([(*name[p].tolist(), x.tolist(), (x + length).tolist()) for p, x in zip(piece, starts, strict=True)])


def repeated_spans(rows: DataFrame, length: int = LENGTH, share: int = SHARE, least: int = 64, family_bytes: int = _FAMILY) -> DataFrame:
    """(k, th, spans): for each text that repeats something, unmerged spans of its bytes; ``rows`` as of :func:`_keyed`.

    Anchors of more than 1/``share`` of all different segments, and more than ``least``, are dealt window by window.
    """

    def cut_up(batches):
        for batch in batches:
            for block in tv.blocks(batch.column(2), _LIMIT):
                owner, anchor, seg, low, high = segments(block, length)
                if len(owner):
                    at = pa.array(owner + block.first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(low << 32 | high)], names=["k", "th", "anchor", "seg", "at"])

    s = stored(rows.select("k", "th", "t").mapInArrow(cut_up, "k long, th long, anchor long, seg long, at long"))
    again = stored(s.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    s = stored(join_spread(s, again, ["anchor"], ["k", "at"]).select(*s.columns))
    g = stored(s.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("k", "th", "at")).alias("rep")))
    most = max(least, g.count() // share)
    heavy = g.groupBy("anchor").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > most).select("anchor", F.lit(True).alias("heavy"))
    g = g.join(F.broadcast(heavy), "anchor", "left")  # at most ``share`` anchors
    n_heavy = g.filter("heavy").agg(F.sum(F.col("rep.at").bitwiseAND(F.lit(0xFFFFFFFF)) - F.shiftright("rep.at", 32) + 1)).first()[0] or 0
    # ranges of some 2**14 windows, while they are few, and of 2**20 at most
    bits = max(min((n_heavy >> 14).bit_length(), 12), (n_heavy >> 20).bit_length())
    wanted = g.select("rep.k", "rep.th", F.struct("anchor", "seg", "n", "rep.at", "heavy").alias("piece")).groupBy("k", "th").agg(F.collect_list("piece").alias("pieces"))
    # all columns go on, so that this shuffle of the texts is the one that the result is joined from
    texts = rows.join(wanted, ["k", "th"]).select("t", "pieces", *(c for c in rows.columns if c != "t"))

    def fetch(batches):
        def parts(rows, packs):
            names = ["grp", "anchor", "seg", "n", "part"]
            own = [[x[i] for x in rows] for i in range(4)]
            none = [None] * len(packs)
            arrays = [pa.array(own[i] + x, t) for i, x, t in zip((1, 1, 2, 3, 0), ([r for r, _ in packs], none, none, none, [p for _, p in packs]), (pa.int64(),) * 4 + (pa.binary(),), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            plain, heavy, size = [], [], 0
            for t, pieces in zip(tv.strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                raw = t.as_buffer()
                for p in pieces:
                    low, high = p["at"] >> 32, p["at"] & 0xFFFFFFFF
                    (heavy if p["heavy"] else plain).append((raw[low : high + length].to_pybytes(), p["anchor"], p["seg"], p["n"]))
                    size += high + length - low
                if size >= 4 * _LIMIT:
                    yield parts(plain, list(_packs(heavy, length, bits)))
                    plain, heavy, size = [], [], 0
            if size:
                yield parts(plain, list(_packs(heavy, length, bits)))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(fetch, "grp long, anchor long, seg long, n long, part binary").repartition(n, "grp").sortWithinPartitions("grp")
    found = dealt.mapInArrow(_index(length, family_bytes), _FOUND)
    found = stored(found.groupBy("anchor", "seg", "n").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last")))
    low = F.shiftright("at", 32)
    spans = F.zip_with("first", "last", lambda x, y: F.struct((low + x).cast("int").alias("a"), (low + y).cast("int").alias("b")))
    back = join_spread(s, found, ["anchor", "seg"], ["k", "at"]).select("k", "th", spans.alias("spans"))
    return back.groupBy("k", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _keyed(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    """(k, th, t, ...): hashes that name a row by its id and its text, and the text."""
    return docs.select(F.xxhash64(F.col(doc_id)).alias("k"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t"), *more)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (start and end of each removed run), and ``kept_bytes`` added (or replaced).

    ``options`` are those of :func:`repeated_spans`.
    """
    added = ("n_bytes", "removed", "kept_bytes")
    old = [c for c in docs.columns if c.lower() not in added]
    rows = _keyed(docs, doc_id, text, F.struct(*(F.col(f"`{c}`") for c in old if c != text)).alias("row")) if len(old) > 1 else _keyed(docs, doc_id, text)
    spans = repeated_spans(rows, length, **options)
    rows = rows.join(spans, ["k", "th"], "left")
    has_row = "row" in rows.columns
    rows = rows.select("t", "spans", *(["row"] if has_row else []))
    schema = rows.select(*(["row"] if has_row else []), "t", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<a:int,b:int>>").alias("removed"), F.lit(None).cast("binary").alias("kept_bytes")).schema
    for f in schema:
        f.nullable = True
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def cut_out(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own = batch.slice(i, 256)
                n, removed, kept = [], [], []
                for t, spans in zip(tv.strings(own.column(0)), own.column(1), strict=True):
                    raw = t.as_buffer()
                    n.append(len(raw))
                    merged = merge_spans(spans)
                    removed.append([{"a": a, "b": b} for a, b in merged])
                    edge = [0, *(x for ab in merged for x in ab), len(raw)]
                    kept.append(b"".join(raw[x:y].to_pybytes() for x, y in zip(edge[::2], edge[1::2], strict=True)))
                rest = [own.column(2)] if has_row else []
                yield pa.RecordBatch.from_arrays([*rest, own.column(0), pa.array(n, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=schema.names)

    out = rows.mapInArrow(cut_out, schema)
    return out.select(*(F.col("t").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in old), *added)


def merge_spans(spans) -> list[tuple[int, int]]:
    """Overlapping or touching spans as maximal runs."""
    if not spans.is_valid:
        return []
    flat = spans.values
    a, b = flat.field("a").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of all windows, for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["b"] - r["a"]))
    return drop_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )
