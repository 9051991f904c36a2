"""Quality rules, line first.

Every line of a text is judged by punctuation, navigation and boilerplate
rules; failing lines are removed; a document that loses too much of its text
is rejected.  Documents with hardly any words, or made of repeated word
windows, are rejected by the base rules before that.

Defined results: a null or empty text has no words, fails the base rules and
is not kept; lines without a word are never counted as lost; equal lines are
ties broken by position (the first stays); repeated rows are judged alike,
row by row; very long texts are judged whole; other columns pass through unchanged, and a column that bears a
result's name is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import textvec as tv
from kinweave.llm.common import add_columns, table

#: Phrases that mark a short line as site boilerplate, in four languages (lower case).
BOILERPLATE = (
    "accept all cookies", "add to cart", "all rights reserved", "click here", "cookie policy",
    "enable javascript", "forgot your password", "javascript is disabled", "log in to",
    "lorem ipsum", "newsletter", "powered by", "privacy policy", "read more", "share this",
    "sign in", "sign up", "skip to content", "terms of service", "terms of use",
    "accepter les cookies", "conditions d'utilisation", "en savoir plus", "mentions légales", "politique de confidentialité", "tous droits réservés",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "jetzt anmelden", "mehr erfahren", "nutzungsbedingungen",
    "aceptar cookies", "aviso legal", "iniciar sesión", "leer más", "política de privacidad", "todos los derechos reservados",
)
#: Marks that may end a sentence.
TERMINAL = (".", "!", "?", "…", ";", ":", '"', "'", ")", "]", "”", "’", "»", "。", "！", "？")
#: Marks that separate navigation entries when they stand alone.
SEPARATORS = ("|", "»", "›", "•", "·", ">", "/")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Rules:
    """Thresholds.  ``min_words`` and ``max_repeat_percent`` make the base rules; the rest the line rules."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    short_line: int = 8
    max_symbols_per_word: float = 0.3
    max_separator_share: float = 0.15
    max_upper_share: float = 0.7
    max_exclaims_per_word: float = 0.5
    boilerplate_words: int = 25
    max_lost_share: float = 0.5


_FIELDS = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,
n_lines long, n_lines_failed long, lost_share double, kept boolean, clean_text string"""


def _ends_with(block: tv.Block, end: np.ndarray, start: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
    """Whether the span up to ``end`` ends with one of the marks."""
    found = np.zeros(len(end), bool)
    if not len(block.buf):
        return found
    for mark in marks:
        code = mark.encode()
        hit = end - start >= len(code)
        for k, byte in enumerate(reversed(code), 1):
            hit = hit & (block.buf[np.maximum(end - k, 0)] == byte)
        found |= hit
    return found


def _judge(block: tv.Block, rules: Rules) -> list:
    n, buf = block.n, block.buf
    sums = block.sums()
    start, end, text = block.runs(tv.SPACE)
    word = block.hashes(start, end, sums)
    n_words = tv.count_in(text, n)
    points = np.concatenate([[0], np.cumsum(_CODE_POINT[buf])])
    chars = points[end] - points[start]
    word_chars = tv.count_in(text, n, chars)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    n_symbols = symbols[block.off[1:]] - symbols[block.off[:-1]]

    gram, at = tv.grams(word, text, rules.window)
    at = at[tv.repeated(gram, text[at])] if len(gram) else at
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + rules.window, -1)
    n_repeat = tv.count_in(text, n, np.cumsum(cover)[:-1] > 0)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)

    l_start, l_end, l_text = block.lines()
    first = np.searchsorted(start, l_start)
    last = np.searchsorted(start, l_end)
    words = last - first
    real = words > 0
    again = tv.later(block.hashes(l_start, l_end, sums), l_text)
    # equal hashes of lines without a word do not count, and such a line never equals one with a word
    dup = again & real
    n_dup = tv.count_in(l_text, n, dup)

    tail = np.where(real, end[np.maximum(last, 1) - 1] if len(end) else 0, l_start)
    terminal = _ends_with(block, tail, l_start, TERMINAL)
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    letter = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    exclaim = np.concatenate([[0], np.cumsum(buf == ord("!"))])
    alone = np.zeros(len(start), bool)
    for mark in SEPARATORS:
        code = mark.encode()
        alone |= (end - start == len(code)) & _ends_with(block, end, start, (mark,))
    alone = np.concatenate([[0], np.cumsum(alone)])
    span = lambda c: c[l_end] - c[l_start]
    n_alone = alone[last] - alone[first]
    n_letters = span(letter)
    phrase = np.zeros(len(l_start), bool)
    lowered = buf.tobytes().lower()
    for p in BOILERPLATE:
        code, i = p.encode(), lowered.find(p.encode())
        while i >= 0:
            phrase[np.searchsorted(l_start, i, "right") - 1] = True
            i = lowered.find(code, i + len(code))
    punctuation = (~terminal & (words < rules.short_line)) | (span(symbols) - n_alone > rules.max_symbols_per_word * words)
    punctuation |= span(exclaim) > rules.max_exclaims_per_word * np.maximum(words, 2)
    punctuation |= (n_letters >= 20) & (span(upper) > rules.max_upper_share * n_letters)
    navigation = (n_alone >= 2) & (n_alone > rules.max_separator_share * words)
    boilerplate = dup | (phrase & (words <= rules.boilerplate_words))
    failed = real & (punctuation | navigation | boilerplate)

    l_chars = points[l_end] - points[l_start]
    total = tv.count_in(l_text, n, np.where(real, l_chars, 0))
    lost = tv.count_in(l_text, n, np.where(failed, l_chars, 0))
    share = lost / np.maximum(total, 1)
    kept = ~base_failed & (share <= rules.max_lost_share)
    return [
        n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed,
        tv.count_in(l_text, n), tv.count_in(l_text, n, failed), share, kept,
        drop_lines(block, l_start, l_end, l_text, failed),
    ]


def drop_lines(block: tv.Block, start: np.ndarray, end: np.ndarray, text: np.ndarray, failed: np.ndarray) -> pa.Array:
    r"""The texts without the failed lines, the others joined by one \n."""
    keep = ~failed
    inner = np.zeros(len(start), bool)
    inner[:-1] = text[1:] == text[:-1]
    mask = np.repeat(keep, end - start + inner)
    k = np.flatnonzero(keep)
    final = np.ones(len(k), bool)
    final[:-1] = text[k[1:]] != text[k[:-1]]
    final = k[final & inner[k]]
    mask[end[final]] = False
    left = np.concatenate([[0], np.cumsum(mask)])
    offsets = left[block.off].astype(np.int32)
    return pa.StringArray.from_buffers(block.n, pa.py_buffer(offsets), pa.py_buffer(block.buf[mask].tobytes()))


def judge(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``df`` with counts, verdicts and the cleaned text of every row (columns of ``_FIELDS``)."""
    return add_columns(df, lambda block: _judge(block, rules), _FIELDS, text)


def keep_good(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, with the columns of ``df`` and the failing lines gone from the text."""
    names = df.columns
    row = df.select(F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    good = judge(row, "text", rules).filter("kept")
    new = {text: F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return good.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in names))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lines_failed", F.round("lost_share", 6).alias("lost_share"),
    )
