"""Text normalisation as built-in column expressions.

Everything here stays in the JVM: accents are folded by ``translate`` from a
table derived from Unicode decompositions, tokens are arrays, dictionaries are
map literals.  A null text counts as empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions import constants as k


def _decomposed(code: int) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))


_ACCENTS = {chr(c): _decomposed(c) for c in range(0x80, 0x250) if _decomposed(c) != chr(c)}
_ONE = "".join(c for c, to in _ACCENTS.items() if len(to) == 1)
_ONE_TO = "".join(_ACCENTS[c] for c in _ONE)
_MORE = {c: to for c, to in _ACCENTS.items() if len(to) != 1}


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_accents(s: Column) -> Column:
    """Compatibility decomposition without combining marks, for code points below U+0250."""
    s = F.translate(s, _ONE, _ONE_TO)
    for c, to in _MORE.items():
        s = F.replace(s, F.lit(c), F.lit(to))
    return s


def fold(c: Column | str, words_for_signs: bool = True) -> Column:
    """Lower case; accents go only if the whole text stays below U+0250; & and + become words."""
    s = F.lower(F.replace(_text(c), F.lit("�"), F.lit("")))
    s = F.when(s.rlike("[^\\x{0}-\\x{24F}]"), s).otherwise(strip_accents(s))
    if words_for_signs:
        s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    return s


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0))


def _mapped(x: Column, table: dict[str, str]) -> Column:
    literal = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.coalesce(F.try_element_at(literal, x), x)


def name_tokens(c: Column | str, strip_suffix: bool = True, french: bool = False) -> Column:
    """Words of a name; legal forms go unless nothing else is left."""
    t = tokens(fold(c))
    if french:
        t = F.transform(t, lambda x: _mapped(x, k.NAME_WORDS))
    if strip_suffix:
        u = F.filter(t, lambda x: ~x.isin(k.LEGAL_SUFFIXES))
        t = F.when(F.size(u) > 0, u).otherwise(t)
    return t


def addr_tokens(c: Column | str, french: bool = False) -> Column:
    """Words of an address: state names to codes, abbreviations spelled out, numbers without leading zeros, no landmarks."""
    s = fold(c)
    for name in sorted((n for n in k.STATES if " " in n), key=len, reverse=True):
        s = F.regexp_replace(s, rf"\b{name}\b", k.STATES[name])
    spelled = {n: k.ADDRESS_WORDS.get(code, code) for n, code in k.STATES.items() if " " not in n} | k.ADDRESS_WORDS
    raw = tokens(s)
    out = F.transform(raw, lambda x: _mapped(x, spelled))
    if french:
        saint = spelled | {"st": "saint", "ste": "sainte"}
        is_french = F.arrays_overlap(raw, F.array(*map(F.lit, k.FRENCH_STREETS)))
        out = F.when(is_french, F.transform(raw, lambda x: _mapped(x, saint))).otherwise(out)
    out = F.transform(out, lambda x: F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, "^0+(?=.)", "")).otherwise(x))
    return F.filter(out, lambda x: ~x.isin(k.LANDMARKS))


def norm_name(c: Column | str) -> Column:
    return F.array_join(name_tokens(c), " ")


def norm_addr(c: Column | str) -> Column:
    return F.array_join(addr_tokens(c), " ")


def grams(s: Column, n: int) -> Column:
    """Substrings of length n, in order; none if the text is shorter."""
    return F.when(F.char_length(s) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.char_length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
    )


def char3(s: Column) -> Column:
    return F.array_distinct(grams(s, 3))


def numbers(t: Column) -> Column:
    return F.filter(t, lambda x: x.rlike("^[0-9]+$"))


def terms(name: Column | str, addr: Column | str) -> Column:
    """Typed retrieval terms: name words, address words, address numbers, and 4-grams of the squeezed name."""
    at = addr_tokens(addr)
    squeezed = F.regexp_replace(fold(name), r"[^\p{L}\p{N}]", "")
    typed = lambda p, a: F.transform(a, lambda x: F.concat(F.lit(p), x))
    return F.array_distinct(F.concat(typed("n:", name_tokens(name)), typed("a:", at), typed("d:", numbers(at)), typed("g:", grams(squeezed, 4))))


def non_latin(c: Column | str) -> Column:
    return _text(c).rlike("[^\\x{0}-\\x{24F}]")


def blank(c: Column | str) -> Column:
    return _text(c).rlike(r"^[\s\x{1C}-\x{1F}]*$")


def packed_id(c: Column | str) -> Column:
    """The number after the source prefix; third-source ids are moved by 10**10."""
    s = F.col(c) if isinstance(c, str) else c
    return F.substring(s, 4, 30).cast("long") + F.when(s.startswith("S3"), F.lit(10**10)).otherwise(F.lit(0))


@lru_cache
def _plain_letters() -> dict[str, str]:
    """Characters from U+0250 on whose decomposition holds an ASCII letter or digit, or that combine: what they leave."""
    found = {}
    for code in [*range(0x250, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F250)]:
        c = chr(code)
        if unicodedata.combining(c):
            found[c] = ""
        elif (to := _decomposed(code)) != c and re.search("[a-z0-9.&/]", to):
            found[c] = to
    return found


def _far_accents(s: Column) -> Column:
    """The decompositions that :func:`strip_accents` leaves out, as far as core names can see them."""
    table = _plain_letters()
    one = {c: to for c, to in table.items() if len(to) == 1}
    gone = "".join(c for c, to in table.items() if not to)
    s = F.translate(s, "".join(one) + gone, "".join(one.values()))
    more = F.from_json(F.lit(json.dumps({c: to for c, to in table.items() if len(to) > 1})), "map<string,string>")
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(more, c), c)), "")


def core_fold(c: Column | str) -> Column:
    """Fold for core names: accents always go, dotted initials close up."""
    s = strip_accents(F.lower(F.replace(_text(c), F.lit("�"), F.lit(""))))
    s = F.when(s.rlike("[^\\x{0}-\\x{24F}]"), _far_accents(s)).otherwise(s)
    s = F.regexp_replace(s, k.DOTTED[0], "$1")
    return F.regexp_replace(s, k.DOTTED[1], "$1$2")


def _core_words(c: Column | str) -> tuple[Column, Column]:
    s = core_fold(c)
    trade_name = s.rlike(k.TRADE_NAME) | s.rlike(k.DOMAIN_NAME)
    return trade_name, tokens(F.replace(s, F.lit("&"), F.lit(" ")))


def split_core(c: Column | str) -> Column:
    """struct(core, legal), or null for trading and domain names."""
    trade_name, t = _core_words(c)
    core = F.filter(t, lambda x: ~x.isin(k.CORE_LEGAL + k.CORE_STOP))
    legal = F.array_distinct(F.filter(t, lambda x: x.isin(k.CORE_LEGAL)))
    return F.when(~trade_name, F.struct(core.alias("core"), legal.alias("legal")))


def core_key(c: Column | str, ordered: bool = False) -> Column:
    """Core words with abbreviations spelled out, sorted unless ``ordered``; null without core words."""
    return split_key(split_core(c), ordered)


def split_key(split: Column, ordered: bool = False) -> Column:
    """The :func:`core_key` of a name that :func:`split_core` has read."""
    core = F.transform(split["core"], lambda x: _mapped(x, k.CORE_WORDS))
    core = core if ordered else F.array_sort(core)
    return F.when(F.size(core) > 0, core)


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; both empty: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
