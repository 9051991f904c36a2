"""Hand-traced values and properties of the text functions and kernels."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import kernels as kn
from kinweave.functions import text as t

words = st.text("abcd ", max_size=12)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column("x")).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (t.fold, "Café & Co", "cafe  and  co"),
        (t.fold, "É गु", "é गु"),
        (t.fold, None, ""),
        (t.name_tokens, "Café & Co", ["cafe", "and"]),
        (t.name_tokens, "SARL Ltd", ["sarl", "ltd"]),
        (t.addr_tokens, "0012 Main St, Hartford, Connecticut", ["12", "main", "street", "hartford", "court"]),
        (t.addr_tokens, "", []),
        (t.core_key, "Ets Martin SARL", ["etablissements", "martin"]),
        (t.core_key, "Foo dba Bar", None),
        (t.core_key, "shop.fr", None),
        (t.core_key, "S.A.S. Dupont", ["dupont"]),
        (t.packed_id, "S3-7", 10**10 + 7),
        (t.packed_id, "S1-7", 7),
    ],
)
def test_column_functions(spark, function, value, expected):
    assert one(spark, function, value) == expected


def test_terms(spark):
    got = spark.createDataFrame([("Acme Ltd", "12 Main St")], "n string, a string").select(t.terms("n", "a")).first()[0]
    assert sorted(got) == sorted("n:acme a:12 a:main a:street d:12 g:acme g:cmel g:melt g:eltd".split())


def test_char3_and_jaccard(spark):
    r = spark.range(1).select(
        t.char3(F.lit("ab")), t.char3(F.lit("abcd")), t.jaccard(F.array(), F.array()), t.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))),
    ).first()
    assert (r[0], r[1], r[2]) == ([], ["abc", "bcd"], 1.0)
    assert r[3] == pytest.approx(1 / 3)


def test_scripts():
    assert kn.skeleton("Good Trading") == kn.skeleton("गुड ट्रेडिंग") == "gd trdng"
    assert kn.skeleton("Philly") == "fl"
    assert kn.skeleton("1100 Main") == "10 mn"
    assert kn.translit("कमल") == "kamal"
    assert kn.translit("") == ""


def test_streets():
    assert kn.parse_street("0012 Main St, Hartford, Connecticut") == ("12", "main", True)
    assert kn.parse_street("12, Near Temple, Pune") == ("12", "", False)
    assert kn.parse_street("") == ("", "", False)


def test_operations():
    assert kn.name_operation("Martin SARL", "Martin") == "core= legal-ok"
    assert kn.name_operation("Martin Dupont SARL", "Martin SAS") == "core-del legal-swap"
    assert kn.name_operation("Martin", "Martin Conseil") == "core+add legal-ok"
    assert kn.name_operation("Martin", "dba Martin") == "dba/domain"
    assert kn.name_operation("Martin", "SARL") == "no-core"
    assert kn.number_operation("12 Main St", " ") == "addr-empty"
    assert kn.number_operation("12 Main St", "14 Main St") == "num!="


def test_kernel_values():
    assert kn.ratio("acme", "acne") == 0.75
    assert kn.ratio("kitten", "sitting") == pytest.approx(8 / 13)
    assert kn.ratio("", "") == 1.0
    assert kn.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert kn.token_set_ratio("", "a") == 0.0
    assert kn.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert kn.token_sort_ratio("b a", "a b") == 1.0
    assert kn.partial_ratio("abcd", "xxabcdxx") == 1.0
    assert kn.part_share(["abc"], ["abc", "x"]) == 1.0
    assert kn.align(["martin", "dupont"], ["dupond", "martin"])


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_kernel_properties(a, b):
    assert kn.lcs_length(a, b) == naive_lcs(a, b)
    for f in (kn.ratio, kn.partial_ratio, kn.token_sort_ratio, kn.token_set_ratio):
        assert 0 <= f(a, b) <= 1
        assert f(a, b) == pytest.approx(f(b, a))
    assert 0 <= kn.jaro_winkler(a, b) <= 1
    assert kn.ratio(a, a) == 1
    assert kn.partial_ratio(a, b) >= kn.ratio(a, b) - 1e-9 or len(a) != len(b)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_partial_ratio_tries_every_piece(a, b):
    def best(x, y):
        n = len(x)
        pieces = {y[i : i + n] for i in range(len(y) - n + 1)} | {y[:i] for i in range(1, n)} | {y[-i:] for i in range(1, n)}
        return max(2 * naive_lcs(x, p) / (n + len(p)) for p in pieces)

    if a and b:
        want = max(best(a, b), best(b, a)) if len(a) == len(b) else best(*sorted((a, b), key=len))
        assert kn.partial_ratio(a, b) == pytest.approx(want)


def test_registered(spark):
    kn.register(spark)
    assert spark.sql("SELECT kin_ratio('acme', 'acne')").first()[0] == 0.75


def test_core_fold_is_the_kernels(spark):
    """Characters between letters: the built-in fold and the kernel agree on the words they leave."""
    import sys

    from pyspark.sql import functions as F

    from kinweave.functions import kernels as kn
    from kinweave.functions import text as t

    codes = [c for c in [*range(0x21, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)] if not chr(c).isspace() and chr(c) != "�" and len(chr(c).lower()) == 1]
    rows = spark.createDataFrame([(f"ab{chr(c)}cd ef",) for c in codes], "name string")
    got = {x.name: x.core for x in rows.select("name", t.split_core("name")["core"].alias("core")).collect()}
    bad = [n for n in got if got[n] != (kn.core_split(n) or (None,))[0]]
    assert sys.maxunicode and len(bad) <= 0.001 * len(codes), bad[:20]
