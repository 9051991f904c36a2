"""Each operator on awkward tables, on planted cases, and against its brute-force version."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import decontam, htmltext, linededup, lmscore, mixing, neardup, quality, suffix_dedup, toxicity, urlfilter
from kinweave.llm import queries as q
from tests.conftest import SF, rows
from tests.llm.helpers import brute_classes, no_documents, odd_documents

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey".split()


def prose(seed, n=120):
    rnd = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rnd.integers(0, len(WORDS), n), rnd.integers(0, 50, n), strict=True))


def edited(text, *at):
    w = text.split()
    for i in at:
        w[i] = "changed"
    return " ".join(w)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.SQL[name]).fetchdf()
    assert rows(got) == rows(want)


# --- 1

def test_near_dedup_finds_planted_copies(spark):
    a, b = prose(1), prose(2)
    texts = [a, b, edited(a, 60), a.upper(), prose(3), edited(b, 10, 11), "", None, edited(a, 61), "one two", "One, two!", "..."]
    got = dict(neardup.classes(documents(spark, texts)).collect())
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 1, 6: 6, 7: 7, 8: 0, 9: 9, 10: 9, 11: 11}


def test_near_dedup_against_brute_force(spark):
    base = prose(7, 90)
    rnd = np.random.default_rng(5)
    texts = [edited(base, *rnd.choice(90, rnd.integers(0, 5), replace=False)) for _ in range(60)] + [prose(i) for i in range(20, 40)]
    docs = documents(spark, texts)
    want = brute_classes(texts, neardup.frequencies(docs))
    got = dict(neardup.classes(docs).collect())
    assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want)) < 60


def test_near_dedup_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute_classes([d.text for d in docs], neardup.frequencies(spark.read.parquet(f"{SF}/documents.parquet")))
    got = dict(q.QUERIES["op1_near_dedup"](spark, SF).collect())
    assert got == {d.doc_id: docs[k].doc_id for d, k in zip(docs, want, strict=True)}


def test_near_dedup_awkward(spark):
    got = neardup.classes(odd_documents(spark)).collect()
    assert len(got) == 11
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 1), (5, 5), (None, None), (6, 6), (7, 7), (8, 8), (9, 6)}
    assert neardup.classes(no_documents(spark)).count() == 0
    kept = neardup.keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, None, 6, 7, 8}


def test_near_dedup_of_repeated_ids(spark):
    """Rows that repeat an id link the classes of their texts; repeated rows leave one."""
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(5, a), (5, b), (1, a), (3, b), (9, b), (7, c), (7, c), (8, edited(c, 4)), (6, prose(4)), (6, prose(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("own")).withColumn("id", F.lit(1)).withColumn("class_id", F.lit(2))
    assert set(neardup.classes(docs).collect()) == {(1, 1), (3, 1), (5, 1), (9, 1), (7, 7), (8, 7), (6, 6)}
    for most in (500_000, 0):
        kept = neardup.keep_one(docs, max_broadcast=most).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (7, c), (6, prose(4)), (6, prose(5))])


def test_near_dedup_weighs_frequent_shingles(spark):
    """A shingle that stands thousands of times weighs more than one that stands a thousand times."""
    loop = "one two three four five " * 4000
    shingle, owner, tf, _ = next(neardup.shingles(x) for x in neardup.tv.blocks(neardup.pa.array([loop])))
    counts = np.ones((3, 1 << 18), np.int64)
    counts[2, -1] = 1000
    model = neardup.Model(counts)
    sig = neardup.sample(shingle, owner, model.weights(shingle, tf), 1)
    assert (sig > 0).all()
    assert tf.max() > 3000 and model.weights(shingle, tf).max() > 255 > model.weights(shingle, np.minimum(tf, 1000)).max()
    docs = documents(spark, [loop, loop + "six", prose(3)])
    assert dict(neardup.classes(docs).collect()) == {0: 0, 1: 0, 2: 2}


def test_samples_estimate_the_similarity():
    rnd = np.random.default_rng(3)
    shingle = np.sort(rnd.choice(2**40, 3000, replace=False).astype(np.uint64))
    found = []
    for _ in range(40):
        a, b = rnd.random(3000) < 0.9, rnd.random(3000) < 0.9
        w = rnd.integers(8, 60, 3000).astype(np.uint16)
        sig = [neardup.sample(shingle[m], np.zeros(m.sum(), np.int64), w[m], 1)[0] for m in (a, b)]
        found.append((sig[0] == sig[1]).mean() - neardup.similarity(neardup._pack(shingle[a], w[a]), neardup._pack(shingle[b], w[b])))
    assert abs(np.mean(found)) < 0.03


# --- 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>"<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div>%s<aside>More</aside><section id="comments"><p>First!</p></section><form><input>Send</form><footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<article><h1>A &amp; B</h1><p>x  y\n z<p>w<b>q</b></article>", "A & B\nx y z\nwq"),
        ("<main><p>only</p><div class='ad'>buy</div></main>", "only"),
        ("<div><p>plain <i>page</i></p><ul><li><a href=1>menu</a></li></ul></div>", "plain page"),
        ("<article>a &lt;b&gt; &#233; &eacute;<br>c<!-- no --></article>", "a <b> é é c"),
        ("<article><p>never closed", "never closed"),
        ("", ""),
    ],
)
def test_html(body, expected):
    assert htmltext.main_text(PAGE % body if "never" not in body else body) == expected


def test_html_template(spark):
    """Fixed text of a host's pages is template, outside articles; repeated article text stays."""
    page = lambda i: f"<body><div>Welcome to our site</div><div>Story {i} has its own words</div></body>"
    made = [(i, "http://a.b/x", page(i)) for i in range(6)] + [(9, "http://c.d/", page(9)), (10, None, None), (11, "nonsense", "")] + [(20 + i, "http://e.f/", "<article><p>Same</p></article>") for i in range(4)]
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[3][0] == "Story 3 has its own words"
    assert got[9][0] == "Welcome to our site\nStory 9 has its own words"
    assert got[10] == got[11] == ("", 0) and got[21] == ("Same", 4)
    other = htmltext.extract(spark.createDataFrame(made, "page_id long, url string, html string"), max_broadcast=0)
    assert {r.page_id: (r.text, r.n_chars) for r in other.collect()} == got


def test_html_template_in_articles(spark):
    """Fixed text of a host leaves articles too; a class whose tokens change places is no template."""
    page = lambda i: f"<article><p>Read more on our site</p><p>Story {i} has its own words</p><p>All rights reserved</p></article>"
    turn = lambda i: "<article>%s<p>Tale %d</p></article>" % ("".join(["<p>one</p>", "<p>two</p>"][:: 1 - i % 2 * 2]), i)
    made = [(i, "http://a.b/x", page(i)) for i in range(6)] + [(10 + i, "http://c.d/", turn(i)) for i in range(6)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 has its own words"
    assert got[12] == "one\ntwo\nTale 2" and got[13] == "two\none\nTale 3"


def brute_template(pages):
    """(token, class's vector) of the valid classes of one host, from its pages' tokens: vectors as tuples, cycles as intervals."""
    counts = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
    classes = collections.defaultdict(set)
    for t, v in counts.items():
        if sum(x > 0 for x in v) >= max(3, len(pages) / 2):
            classes[v].add(t)
    spans: dict = {}
    for v, own in classes.items():
        per = [[i for i, t in enumerate(p) if t in own] for p in pages]
        cycles = [[at[i : i + len(own)] for i in range(0, len(at), len(own))] for at in per]
        if len({tuple(p[i] for i in c) for p, x in zip(pages, cycles, strict=True) for c in x}) == 1:
            spans[v] = cycles
    valid: list = []
    for v in sorted(spans, key=lambda v: -len(classes[v])):
        if not any(c[0] < i < c[-1] for w in valid for x, y in zip(spans[v], spans[w], strict=True) for c in x for d in y for i in d):
            valid.append(v)
    places = collections.defaultdict(set)
    for v in valid:
        for x, k in ((x, k) for k, x in enumerate(spans[v])):
            for c in x:
                around = [(d[0], w, sum(i < c[0] for i in d)) for w in valid if w != v for d in spans[w][k] if d[0] < c[0] < d[-1]]
                places[v].add(max(around)[1:] if around else None)
    return {(t, v) for v in valid if len(places[v]) == 1 for t in classes[v]}


def test_html_template_against_brute_force(spark):
    """The valid classes of every host of a table, and of hosts with nested and crossing classes, by explicit vectors."""
    block = lambda i: f"<div class=box><p>Part</p><p>text {i}</p><i>end</i></div>"
    made = [(i, "http://nest.ed/", "<body><h1>Site</h1>" + block(i) * (1 + i % 3) + f"<p>own {i}</p><h2>Foot</h2></body>") for i in range(7)]
    made += [(10 + i, "http://cros.sed/", "<body>" + "".join(f"<b>{x}</b><p>{x}</p>" for x in ("ab", "ba")[i % 2]) + f"<u>{i}</u></body>") for i in range(6)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(made, "page_id long, url string, html string"))
    hosts = collections.defaultdict(list)
    for r in pages.collect():
        hosts[re.match(r".*?://([^/?#]*)", r.url)[1].lower()].append(htmltext.tokens_of(r.html))
    want = {h: brute_template(p) for h, p in hosts.items() if len(p) >= 3}
    got = htmltext.templates(htmltext.parsed_pages(pages)).withColumnRenamed("h", "key")
    names = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", F.xxhash64("host").alias("key"))
    got = {r.host: r for r in got.join(names, "key").collect()}
    assert {h: {t for t, _ in x} for h, x in want.items() if x} == {h: set(r.tokens) for h, r in got.items()}
    for h, r in got.items():
        classes = collections.defaultdict(set)
        for t, c in zip(r.tokens, r.classes, strict=True):
            classes[c].add(t)
        vectors = collections.defaultdict(set)
        for t, v in want[h]:
            vectors[v].add(t)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, vectors.values()))
    nested = got["nest.ed"]
    assert {p for p in nested.parents if p} <= set(nested.classes) and len(set(nested.classes)) == 2


def test_html_template_decides(spark):
    """With fixed text in their articles most pages lose it to the template, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    pages = pages.withColumn("html", F.regexp_replace("html", "<article>", "<article><p>Reading time: five minutes</p>"))
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    plain = {r.page_id: htmltext.main_text(r.html) for r in pages.collect()}
    hosts = collections.Counter(re.match(r".*?://([^/?#]*)", r.url)[1].lower() for r in pages.collect())
    often = [r.page_id for r in pages.collect() if hosts[re.match(r".*?://([^/?#]*)", r.url)[1].lower()] >= 3]
    assert len(often) > len(got) / 2
    for k, text in plain.items():
        assert text.startswith("Reading time: five minutes\n")
        assert got[k] == (text.partition("\n")[2] if k in often else text)


def test_html_classes_nest():
    of = {1: 7, 2: 7, 3: 7, 4: 8, 5: 8, 6: 9}
    size = {7: 3, 8: 2, 9: 1}
    good = lambda tokens, test=htmltext._nesting: {x[0] for x in test(tokens, of, size) if x[-1]}
    assert good([1, 4, 0, 5, 4, 5, 2, 6, 3]) == {7, 8, 9}  # the smaller class repeats in one gap
    assert good([1, 4, 2, 5, 6, 3]) == {7, 9}  # it crosses a token of the larger
    assert good([4, 1, 5, 2, 3, 6]) == {7, 9}
    assert good([1, 4, 5, 2, 4, 5, 3]) == {7}  # it lies in two gaps
    assert good([1, 3, 2, 2, 1, 3, 6], htmltext._orders) == {9}  # two orders in one page
    assert list(htmltext._nesting([1, 2, 4, 5, 3], of, size)) == [(7, 0, 0, True), (8, 7, 2, True)]


def test_html_awkward(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "old"), (1, "http://a/", "<p>x</p>", "old")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text) for r in htmltext.extract(pages).collect()] == [(1, "x"), (1, "x")]
    assert htmltext.extract(pages.filter("page_id < 0")).count() == 0
    assert htmltext.main_text("<" * 20000) == "<" * 20000


# --- 3

def test_fold():
    assert toxicity.fold("ІDІ0T") == toxicity.fold("idiot")
    assert toxicity.fold("st​up1d") == toxicity.fold("stupid")
    assert toxicity.fold("ｔｒàsh") == toxicity.fold("trash")


def test_lexicon():
    lex = toxicity.Lexicon({toxicity.fold(w): 1.0 for w in ("trash", "idiot")})
    assert len(lex.matches(toxicity.fold("you IDI0T, trash can, trash idiotic"))) == 2


def test_matches_against_brute_force():
    """Words outside exception phrases, by regular expressions, in texts full of both."""
    lex = toxicity.Lexicon({toxicity.fold(w): 1.0 for w in ("trash", "clown", "pig", "garbage")})
    rnd = np.random.default_rng(8)
    bits = ["trash", "trash can", "clown", "circus clown", "clown car", "pig", "guinea pig", "pigs", "garbage truck", "collector", "x"]
    for _ in range(200):
        text = toxicity.fold(" ".join(rnd.choice(bits, 30)))
        spared = [m.span() for p in toxicity.EXCEPTIONS for m in re.finditer(rf"(?=\b({re.escape(toxicity.fold(p))})\b)", text) for m in [re.compile(re.escape(m[1])).match(text, m.start())]]
        hits = sorted(m.span() for w in lex.weights for m in re.finditer(rf"\b{w}\b", text) if not any(a <= m.start() and m.end() <= b for a, b in spared))
        assert sorted((a, b) for a, b, _ in lex.matches(text)) == hits


def test_toxicity_replaces_columns(spark):
    docs = documents(spark, ["you idiot", "fine"]).withColumn("SCORE", F.lit("old")).withColumn("n_matches", F.lit("old"))
    out = toxicity.score(docs, toxicity.Lexicon({toxicity.fold("idiot"): 1.0}))
    assert [c.lower() for c in out.columns].count("score") == 1 and [r.n_matches for r in out.orderBy("doc_id").collect()] == [1, 0]


def test_toxicity_held_out(spark):
    got = q.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = got[got.held_out].merge(labels, on="doc_id")
    assert ((m.predicted == m.toxic).mean()) > 0.93


def test_toxicity_keeps_every_learned_word(spark):
    words = ["".join(w) for w in itertools.islice(itertools.product("bcdfghkm", repeat=4), 1100)]
    rnd = np.random.default_rng(3)
    texts = [" ".join(rnd.permutation(words)) for _ in range(8)] + [prose(i) for i in range(8)]
    docs = documents(spark, texts)
    lex = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") < 8).cast("int").alias("toxic")))
    assert {toxicity.fold(w) for w in words} <= {w for w, x in lex.weights.items() if x > 0}


def test_toxicity_awkward(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    lex = toxicity.train(docs, labels)
    out = toxicity.score(docs, lex).collect()
    assert len(out) == 11 and all(0 <= r.score < 0.5 for r in out)
    assert toxicity.score(no_documents(spark), lex).count() == 0
    assert toxicity.score(documents(spark, ["you idiot, you stupid loser"]), lex).first().score > 0.5


# --- 4

def brute_lines(texts, min_chars=10):
    strip = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    keys = [[lower(x.strip(strip)) for x in (t or "").split("\n")] for t in texts]
    first, holders = {}, collections.defaultdict(set)
    for i, own in enumerate(keys):
        for k in own:
            first.setdefault(k, i)
            holders[k].add(i)
    out = []
    for i, t in enumerate(texts):
        kept = [x for x, k in zip((t or "").split("\n"), keys[i], strict=True) if len(k) < min_chars or len(holders[k]) < 2 or first[k] == i]
        out.append((i, len(keys[i]), len(keys[i]) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark):
    texts = ["A shared line here\nown line of zero\nA shared line here", " a SHARED line here\t\nshort", None, "", "É SHARED LINE HERE\né shared line here", "é shared line here\nshort\n", "x" * 50000 + "\n" + "x" * 50000]
    got = linededup.dedup_lines(documents(spark, texts)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got)) == brute_lines(texts)
    three = linededup.dedup_lines(documents(spark, texts[:2] + texts[:1]), min_docs=3)
    assert {r.doc_id: r.n_dropped for r in three.collect()} == {0: 0, 1: 1, 2: 2}


def test_lines_awkward(spark):
    out = linededup.dedup_lines(odd_documents(spark).withColumn("kept_text", F.lit("old")))
    assert out.count() == 11 and out.columns.count("kept_text") == 1
    assert linededup.dedup_lines(no_documents(spark)).count() == 0
    assert linededup.keep_lines(odd_documents(spark)).columns == odd_documents(spark).columns
    own = odd_documents(spark).withColumn("n_lines", F.lit(77)).withColumn("n_dropped", F.lit("mine"))
    kept = linededup.keep_lines(own)
    assert kept.columns == own.columns and {(r.n_lines, r.n_dropped) for r in kept.collect()} == {(77, "mine")}
    line = "a line without an id\n"
    none = spark.createDataFrame([(None, line + str(i)) for i in range(4)] + [(3, line), (2, line + line)], "doc_id long, text string")
    got = sorted((r.doc_id or 9, r.kept_text) for r in linededup.dedup_lines(none).collect())
    assert got == [(2, line + line), (3, ""), (9, "0"), (9, "1"), (9, "2"), (9, "3")]


# --- 5

def brute_counts(s):
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    seen, dup = set(), 0
    for line in s.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(map(s.count, "#*$%&|<>")), dup, len(cover)


def test_quality_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    for r in quality.judge(docs).collect():
        want = brute_counts(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def brute_verdict(text, rules):
    """(failed lines, lost share) of a text, line by line."""
    failed, lost, total, seen = [], 0, 0, set()
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            failed.append(False)
            continue
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", line)
        ends = any(bare.endswith(m) for m in quality.TERMINAL)
        alone = sum(w in quality.SEPARATORS for w in words)
        letters, upper = sum(c.isascii() and c.isalpha() for c in line), sum(c.isascii() and c.isupper() for c in line)
        bad = not ends and len(words) < rules.short_line
        bad |= sum(map(line.count, "#*$%&|<>")) - alone > rules.max_symbols_per_word * len(words)
        bad |= line.count("!") > rules.max_exclaims_per_word * max(len(words), 2)
        bad |= letters >= 20 and upper > rules.max_upper_share * letters
        bad |= alone >= 2 and alone > rules.max_separator_share * len(words)
        low = "".join(c.lower() if c.isascii() else c for c in line)
        bad |= line in seen or any(p in low for p in quality.BOILERPLATE) and len(words) <= rules.boilerplate_words
        seen.add(line)
        failed.append(bad)
        total += len(line)
        lost += bad * len(line)
    return failed, lost / max(total, 1)


def test_quality_verdicts_against_brute_force(spark):
    rules = quality.Rules()
    more = ["A | b > c\nMENTIONS LéGALES du site\nmentions légales\nMentions légales ici\n" + prose(3) + ".", "SHOUTING AT EVERYONE HERE TODAY IS RUDE INDEED, MY FRIEND.\n" + prose(4) + ".\n! ! !\nWow! No! Yes!\n" + prose(5) + "»"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text")).unionByName(documents(spark, more).select("doc_id", "text"))
    verdicts = set()
    for r in quality.judge(docs).collect():
        failed, share = brute_verdict(r.text or "", rules)
        assert (r.n_lines, r.n_lines_failed) == (len(failed), sum(failed)) and r.lost_share == pytest.approx(share)
        assert r.kept == (not r.base_failed and share <= rules.max_lost_share)
        assert r.clean_text == "\n".join(x for x, bad in zip((r.text or "").split("\n"), failed, strict=True) if not bad)
        verdicts.add((r.kept, r.base_failed))
    assert len(verdicts) == 3
    clash = quality.judge(odd_documents(spark).withColumn("KEPT", F.lit("old")).withColumn("n_words", F.lit("old")))
    assert [c.lower() for c in clash.columns].count("kept") == 1 and clash.schema["n_words"].dataType.simpleString() == "bigint"


def test_quality_rules(spark):
    clean = "A clean title\n" + "\n".join(f"{prose(i, 12)}, sentence number {i}." for i in range(8))
    menu = "Home | News | Sport | Weather | Contact\n" * 2
    texts = [clean, clean + "\n" + menu + "Click here to sign up for our newsletter.", "\n".join(f"A | b{i} | c | d | e | f | g" for i in range(9)), None, ""]
    got = {r.doc_id: r for r in quality.judge(documents(spark, texts)).collect()}
    assert [got[i].kept for i in range(5)] == [True, True, False, False, False]
    assert "newsletter" not in got[1].clean_text and "Home" not in got[1].clean_text and "sentence number 7" in got[1].clean_text
    kept = quality.keep_good(documents(spark, texts)).collect()
    assert [r.doc_id for r in kept] == [0, 1] and all(r.n_chars == len(r.text) for r in kept)
    assert quality.judge(no_documents(spark)).count() == 0


# --- 6

def test_mix(spark):
    docs = documents(spark, [prose(i, 50 + i) for i in range(60)]).withColumn("source", F.when(F.col("doc_id") < 40, "a").when(F.col("doc_id") < 55, "b"))
    for block in (7, 4096):
        got = mixing.taken_words(docs, block=block).collect()
        assert len(got) == 60 and all(0 <= r.taken <= 2 * r.size for r in got)
        taken, target = collections.Counter(), {}
        for r in got:
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken_words(docs, block=block).collect()), key=str)
    pieces, _ = mixing.mix(docs, block=7)
    slots = pieces.groupBy("slot").agg(F.sum("words").alias("n")).collect()
    assert max(r.n for r in slots) == 7


def test_mix_awkward(spark):
    got = mixing.taken_words(odd_documents(spark)).collect()
    assert len(got) == 11 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.taken_words(no_documents(spark)).count() == 0
    assert mixing.taken_words(documents(spark, [None, ""])).filter("taken > 0").count() == 0


def test_mix_of_repeated_rows(spark):
    """Rows equal in id and text are read one after the other and share evenly; rows without id are told by their text."""
    rows = [(1, "a b c", "s")] * 7 + [(None, f"w{i} x", "t") for i in range(5)] + [(2, "p q r s t", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("mine"))
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    one = [r.taken for r in got if r.doc_id == 1]
    assert len(one) == 7 and max(one) - min(one) <= 1
    for source in "st":
        assert sum(r.taken for r in got if r.source == source) == int(next(r.target for r in got if r.source == source) + 0.5)


# --- 7

def test_substrings_against_brute_force(spark):
    rnd = np.random.default_rng(11)
    letters = lambda n: "".join(rnd.choice(list("abcdefgh é\n"), n))
    shared, edge = letters(900), letters(401)
    texts = [letters(300) + shared + letters(500), shared[100:] + letters(200), edge, letters(50) + edge + "z", letters(399), None, "", "ab" * 700, letters(600), letters(20) + shared[:399] + letters(30)]
    texts += [texts[8]] * 3
    out = suffix_dedup.drop_repeats(documents(spark, texts)).orderBy("doc_id").collect()
    got = [(r.n_bytes, sum(x.b - x.a for x in r.removed), len(r.removed), hashlib.sha256(r.kept_bytes).hexdigest()) for r in out]
    assert got == suffix_dedup.brute_force(texts)


def test_substrings_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = q.QUERIES["op7_substring_dedup"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == suffix_dedup.brute_force([d.text for d in docs])


def test_substrings_of_a_frequent_anchor(spark):
    """Edges of a passage that all texts share, dealt whole and window by window: the same spans as by brute force."""
    rnd = np.random.default_rng(12)
    letters = lambda n: "".join(rnd.choice(list("abcdefgh"), n))
    shared = letters(700)
    texts = [letters(rnd.integers(0, 500)) + shared + letters(rnd.integers(0, 500)) for _ in range(40)]
    texts += [texts[3], texts[4][50:] + "x", shared[10:] + texts[5][-300:], "q" * 1500]
    want = suffix_dedup.brute_force(texts)
    for options in ({}, {"least": 1, "share": 1000}, {"family_bytes": 1}):
        out = suffix_dedup.drop_repeats(documents(spark, texts), **options).orderBy("doc_id").collect()
        assert [(r.n_bytes, sum(x.b - x.a for x in r.removed), len(r.removed), hashlib.sha256(r.kept_bytes).hexdigest()) for r in out] == want


@pytest.mark.parametrize("length", [13, 16, 40])
def test_suffix_array_is_sorted(length):
    rnd = np.random.default_rng(length)
    text = bytes(rnd.integers(97, 99, 300, dtype=np.uint8))
    text = text[:150] + text[20:120] + text[:90]
    a = suffix_dedup.SuffixArray(np.frombuffer(text, np.uint8), length)
    at = np.arange(len(text) - length + 1)
    gone, kept = a.sort(at, at)
    of = lambda i: text[i : i + length]
    assert [of(i) for i in a.at] == sorted({of(i) for i in at})
    assert len(gone) + len(a.at) == len(at) and all(of(x) == of(y) and x != y for x, y in zip(gone, kept, strict=True))
    b = suffix_dedup.SuffixArray(np.frombuffer(text[100:200] + b"zzz" * 20, np.uint8), length)
    b.sort(np.arange(161 - length), np.arange(161 - length))
    there = bytes(b.text)
    want = {x: {of(i): i for i in a.number}.get(x, -1) for x in (there[i : i + length] for i in b.at)}
    found, place = a.find(b)
    assert found.tolist() == [want[there[i : i + length]] for i in b.at]
    b.at, b.number, b.first = b.at[found < 0], b.number[found < 0], b.first[found < 0]
    both = a.merged(b, place[found < 0])
    text = bytes(both.text)
    assert [text[i : i + length] for i in both.at] == sorted(text[i : i + length] for i in both.at) and len(both.at) == len(a.at) + len(b.at)


def test_index_family_keeps_few_levels():
    import pyarrow as pa

    from kinweave.llm import textvec as tv

    family = suffix_dedup.IndexFamily(40)
    for i in range(40):
        for block in tv.blocks(pa.array([prose(i)])):
            family.add(block)
    assert len(family.levels) <= 8 and not family.repeat.any()
    sizes = [len(x.at) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    for block in tv.blocks(pa.array([prose(7)])):
        family.add(block)
    assert family.repeat.sum() == 2 * (len(prose(7)) - 39)


def test_substrings_awkward(spark):
    out = suffix_dedup.drop_repeats(odd_documents(spark)).collect()
    assert len(out) == 11
    assert suffix_dedup.drop_repeats(no_documents(spark)).count() == 0


# --- 8

def test_leaks(spark):
    item = prose(50, 30)
    changed = edited(item, 7, 15, 22)
    texts = [f"{prose(1)} {item} {prose(2)}", f"{prose(3)} {changed.upper()}", prose(4), None, "", " ".join(item.split()[:14]), " ".join(item.split()[:6]), item]
    items = spark.createDataFrame([(5, item), (6, None), (7, "too short"), (8, item)], "item_id long, text string")
    for size in (8 << 20, 100):
        got = {r.doc_id: sorted(x.item_id for x in r.leaks) for r in decontam.find_leaks(documents(spark, texts), items, max_broadcast=size).collect()}
        assert got == {0: [5, 8], 1: [5, 8], 2: [], 3: [], 4: [], 5: [5, 8], 6: [], 7: [5, 8]}
    kept = decontam.drop_leaked(odd_documents(spark), items)
    assert kept.count() == 11 and kept.columns == odd_documents(spark).columns
    assert decontam.find_leaks(odd_documents(spark), items.limit(0)).filter("size(leaks) > 0").count() == 0
    assert decontam.find_leaks(no_documents(spark), items).count() == 0


def test_leaks_of_short_items(spark):
    """An item below min_tokens is found where it stands whole, in any case, and nowhere else."""
    five, one = " ".join(prose(60).split()[:5]), "zyxwvu"
    texts = [f"{prose(61)} {five.upper()}. {prose(62)} {five}", edited(five, 2), " ".join(five.split()[:4]), one, None, f"a {one} b {one}", five, five.replace(" ", "\n")]
    items = spark.createDataFrame([(1, five), (2, five.title()), (3, one), (4, "..."), (5, prose(63, 20))], "item_id long, text string")
    for size in (8 << 20, 40):
        got = {r.doc_id: sorted((x.item_id, x.n_match, x.n_tokens, x.item_tokens, x.doc_start, x.item_start) for x in r.leaks) for r in decontam.find_leaks(documents(spark, texts), items, max_broadcast=size).collect()}
        both = lambda at: [(i, 5, 5, 5, at, 0) for i in (1, 2)]
        assert got == {0: both(120), 1: [], 2: [], 3: [(3, 1, 1, 1, 0, 0)], 4: [], 5: [(3, 1, 1, 1, 1, 0)], 6: both(0), 7: both(0)}


def brute_leak(text, item, rule):
    """The most tokens that a text and an item share in one segment of a diagonal, if they count."""
    best = 0
    for d in range(1 - len(item), len(text)):
        a, b = max(d, 0), min(d + len(item), len(text))
        same = np.array(text[a:b]) == np.array(item[a - d : b - d])
        if same.sum() > best:
            best = max(best, decontam._segment(same, rule.min_identity)[0])
    return best >= max(rule.min_tokens, min(rule.min_match, rule.min_share * len(item)))


def test_leaks_with_substitutions_against_brute_force(spark):
    """Of copies with words exchanged at random none is found that brute force doesn't find, and nearly all that it does."""
    rnd, rule = np.random.default_rng(77), decontam.Overlap()
    items = [prose(200 + i, int(n)) for i, n in enumerate(rnd.integers(9, 60, 8))]
    texts = []
    for i in range(64):
        w = items[i % 8].split()
        change = rnd.random(len(w)) < rnd.choice([0.0, 0.1, 0.2, 0.3, 0.5])
        w = [f"z{j}" if c else x for j, (x, c) in enumerate(zip(w, change, strict=True))][rnd.integers(0, 3) :]
        texts.append(f"{prose(300 + i, 40)} {' '.join(w)} {prose(400 + i, 40)}")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, x.item_id) for r in decontam.find_leaks(documents(spark, texts), table).collect() for x in r.leaks}
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if brute_leak(t.split(), x.split(), rule)}
    assert got <= want and len(got) >= 0.95 * len(want) and 30 < len(want) < 64
    own = documents(spark, texts).withColumn("leaks", F.lit("mine"))
    kept = decontam.drop_leaked(own, table)
    assert kept.columns == own.columns and {r.leaks for r in kept.collect()} == {"mine"}
    assert {r.doc_id for r in kept.collect()} == set(range(64)) - {i for i, _ in got}


def test_leaks_query_against_brute_force(spark):
    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = set()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = " " + " ".join(words(d.text)) + " "
        whole |= {(d.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in text}
    got = {(r.doc_id, r.item_id) for r in q.QUERIES["op8_decontaminate"](spark, SF).collect()}
    assert whole <= got and whole


# --- 9

def test_urls(spark):
    urls = ["http://org/", "https://A.Example.ORG/es/1?x", "http://example.org/en/12#a", "http://notexample.org/es/", "http://a.com/de/", "http://a.com/fr/x", "x", None, "", "http://b.net/", "http://a.com", "HTTP://x.com://y/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(list(urlfilter.RULES), "host string, path string, verdict string")
    for ranges in (2, 9):
        got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.match_urls(pages, rules, ranges=ranges).collect()}
        assert [got[i] for i in range(6)] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow")]
        assert all(got[i] == (None, "allow") for i in (6, 7, 8, 9, 10))
    clash = pages.withColumn("host", F.lit("old"))
    assert urlfilter.match_urls(clash.unionByName(clash), rules).count() == 24
    assert urlfilter.match_urls(pages.filter("page_id < 0"), rules).count() == 0
    assert urlfilter.match_urls(pages, rules.limit(0), default="block").filter("verdict = 'block'").count() == 12


def test_places_among_bounds(spark):
    bounds = sorted({f"k{i * 7919 % 1000:03d}" for i in range(130)})
    keys = spark.createDataFrame([(b,) for b in [*bounds, "", "k0005", "k5", "z"]], "key string")
    for some in (bounds, bounds[:1], []):
        got = keys.select("key", urlfilter._place(some, F.col("key")).alias("n")).collect()
        assert all(r.n == sum(b <= r.key for b in some) for r in got)


def test_urls_against_brute_force(spark):
    rnd = np.random.default_rng(2)
    hosts = [".".join(rnd.choice(list("abc"), rnd.integers(1, 4))) for _ in range(200)]
    paths = ["/" + "".join(rnd.choice(list("xy/"), rnd.integers(0, 4))) for _ in range(200)]
    rules = sorted({(".".join(rnd.choice(list("abc"), rnd.integers(1, 3))), "/" + "".join(rnd.choice(list("xy/"), rnd.integers(0, 2)))) for _ in range(30)})
    said = {r: "block" if i % 2 else "allow" for i, r in enumerate(rules)}
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(zip(hosts, paths, strict=True))], "page_id long, url string")
    table = spark.createDataFrame([(*r, v) for r, v in said.items()], "host string, path string, verdict string")
    for r in urlfilter.match_urls(pages, table, default="none", ranges=5).collect():
        fit = [(len(h + p), len(h), v == "block", v) for (h, p), v in said.items() if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert r.verdict == (max(fit)[3] if fit else "none")


# --- 10

def test_language_models_against_brute_force(spark):
    texts = ["the cat sat on the mat", "the cat ate the fish", "a dog sat on a log", "the cat sat", None, "", "unseen words only here"]
    docs = documents(spark, texts).withColumn("good", F.col("doc_id") < 2)
    got = {r.doc_id: r for r in lmscore.score(docs, lmscore.train(docs, "good")).collect()}
    words = [re.findall(r"\w+", t or "") for t in texts]
    vocabulary = {w for w, n in collections.Counter(w for x in words for w in x).items() if n >= 2}
    bigrams = {b for b, n in collections.Counter(b for x in words for b in zip(x, x[1:], strict=False)).items() if n >= 2}

    def loss(chosen, x):
        one, two = collections.Counter(w for y in chosen for w in y), collections.Counter(b for y in chosen for b in zip(y, y[1:], strict=False))
        total, unknown = sum(one.values()), sum(n for w, n in one.items() if w not in vocabulary)
        out = 0.0
        for i, w in enumerate(x):
            p = ((one[w] if w in vocabulary else unknown) + lmscore.ALPHA) / (total + lmscore.ALPHA * (len(vocabulary) + 1))
            if i and (before := one[x[i - 1]] if x[i - 1] in vocabulary else unknown):
                pair = (x[i - 1], w)
                p = lmscore.LAMBDA * (two[pair] / before if pair in bigrams else 0) + (1 - lmscore.LAMBDA) * p
            out -= np.log(p)
        return out / max(len(x), 1)

    for i, x in enumerate(words):
        assert got[i].n_tokens == len(x)
        assert got[i].background_loss == pytest.approx(loss(words, x))
        assert got[i].target_loss == pytest.approx(loss(words[:2], x))
        assert got[i].score == pytest.approx(got[i].target_loss - got[i].background_loss)


def test_language_models_keep_rare_words(spark):
    # 4 MB of background: a word of the target that occurs twice stays in the models
    filler = " ".join(prose(1, 2000).split() * 30)
    texts = ["zyx wvu tsr"] + [filler] * 12 + ["zyx wvu tsr"]
    docs = documents(spark, texts).withColumn("good", F.col("doc_id") < 1)
    assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 4_000_000
    models = lmscore.train(docs, "good")
    got = {r.doc_id: r for r in lmscore.score(docs, models).collect()}
    words = [t.split() for t in texts]
    one = collections.Counter(w for x in words for w in x)
    assert min(one.values()) >= 2
    total, size = sum(one.values()), len(one) + 1

    def loss(n, n_before, n_pair, total):
        p = [(n + lmscore.ALPHA) / (total + lmscore.ALPHA * size)] * 3
        p[1:] = [lmscore.LAMBDA * n_pair / n_before + (1 - lmscore.LAMBDA) * x for x in p[1:]]
        return -np.mean(np.log(p))

    assert got[13].background_loss == pytest.approx(loss(2, 2, 2, total))
    assert got[13].target_loss == pytest.approx(loss(1, 1, 1, 3))
    # documents that are not the background's own get the same scores
    other = {r.doc_id: r for r in lmscore.score(docs.drop("good"), models).collect()}
    assert all(other[i].score == pytest.approx(got[i].score) and other[i].n_tokens == got[i].n_tokens for i in got)


def test_language_models_awkward(spark):
    docs = odd_documents(spark).withColumn("good", F.lit(None).cast("boolean"))
    assert lmscore.score(docs, lmscore.train(docs, "good")).count() == 11
    assert lmscore.score(no_documents(spark), lmscore.train(no_documents(spark).withColumn("good", F.lit(True)), "good")).count() == 0
    got = q.QUERIES["op10_lm_score"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
