"""Queries on many records of one address: no pair of records may be a row."""

import threading

import pytest

from kinweave.plans import linkage_queries as lq

#: A query and a pool record alone at an address, of one name and of different names
SAME, OTHER = ("S1-300000", "S3-300002"), ("S1-300003", "S3-300008")


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """60,000 parts of 64 names at one address, and the records above."""
    import duckdb

    folder = tmp_path_factory.mktemp("crowded")
    words = [f"{a} {b}" for a in ("hot", "cold", "old", "large", "small", "blue", "green", "red") for b in ("bolt", "ring", "plate", "gear", "valve", "screw", "nut", "pipe")]
    parts = [(i, words[i // 3 % 64], "Brand#1", "SMALL", 1, 1.0) for i in range(60_000)]
    parts += [(300_000 + i, name, f"Brand#{size}", "SMALL", size, 1.0) for i, name, size in ((0, "hot bolt", 41), (2, "hot bolt", 41), (3, "hot bolt", 52), (8, "blue ring", 52))]
    con = duckdb.connect()
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE)")
    import pandas as pd

    frame = pd.DataFrame(parts, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])  # noqa: F841
    con.execute("INSERT INTO part SELECT * FROM frame")
    con.execute(f"COPY part TO '{folder}/part.parquet' (FORMAT parquet)")
    return str(folder)


def within(spark, seconds, f):
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return f()
    finally:
        timer.cancel()


CROWDED = {
    "rule_chain": {(*SAME, 1)},
    "typo_tolerant": {(*SAME, "typo")},
    "words_added": {(*SAME, "add")},
    "acronym": {(*SAME, "acro")},
    "any_relation": {(*OTHER, "any")},
    "domain": {(*SAME, "domain")},
    "pseudo_name": {(*SAME, "pseudo"), (*OTHER, "pseudo")},
    "words_dropped": {(*SAME, "del")},
}


@pytest.mark.parametrize("name", CROWDED)
def test_crowded_address(spark, crowded, name):
    got = within(spark, 60, lambda: lq.QUERIES[name](spark, crowded).collect())
    assert {tuple(x) for x in got} == CROWDED[name]


def test_crowded_harness(spark, crowded):
    import hashlib

    drawn = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) < int(0.15 * 2**32)
    want = {(x, 1) for x in ("exact", "typo") if drawn(SAME[1])} | {("any", 1) for _ in [0] if drawn(OTHER[1])}
    got = within(spark, 60, lambda: lq.QUERIES["rule_harness"](spark, crowded).collect())
    assert {(x.rule, x.n) for x in got} == want


#: Queries that read an address once, not once a record
READ_ONCE = ["typo_tolerant", "words_added", "acronym", "any_relation", "domain", "pseudo_name", "words_dropped", "rule_harness"]


@pytest.mark.parametrize("name", READ_ONCE)
def test_addresses_are_read_once(spark, crowded, monkeypatch, name):
    import pandas as pd
    from pyspark.sql import functions as F

    from kinweave.functions import kernels as kn

    read = spark.sparkContext.accumulator(0)

    def number(a):
        read.add(len(a))
        return a.map(lambda x: kn.parse_street(x)[0])

    number.__annotations__ = dict.fromkeys(("a", "return"), pd.Series)
    monkeypatch.setattr(kn, "street_number_udf", F.pandas_udf(number, "string"))
    got = lq.QUERIES[name](spark, crowded).collect()
    assert name not in CROWDED or {tuple(x) for x in got} == CROWDED[name]
    assert 0 < read.value <= 6  # three addresses a side


#: Queries that keep no table with a row a record
COUNTED = ["words_added", "acronym", "any_relation", "domain", "pseudo_name", "words_dropped"]


@pytest.mark.parametrize("name", COUNTED)
def test_records_are_counted_not_kept(spark, crowded, monkeypatch, name):
    from kinweave.sources import checkpoints

    kept, cut = [], checkpoints.cut

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(checkpoints, "cut", counted)
    monkeypatch.setattr(lq, "cut", counted)
    got = lq.QUERIES[name](spark, crowded)
    # the tables that are kept hold texts, at most 68 a side, of 60,004 records; a sort by text would read every record
    assert {tuple(x) for x in got.collect()} == CROWDED[name]
    assert kept and max(kept) <= 140
    assert "entity_id" not in got.columns


@pytest.mark.parametrize("rule", ["del", "add", "typo", "domain", "acro", "pseudo", "any"])
def test_gathered_records_give_the_rows_of_records(spark, rule):
    """Also where ids come twice, with the same text or another, and where texts are null or empty."""
    from kinweave.operators import rules

    kind = "entity_id string, name string, address string, country string"
    at = lambda i: f"{i} Main Street"
    words = ["Acme Works", "Blue Ring", "Acme", "Acme Works Paris", "AW", "acmeworks.com", "Zorvex", None, "", "Acme Wroks"]
    q = [(f"S1-{i}", words[i % 4], at(i % 23), "fr") for i in range(20)] + [("S1-3", words[3], at(3), "fr"), ("S1-5", "Acme", at(40), "fr")]
    q += [("S1-50", None, at(50), "fr"), ("S1-51", "Acme", None, "fr"), ("S1-52", "Acme", at(1), None)]
    p = [(f"S2-{i}", words[i % 10], at(i % 23 if i % 9 else 50), "fr") for i in range(80)] + [(f"S2-{i}", words[i % 10], at(i % 23), "fr") for i in (4, 6)]
    p += [("S2-92", "AW", at(8), "fr"), ("S2-7", "Zorvex", at(8), "fr"), ("S2-11", "Acme", at(19), "fr"), ("S2-90", "Acme", None, "fr"), ("S2-91", "Blue Ring", at(2), None)]
    q, p = spark.createDataFrame(q, kind), spark.createDataFrame(p, kind)
    run = lambda a, b: rules.aligned(a, b, rule) if rule in ("del", "add", "typo") else rules.sole_at_address(a, b, rule)
    want = sorted(map(tuple, run(rules.prepared(q), rules.prepared(p)).collect()))
    assert want and sorted(map(tuple, run(*rules.gathered(q, p)).collect())) == want


def test_names_are_read_once(spark):
    from kinweave.operators import rules

    records = spark.createDataFrame([(f"S1-{i}", "Acme Ltd" if i % 3 else None, None if i % 5 else "12 Main Street") for i in range(40)], "entity_id string, name string, address string")
    got = rules.prepared(records)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # words are read where names have become distinct
    reading = [x for x in plan if "regexp_extract_all" in x]
    assert reading and all("Aggregate [_name" in x for x in reading)
    rows = {x.entity_id: x for x in got.collect()}
    assert len(rows) == 40 and rows["S1-0"].name is None and rows["S1-0"].key is None and rows["S1-0"].legal == []
    assert rows["S1-1"].key == ["acme"] and rows["S1-1"].address is None and rows["S1-1"].blank and rows["S1-0"].num == "12"


def test_harness_draws_its_sample_once(spark):
    from kinweave.operators import rules

    q, p = (rules.prepared(spark.createDataFrame([(f"S{i}-{n}", f"Acme {n}", f"{n} Main Street") for n in range(1, 40)], "entity_id string, name string, address string")) for i in (1, 2))
    plans = []

    def rule(a, b):
        plans.append(b._jdf.queryExecution().optimizedPlan().toString())
        return rules.exact_core(a, b)

    rows = rules.harness({"exact": rule}, q, p, q.selectExpr("entity_id as q_id", "replace(entity_id, 'S1', 'S2') as p_id"), 0.5).collect()
    assert [(x.kind, x.precision) for x in rows] == [("addr", 1.0)] and 0 < rows[0].n < 39
    # the rule reads drawn records; it does not hash the pool again
    assert len(plans) == 1 and "md5" not in plans[0]


def test_pair_features_compare_texts_once(spark):
    from kinweave.operators import pairs

    kind = "entity_id string, name string, address string"
    q = spark.createDataFrame([(f"S1-{i}", "Acme Ltd", "12 Main St" if i else None) for i in range(40)], kind)
    p = spark.createDataFrame([(f"S2-{i}", "Acme", "15 Main Street" if i % 2 else "") for i in range(40)], kind)
    met = q.selectExpr("entity_id as q_id").crossJoin(p.selectExpr("entity_id as p_id"))
    got = pairs.pair_features(met, q, p, digits=6)
    # kernels have run on pairs of texts; no pair of records goes through Python
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString()
    rows = got.collect()
    assert len(rows) == 1600 and len({x[2:] for x in rows}) == 4
    assert sorted(map(tuple, pairs.pair_features(met, q, p, digits=6, small=0).collect())) == sorted(map(tuple, rows))


def test_block_features_are_pair_features(spark, monkeypatch):
    from kinweave.operators import pairs

    kind = "entity_id string, name string, address string, country string, num int"
    texts = [("Acme Ltd", "12 Main St"), ("Acme", ""), (None, "12 Main Street"), ("Other Co", None), ("Acme Ltd", "7 Main St, Hartford, CT")]
    made = lambda src, n: [(f"S{src}-{i}", *texts[(i * 3 + src) % 5], "de" if i % 4 else "fr", None if i % 11 == 5 else i % 3) for i in range(n)]
    q, p = spark.createDataFrame(made(1, 30), kind), spark.createDataFrame(made(2, 40), kind)
    met = q.selectExpr("entity_id as q_id", "country", "num").join(p.selectExpr("entity_id as p_id", "country", "num"), ["country", "num"])
    sure = lambda df: sorted(map(tuple, df.collect()))
    want = pairs.pair_features(met, q, p, digits=6)
    assert len(rows := sure(want)) == met.count() > 150
    got = pairs.block_features(q, p, ["country", "num"], digits=6)
    assert got.columns == want.columns and sure(got) == rows
    # many pages of a block; features joined by text
    monkeypatch.setattr(pairs, "ROW", 2)
    monkeypatch.setattr(pairs, "PAGE", 3)
    assert sure(pairs.block_features(q, p, ["country", "num"], digits=6, small=12)) == rows
    assert sure(pairs.block_features(q, p, ["country", "num"], digits=6, small=0)) == rows
    assert sure(pairs.block_features(q, p.limit(0), ["country", "num"])) == []


def test_pair_features_of_a_crowded_block(spark, tmp_path):
    """200 million pairs of records of 1,024 pairs of texts: texts are found and compared without pairs of records."""
    words = [f"{a} {b}" for a in ("hot", "cold", "old", "large") for b in ("bolt", "ring", "plate", "gear", "valve", "screw", "nut", "pipe")]
    parts = spark.range(30_000).selectExpr(
        "id as p_partkey", f"array({', '.join(map(repr, words))})[cast(id div 3 % 32 as int)] as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "1 as p_size"
    )
    parts.write.parquet(str(tmp_path / "part.parquet"))
    got = within(spark, 120, lambda: lq.pair_features(spark, str(tmp_path)).groupBy().agg({"*": "count", "n_ratio": "max"}).collect())
    assert sorted(got[0]) == [1.0, 10_000 * 20_000]


def test_context_makes_no_pairs(spark):
    from kinweave.functions.kernels import token_sort_ratio
    from kinweave.operators import pairs

    texts = [("Acme", "1 a st"), ("Acme", ""), ("Acmes", "1 a st"), ("Other Co", "2 b st"), ("Co Other", "1 b st")]
    scored = [(q, f"S{2 + c % 2}-{c}", (c * 3 + q) % 7 / 6, *texts[(c + q) % 5], f"S{2 + c % 2}") for q in range(12) for c in range(q)]
    got = pairs.context_similarities(spark.createDataFrame(scored, "q long, p string, s double, name string, addr string, src string"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {(x.q, x.p): x for x in got.collect()}
    assert len(rows) == len(scored)
    for q in range(12):
        own = sorted((x for x in scored if x[0] == q), key=lambda x: (-x[2], x[1]))
        for i, (_, p, _, name, addr, src) in enumerate(own):
            others = own[:i] + own[i + 1 :]
            ref, conf = others[:1], [x for x in others if x[2] >= 0.5]
            place = lambda x, addr=addr: token_sort_ratio(addr, x[4]) if addr and x[4] else -1.0
            most = lambda found, f: max(map(f, found), default=-1.0)
            want = [most(ref, lambda x, name=name: token_sort_ratio(name, x[3])), most(ref, place), most(ref, lambda x, src=src: float(x[5] == src))]
            want += [most(conf, lambda x, name=name: token_sort_ratio(name, x[3])), most(conf, place)]
            want += [sum(x[3] == name for x in others), sum(x[5] == src for x in conf), sum(x[3] == name for x in conf)]
            assert list(rows[q, p][3:11]) == pytest.approx(want) and rows[q, p].s2_cempty == (addr == "") and rows[q, p].s2_t1empty == (own[0][4] == "")


def test_encoder_reads_a_text_once(spark, monkeypatch):
    from kinweave.operators import encoders

    read, plain = [], encoders.grams
    monkeypatch.setattr(encoders, "grams", lambda text, size: read.append(text) or plain(text, size))
    known = spark.createDataFrame([("fr", f"name {i % 5}", f"name {i % 5} sarl") for i in range(40)], "country string, q_text string, p_text string")
    model = encoders.train_encoder(known, rounds=3)
    assert len(read) == len(set(read)) == 10
    assert model.encode(["name 1"]).shape == (1, 32)
