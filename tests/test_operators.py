"""Hand-traced windows, decisions, rules and sources."""

import pytest
from pyspark.sql import functions as F

from kinweave.operators import assemble, blocking, decide, models, pairs, rules, windows
from kinweave.sources import records as r


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_contention(spark):
    p = frame(spark, [(1, 9, 0.9), (2, 9, 0.7), (3, 9, 0.6), (1, 8, 0.8)], "q long, p long, s double")
    got = {(x.q, x.p): (x.nclaim, x["rank"], round(x.gap, 6), round(x.gap_next, 6)) for x in windows.contention(p).collect()}
    assert got == {(1, 9): (3, 0, 0.2, 0.2), (2, 9): (3, 1, -0.2, 0.1), (3, 9): (3, 2, -0.3, 0.6), (1, 8): (1, 0, 1.8, 0.8)}


def test_logits(spark):
    p = frame(spark, [(1, 1, 3.0), (1, 2, 1.0), (2, 1, 3.0)], "q long, p long, s double")
    got = {(x.q, x.p): (x.ce_rank, x.ce_gap_best, x.ce_margin, x.ce_mean_q) for x in windows.logit_features(p).collect()}
    assert got == {(1, 1): (0, 0, 2, 2), (1, 2): (1, 2, -2, 2), (2, 1): (0, 0, 15, 3)}


def test_gate_and_owner(spark):
    p = frame(spark, [(1, 1, 0.9), (1, 2, 0.6), (1, 3, 0.4), (2, 1, 0.7), (2, 4, 0.6)], "q long, p long, s double")
    assert {(x.q, x.p) for x in decide.gate_extra(p, 0.8, 0.5).collect()} == {(1, 1), (1, 2)}
    o = frame(spark, [(1, 1, 0.9), (2, 1, 0.95), (3, 1, 0.95)], "q long, p long, s double")
    assert [(x.q, x.p) for x in decide.one_owner(o).collect()] == [(2, 1)]


@pytest.mark.parametrize(("pred", "true", "expected"), [("ab", "a", 0.555556), ("a", "ab", 0.833333), ("", "", 1), ("a", "", 0), ("", "a", 0)])
def test_f05(spark, pred, true, expected):
    q = frame(spark, [(1,)], "q long")
    p = frame(spark, [(1, x) for x in pred], "q long, p string")
    t = frame(spark, [(1, x) for x in true], "q long, p string")
    assert decide.macro_f05(p, t, q).first()[0] == pytest.approx(expected, abs=1e-6)


def test_tuner_agrees_with_the_metric(spark):
    p = frame(spark, [(q, c, (q * 7 + c * 3) % 10 / 10) for q in range(12) for c in range(4)], "q long, p long, s double")
    t = frame(spark, [(q, q % 4) for q in range(0, 12, 2)], "q long, p long")
    q = p.select("q").distinct()
    g = [0.3, 0.5, 0.8]
    for x in decide.tune_gate_extra(p, t, q, g, g).collect():
        assert x.macro_f05 == pytest.approx(decide.macro_f05(decide.gate_extra(p, x.gate, x.extra), t, q).first()[0])
    best = decide.best_row(decide.tune_gate_extra(p, t, q, g, g), F.desc("gate"), F.desc("extra")).first()
    assert best.gate in g


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A ""b"" c"\t\tNA\n')
    assert r.read_records(spark, str(tmp_path / "a.tsv")).collect() == [("S1-1", 'A "b" c', "", "NA")]
    t = frame(spark, [("S1-1", "S2-1,S3-2"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, r.explode_truth(t).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    assert sorted(map(tuple, r.truth_counts(t).collect())) == [("S1-1", 2), ("S1-2", 0)]
    r.write_tsv(t, str(tmp_path / "out"))
    assert r.read_tsv(spark, str(tmp_path / "out"), r.TRUTH).count() == 2


def test_dense_topk_blocks_agree(spark):
    import random

    rnd = random.Random(1)
    v = frame(spark, [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(90)], "id long, embedding array<float>")
    q, p = v.filter("id < 20"), v.filter("id >= 20")
    a = sorted(map(tuple, blocking.dense_topk(q, p, 5, block=7).collect()))
    assert a == sorted(map(tuple, blocking.dense_topk(q, p, 5).collect())) and len(a) == 100


RECORDS = "entity_id string, name string, address string"


def prepared(spark, rows):
    return rules.prepared(frame(spark, rows, RECORDS))


def test_rules(spark):
    q = prepared(spark, [("S1-1", "Martin Dupont SARL", "12 rue Verte"), ("S1-2", "Boulangerie Leroy", "3 rue Haute"), ("S1-3", "Alpha Beta Gamma", "9 rue Basse")])
    found = lambda df: {(x.q_id, x.p_id) for x in df.collect()}
    assert found(rules.exact_core(q, prepared(spark, [("S2-1", "Dupont Martin", "12, rue verte"), ("S2-2", "dupont martin", " "), ("S2-3", "Dupont Martin SAS", "12 rue Verte")]))) == {("S1-1", "S2-1"), ("S1-1", "S2-2")}
    assert found(rules.aligned(q, prepared(spark, [("S2-1", "Dupond Martin", "12 rue verte")]), "typo")) == {("S1-1", "S2-1")}
    assert found(rules.aligned(q, prepared(spark, [("S2-1", "Leroy", "3 rue haute")]), "del")) == {("S1-2", "S2-1")}
    assert found(rules.number_missing(q, prepared(spark, [("S2-1", "Leroy Boulangerie", "rue haute")]))) == {("S1-2", "S2-1")}
    assert found(rules.sole_at_address(q, prepared(spark, [("S2-1", "boulangerie-leroy.fr", "3 rue haute")]), "domain")) == {("S1-2", "S2-1")}
    assert found(rules.sole_at_address(q, prepared(spark, [("S2-1", "ABG", "9 rue basse")]), "acro")) == {("S1-3", "S2-1")}
    assert found(rules.sole_at_address(q, prepared(spark, [("S2-1", "Zorvex", "9 rue basse"), ("S2-2", "Leroy", "9 rue basse")]), "pseudo")) == {("S1-3", "S2-1")}


def test_empty_address(spark):
    q = prepared(spark, [("S1-1", "Martin", "1 rue A"), ("S1-2", "Leroy", "2 rue B")])
    p = prepared(spark, [("S2-1", "Martin", ""), ("S2-2", "Leroy", "")])
    m = frame(spark, [("S1-1", "S3-9")], "q_id string, p_id string")
    assert [(x.q_id, x.p_id) for x in rules.empty_address(m, q, p).collect()] == [("S1-1", "S2-1")]


def test_validate(spark):
    q = frame(spark, [("S1-1",), ("S1-2",)], "entity_id string")
    p = frame(spark, [("S2-1",)], "entity_id string")
    good = frame(spark, [("S1-1", "S2-1"), ("S1-2", None)], "q_id string, p_id string")
    assert all(x.n == 0 for x in assemble.validate(good, q, p).collect())
    bad = frame(spark, [("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-1", "X-1")], "q_id string, p_id string")
    assert {x.issue for x in assemble.validate(bad, q, p).collect() if x.n} == {"query missing", "match repeated", "match not in pool", "match with wrong prefix"}


def test_pair_features(spark):
    q = frame(spark, [("S1-1", "Acme Ltd", "12 Main St")], RECORDS)
    p = frame(spark, [("S2-1", "Acme", "15 Main Street"), ("S2-2", "गुड", "")], RECORDS)
    pr = frame(spark, [("S1-1", "S2-1"), ("S1-1", "S2-2")], "q_id string, p_id string")
    got = {x.p_id: x for x in pairs.pair_features(pr, q, p).collect()}
    a, b = got["S2-1"], got["S2-2"]
    assert a.nn_exact == 1 and a.st_num_diff == pytest.approx(1.386294, abs=1e-6) and a.st_ratio == 1 and a.st_num_eq == 0
    assert b.n2_nonlatin == 1 and b.a2_empty == 1 and b.sk_a_ratio == -1 and b.st_ratio == -1
    assert len(a) == 2 + 31 + 14 + 5


def test_models(spark):
    rows = frame(spark, [(q, c, float((q + c) % 3 == 0), float((q + c) % 3)) for q in range(60) for c in range(3)], "q long, p long, y double, x double")
    out = models.out_of_fold(rows, ["x"], trees=3, depth=2)
    assert out.count() == rows.count()
    assert all((x.s > 0.5) == (x.y == 1) for x in out.collect())
    assert models.self_train(rows.filter("q < 30"), rows.filter("q >= 30"), ["x"], rounds=2, trees=3, depth=2).count() == 90
    assert models.lexical_scorer(frame(spark, [("a b", "b a")], "q_text string, p_text string")).first().score == 1


def test_one_owner_of_string_ids(spark):
    o = frame(spark, [("S1-2", "S2-1", 0.9), ("S1-10", "S2-1", 0.9), ("S1-3", "S2-1", 0.5), ("S1-3", "S3-1", 0.1)], "q string, p string, s double")
    assert {(x.q, x.p) for x in decide.one_owner(o).collect()} == {("S1-10", "S2-1"), ("S1-3", "S3-1")}


def test_dense_topk_keeps_to_countries(spark):
    v = frame(spark, [(f"S2-{i}", "ab"[i % 2], [1.0, i / 10]) for i in range(8)], "id string, country string, embedding array<float>")
    got = blocking.dense_topk(v.filter("id = 'S2-0'"), v, 2, block=2, skip_same=True).collect()
    assert [(x.q_id, x.p_id, x["rank"]) for x in sorted(got, key=lambda x: x["rank"])] == [("S2-0", "S2-2", 0), ("S2-0", "S2-4", 1)]


def test_rules_keep_to_countries(spark):
    kind = "entity_id string, name string, address string, country string"
    q = rules.prepared(frame(spark, [("S1-1", "Martin Dupont", "12 rue Verte", "fr"), ("S1-2", "Martin Dupont", "12 rue Verte", "be")], kind))
    p = rules.prepared(frame(spark, [("S2-1", "Dupont Martin", "12 rue verte", "fr"), ("S2-2", "Dupond Martin", "12 rue verte", "be"), ("S2-3", "Dupont Martin", "", "be")], kind))
    found = lambda df: {(x.q_id, x.p_id) for x in df.collect()}
    assert found(rules.exact_core(q, p)) == {("S1-1", "S2-1"), ("S1-2", "S2-3")}
    assert found(rules.aligned(q, p)) == {("S1-1", "S2-1"), ("S1-2", "S2-2")}
    assert found(rules.empty_address(frame(spark, [("S1-2", "S3-7")], "q_id string, p_id string"), q, p)) == {("S1-2", "S2-3")}


def test_thresholds_by_country(spark):
    p = frame(spark, [(q, c, (q * 7 + c * 3) % 10 / 10) for q in range(12) for c in range(4)], "q long, p long, s double")
    t = frame(spark, [(q, q % 4) for q in range(0, 12, 2)], "q long, p long")
    q = p.select("q", F.when(F.col("q") < 5, "a").otherwise("b").alias("country")).distinct()
    g = [0.2, 0.5, 0.8]
    tuned = decide.tune_threshold(p, t, q, g)
    for x in tuned.collect():
        own = q.filter(F.col("country") == x.country)
        kept = p.filter(F.col("s") >= x.threshold).join(own, "q")
        assert x.macro_f05 == pytest.approx(decide.macro_f05(kept, t, own).first()[0])
    got = {x.country: x.threshold for x in decide.country_thresholds(tuned, frame(spark, [("a",), ("z",)], "country string")).collect()}
    best = {c: max((x.macro_f05, -x.threshold) for x in tuned.collect() if x.country == c) for c in "ab"}
    assert got == {"a": -best["a"][1], "b": -best["b"][1], "z": max(-best["a"][1], -best["b"][1])}


def test_lists_files_and_checks(spark, tmp_path):
    lists = frame(spark, [("S1-1", "S2-9"), ("S1-2", "")], "q_id string, matched_entity_ids string")
    more = frame(spark, [("S1-1", "S2-3", 2), ("S1-1", "S2-9", 1), ("S1-1", "S2-5", 1)], "q_id string, p_id string, step int")
    assert {x.q_id: x.matched_entity_ids for x in r.append_matches(lists, more).collect()} == {"S1-1": "S2-9,S2-5,S2-3", "S1-2": ""}
    rows = r.country_rows(frame(spark, [("S1-2", "S2-1", 0.5), ("S1-1", "S2-1", 0.5), ("S1-1", "S2-2", 0.9)], "q_id string, p_id string, s double"))
    r.write_rows(rows, str(tmp_path / "rows"))
    assert [tuple(x) for x in r.read_tsv(spark, str(tmp_path / "rows"), r.TRUTH, header=False).collect()] == [("S1-1", "S2-2,S2-1"), ("S1-2", "S2-1")]
    r.write_json(frame(spark, [("fr", 0.8, 0.5)], "country string, gate double, extra double"), str(tmp_path / "json"))
    assert r.read_json(spark, str(tmp_path / "json"), "country string, gate double, extra double").collect() == [("fr", 0.8, 0.5)]
    r.write_tsv(lists, str(tmp_path / "lists"))
    assemble.require_header(spark, str(tmp_path / "lists"), lists.columns)
    with pytest.raises(ValueError):
        assemble.require_header(spark, str(tmp_path / "lists"), ["other"])
    q, p = frame(spark, [("S1-1",)], "entity_id string"), frame(spark, [("S2-1",)], "entity_id string")
    assemble.require(assemble.validate(frame(spark, [("S1-1", "S2-1")], "q_id string, p_id string"), q, p))
    with pytest.raises(ValueError):
        assemble.require(assemble.validate(frame(spark, [("S1-1", "S2-7")], "q_id string, p_id string"), q, p))
    blob = r.text_blob(frame(spark, [("S1-1", "Café & Co", None, "fr")], "entity_id string, name string, address string, country string")).first()
    assert blob.text == "cafe  and  co | "


def test_name_counts(spark):
    q = frame(spark, [("S1-1", "Acme"), ("S1-2", "acme"), ("S1-3", "Other")], "entity_id string, name string")
    got = {x.q_id: x.q_count for x in pairs.query_name_counts(q, q.filter("entity_id = 'S1-1'")).collect()}
    assert got == {"S1-1": 1, "S1-2": 2, "S1-3": 1}
    assert {x.q_id: x.q_count for x in pairs.query_name_counts(q).collect()} == {"S1-1": 2, "S1-2": 2, "S1-3": 1}


def test_model_files(spark, tmp_path):
    rows = frame(spark, [(q, c, float((q + c) % 3 == 0), float((q + c) % 3)) for q in range(60) for c in range(3)], "q long, p long, y double, x double")
    made = []
    make = lambda: made.append(1) or models.fit(rows, ["x"], trees=2, depth=2)
    path = f"file://{tmp_path}/model"
    scores = [sorted((x.q, x.p, x.s) for x in models.predict(models.fit_or_load(path, make), rows).collect()) for _ in range(2)]
    assert made == [1] and scores[0] == scores[1]
    out = models.two_stage(rows.filter("q < 40"), rows.filter("q >= 40"), ["x"], windows.order_statistics, ["s2_p1"], stop=(0, 1), trees=3, depth=2)
    assert out.count() == 60


def test_encoders(spark, tmp_path):
    from kinweave.operators import encoders

    names = [f"{a} {b} {c}" for a in ("martin", "dupont", "leroy", "garnier", "petit") for b in ("freres", "transport", "boulangerie", "conseil") for c in ("paris", "lyon", "nantes")]
    noisy = lambda x: x.replace("er", "re").replace("ou", "u").title()[::1] + " SARL"
    known = frame(spark, [("fr", n, noisy(n)) for n in names[::2]], "country string, q_text string, p_text string")
    model = encoders.train_encoder(known, rounds=6)
    held = names[1::2]
    a, b = model.encode(held), model.encode([noisy(n) for n in held])
    assert ((a @ b.T).argmax(1) == range(len(held))).mean() > 0.9
    t = frame(spark, [(i, n) for i, n in enumerate(held)], "id long, text string")
    got = {x.id: x.embedding for x in encoders.encode(t, model).collect()}
    assert all(got[i] == pytest.approx(a[i].tolist(), abs=1e-5) for i in got)
    encoders.save(model, spark, f"file://{tmp_path}/encoder")
    assert (encoders.load(spark, f"file://{tmp_path}/encoder").table == model.table).all()
    y = frame(spark, [(n, noisy(n), 1) for n in names[::2]] + [(n, noisy(m), 0) for n, m in zip(names[::2], names[2::2] + names[:1], strict=False)], "q_text string, p_text string, y int")
    score = encoders.scorer(encoders.train_scorer(y, rounds=20))
    test = frame(spark, [(n, noisy(n), 1) for n in held] + [(n, noisy(m), 0) for n, m in zip(held, held[3:], strict=False)], "q_text string, p_text string, y int")
    assert sum((x.score > 0) == (x.y == 1) for x in score(test).collect()) > 0.75 * test.count()
