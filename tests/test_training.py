"""Pairs to train on, decisions by country, rule chains and streaming."""

from kinweave.operators import rules, training
from kinweave.streaming import linker


def test_positives_and_negatives(spark):
    truth = spark.createDataFrame([("S1-1", f"S2-{i}") for i in range(5)] + [("S1-2", "S2-9")], "q_id string, p_id string")
    got = training.positives(truth).groupBy("q_id").count().collect()
    assert {r.q_id: r["count"] for r in got} == {"S1-1": 2, "S1-2": 1}
    out = spark.createDataFrame([("S1-1",)], "q_id string")
    assert [r.q_id for r in training.positives(truth, 2, out).collect()] == ["S1-2"]
    c = spark.createDataFrame([("S1-2", "S2-9", 0), ("S1-2", "S2-8", 1), ("S1-2", "S2-7", 8)], "q_id string, p_id string, rank int")
    assert {(r.p_id, r.y) for r in training.hard_negatives(c, truth).collect()} == {("S2-9", 1), ("S2-8", 0)}


def test_cipher(spark):
    t = spark.createDataFrame([("abz 1",)], "x string")
    assert training.ciphered(t, ["x"], shift=1).first().x == "bca 1"


def test_decision(spark):
    p = spark.createDataFrame([("A", 1, 1, 0.65), ("A", 2, 1, 0.9), ("B", 1, 1, 0.65), ("B", 1, 2, 0.75), ("B", 1, 3, 0.5)], "country string, q long, p long, s double")
    t = spark.createDataFrame([("A", 0.6, 0.5)], "country string, gate double, extra double")
    d = training.Decision.read(t)
    assert {(r.country, r.q, r.p) for r in d.apply(p).collect()} == {("A", 2, 1), ("B", 1, 2)}
    d = training.Decision.read(t, B=(0.7, 0.6))
    assert {(r.country, r.q, r.p) for r in d.apply(p).collect()} == {("A", 2, 1), ("B", 1, 2), ("B", 1, 1)}


def test_rule_chain(spark):
    r = "entity_id string, name string, address string"
    q = rules.prepared(spark.createDataFrame([("S1-1", "Martin Dupont", "12 rue Verte")], r))
    p = rules.prepared(spark.createDataFrame([("S2-1", "Dupont Martin", "12 rue verte"), ("S2-2", "Dupond Martin", "12 rue verte")], r))
    none = spark.createDataFrame([], "q_id string, p_id string")
    got = rules.apply_rules(none, q, p, [rules.exact_core, lambda a, b: rules.aligned(a, b, "typo")])
    assert {(x.p_id, x.step) for x in got.collect()} == {("S2-1", 1), ("S2-2", 2)}


def test_stream_drops_repeats(spark, tmp_path):
    e = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00'), (1, TIMESTAMP '2024-01-01 00:01:00'), (2, TIMESTAMP '2024-01-01 00:02:00') t(event_id, ts)")
    e.coalesce(1).write.parquet(str(tmp_path / "events"))
    out = linker.run_once(linker.drop_repeats(linker.read_stream(spark, str(tmp_path / "events"))), "events_once")
    assert sorted(r.event_id for r in out.collect()) == [1, 2]
