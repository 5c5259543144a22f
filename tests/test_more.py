"""Fuzzy ratios, encoded keys, identity, baselines, SQL surface, pipeline."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.operators import baseline, identity
from tessera.plans import pipeline, sql


def test_ratios(spark):
    assert round(fuzzy.ratio("this is a test", "this is a test!"), 2) == 96.55
    assert fuzzy.partial_ratio("this is a test", "this is a test!") == 100
    assert fuzzy.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.q_ratio("A-b", "a b!") == 100 and fuzzy.w_ratio("", "x") == 0
    df = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string")
    assert [r.r for r in df.select(F.round(fuzzy.fuzz("ratio", F.col("a"), F.col("b")), 2).alias("r")).collect()] == [66.67, None]
    assert fuzzy.nysiis_py("Knight") == fuzzy.nysiis_py("Night") and fuzzy.nysiis_py("12") == ""


def test_private_linkage(spark):
    a = spark.createDataFrame([(1, "ann meyer", "1980"), (2, "bob stone", "1990"), (3, None, None)], "id long, n string, y string")
    b = spark.createDataFrame([(7, "ann meyer", "1980"), (8, "anne meyer", "1980"), (9, "zoe quint", "1955")], "id long, n string, y string")
    got = {(r.a, r.b): r.score for r in identity.private_linkage(a, b, "id", ["n", "y"], 0.8).collect()}
    assert got[1, 7] == 1.0 and (1, 8) in got and len(got) == 2
    with pytest.raises(ValueError):
        fuzzy.clk_py(["x"], "high")


def test_identity(spark):
    old = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)], "member long, cluster_id long")
    new = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)], "member long, cluster_id long")
    assert {(r.kind, r.entity, r.other) for r in identity.events(old, new).collect()} == {("merged", 1, 3), ("split", 4, 5), ("created", 6, None)}
    assert {r.member: r.entity_id for r in identity.stabilise(old, new).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    log = spark.createDataFrame([(i, f"e{i}") for i in range(30)], "id long, what string")
    a, b = (identity.seal(x, "id", 10).orderBy("block").collect() for x in (log, log.withColumn("what", F.when(F.col("id") == 12, "forged").otherwise(F.col("what")))))
    assert [x.seal == y.seal for x, y in zip(a, b)] == [True, False, False]
    hits = identity.screen(spark.createDataFrame([(1, "Jon Smith")], "id long, n string"), spark.createDataFrame([(9, "John Smith"), (8, "Jane Doe")], "id long, n string"), "id", "n").collect()
    assert [(h.record, h.entry) for h in hits] == [(1, 9)]
    tri = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.65), (8, 9, 0.65)], "a long, b long, score double")
    got = {(r.a, r.b): r.score for r in identity.collective(tri).collect()}
    assert got[1, 3] >= 0.7 > got[8, 9]


def test_as_of(spark):
    e = spark.sql("select 1 id, timestamp'2024-01-01' valid_from, timestamp'2024-06-01' valid_to, timestamp'2024-01-05' ingested_at, cast(null as timestamp) superseded_at union all select 2, timestamp'2024-01-01', null, timestamp'2024-07-01', null")
    assert [r.id for r in identity.as_of(e, "2024-02-01", "2024-03-01").collect()] == [1]
    assert [r.id for r in identity.as_of(e, "2024-07-01", "2024-08-01").collect()] == [2]


def test_baseline(spark):
    a = spark.createDataFrame([(i, float(i % 5), "x") for i in range(50)], "id long, v double, k string")
    b = a.withColumn("v", F.col("v") + 100).withColumn("k", F.when(F.col("id") > 10, F.col("k")))
    found = {(r["column"], r.finding) for r in baseline.drift(baseline.create(a), baseline.create(b)).collect()}
    assert {("v", "mean_drift"), ("v", "bound_drift"), ("k", "null_drift")} <= found
    d = spark.createDataFrame([(i, i + 1, i * 2) for i in range(1, 40)], "lo long, hi long, z long")
    assert "not (lo > hi)" in {r.constraint for r in baseline.denial_constraints(d, ["lo", "hi"]).collect()}
    h = spark.createDataFrame([(i, "f1", 0.9) for i in range(8)] + [(8, "f1", 0.5)], "run_id long, key string, value double")
    assert [r.run_id for r in baseline.regressions(h, {"f1": 1}).collect()] == [8]


def test_sql_surface(spark):
    assert "tessera_email" in sql.register(spark)
    r = spark.sql("select tessera_email(' A.b+x@Y.org') e, tessera_phone('(212) 555-0100') p, tessera_whitespace(' a  b ') w, tessera_date('2024-02-30') d, round(tessera_jaro_winkler('MARTHA','MARHTA'), 4) j").first()
    assert tuple(r) == ("a.b@y.org", "+12125550100", "a b", "2024-02-30", 0.9611)
    spark.createDataFrame([(1, "Ann", "x"), (2, "ann", "x"), (3, "Bob", "y")], "id long, n string, g string").createOrReplaceTempView("people")
    out = sql.call(spark, "dedupe_table", "people", '{"id": "id", "passes": [[["g", []]]], "fields": [["n", "levenshtein", 1.0]], "threshold": 0.6}')
    assert {r.member: r.cluster_id for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    assert sql.call(spark, "profile_table", "people").count() == 3


def test_pipeline(spark):
    df = spark.createDataFrame([(1, " Ann  Meyer", "x"), (2, "Ann Meyer", "x"), (3, "Bob", "n/a")], "id long, n string, g string")
    cfg = {"match": {"id": "id", "passes": [[("g", [])]], "fields": [("n", "exact", 1.0)], "threshold": 1.0, "rules": {"n": "most_complete"}}}
    r = pipeline.run(df, cfg)
    assert r.log == ["check", "flow", "match"] and [x.n for x in r.data["golden"].collect()] == ["Ann Meyer"]
    with pytest.raises(NotImplementedError):
        pipeline.plan(["nothing"])
