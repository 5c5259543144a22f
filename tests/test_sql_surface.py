"""The table functions and the operators over an order on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, matching, ordered, stats
from tessera.plans import sql


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann Lee", "rome"), (2, "Ann Leee", "rome"), (3, "Bob Ray", "oslo"), (4, "Bob Ray", "oslo"), (5, "Cy Dee", "oslo"), (6, None, None)]
    spark.createDataFrame(rows, "id long, name string, city string").createOrReplaceTempView("t_people")
    spark.createDataFrame([(1, 2, 0.9), (3, 4, 1.0)], "a long, b long, score double").createOrReplaceTempView("t_pairs")
    spark.createDataFrame([(2, 1), (4, 5)], "a long, b long").createOrReplaceTempView("t_truth")
    spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "member long, cluster_id long").createOrReplaceTempView("t_members")
    return spark


def test_table_functions(people):
    call = lambda f, t, **c: sql.call(people, f, t, json.dumps(c)).collect()
    passes = [[["city", ["strip"]]]]
    assert {(r.a, r.b) for r in call("dedupe_table", "t_people", id="id", passes=passes, fields=[["name", "levenshtein", 1.0]], threshold=0.8, output="pairs")} == {(1, 2), (3, 4)}
    assert {r.field for r in call("train_em", "t_people", id="id", passes=passes, fields=[["name", "levenshtein", [0.9, 0.5]]])} == {"name"}
    assert all(0 <= r.posterior <= 1 for r in call("score_probabilistic", "t_people", id="id", passes=passes, fields=[["name", "levenshtein", [0.9]]]))
    e = call("explain", "t_people", id="id", a=1, b=2, fields=[["name", "levenshtein", 2.0], ["city", "exact", 1.0]])
    assert {(r.field, round(r.score, 3)) for r in e} == {("name", 0.875), ("city", 1.0)}
    r = call("evaluate", "t_pairs", truth="t_truth")[0]
    assert (r.tp, r.fp, r.fn) == (1, 1, 1)
    assert call("evaluate_clusters", "t_members", truth="t_members")[0].f1 == 1.0
    assert call("compare_clusters", "t_members", other="t_members")[0].unchanged == 3
    assert call("postflight", "t_members")[0].matched == 4
    p = call("preflight", "t_people", id="id", passes=passes)[0]
    assert (p.rows, p.without_key, p.pairs) == (6, 1, 4)
    assert call("certify_keys", "t_people", key=["id"])[0]["groups"] == 6
    with pytest.raises(NotImplementedError):
        call("nothing", "t_people")


def test_splits_and_bridges(spark):
    """Two cliques held together by one weak link, and a path that is too long."""
    clique = [(a, b, 0.95) for k in (0, 10) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 10, 0.5)]
    e = spark.createDataFrame(clique, "a long, b long, score double")
    m = clusters.components(e)
    assert {(r.a, r.b) for r in clusters.bridges(m, e).collect()} == {(3, 10)}
    assert {r.cluster_id for r in clusters.split_bridges(m, e).collect()} == {0, 10}
    s = {r.member: r.cluster_id for r in clusters.split_by_tree(m, e, 4).collect()}
    assert s == {**{i: 0 for i in range(4)}, **{i: 10 for i in range(10, 14)}}
    assert clusters.spanning_tree(e).count() == 7
    path = spark.createDataFrame([(i, i + 1, 0.9) for i in range(30)], "a long, b long, score double")
    parts = clusters.split_by_tree(clusters.components(path), path, 7)
    size = [r["count"] for r in parts.groupBy("cluster_id").count().collect()]
    assert max(size) <= 7 and sum(size) == 31
    t = clusters.transitivity(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long")).first()
    assert (t.closed, t.open) == (3, 2)
    none = e.limit(0)
    assert clusters.spanning_tree(none).count() == 0 and clusters.transitivity(none).first().rate == 1.0


def test_order(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 7.0, "a"), (3, None, None), (4, 6.0, "a"), (4, 6.0, "a")], "k long, v double, g string")
    assert [r["diff"] for r in ordered.consecutive_diff(df.distinct(), "v", "k").orderBy("k").collect()] == [None, 2.0, None, None]
    r = ordered.is_sorted(df, "v", "k").first()
    assert (r.ascending, r.descending) == (False, False)
    assert ordered.unique(df, ["g"], "k", "last").count() == 2 and ordered.unique(df, ["k"], "k", "none").count() == 3
    assert ordered.stratified(df, "k", "g", 2).count() == 3
    big = spark.range(5000)
    a, b = ({x.id for x in ordered.sample(big, "id", s).collect()} for s in (0.1, 0.2))
    assert a < b and 350 < len(a) < 650
    assert ordered.ks_uniform(big, "id").first().d < 0.001
    # a right row in an earlier bucket, in the same one, none, and a null key
    left = spark.createDataFrame([(1, "x", "2025-01-03 10:00:00"), (2, "x", "2025-01-01 00:00:00"), (3, "y", "2025-01-03 00:00:00"), (4, None, "2025-01-03 00:00:00")], "i long, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([("x", "2025-01-02 09:00:00", 1), ("x", "2025-01-03 09:00:00", 2), ("x", "2025-01-03 11:00:00", 3), (None, "2025-01-01 00:00:00", 4)], "k string, t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    assert {r.i: r.v for r in ordered.as_of_join(left, right, "k", "t", ["v"]).collect()} == {1: 2, 2: None, 3: None, 4: None}


def test_assignment_and_chi_square():
    import itertools
    import random

    from tessera.operators import mapping

    rng = random.Random(3)
    for n, m in [(1, 1), (1, 4), (3, 3), (3, 5), (5, 6)]:
        c = [[rng.random() for _ in range(m)] for _ in range(n)]
        got = mapping.assign(c)
        assert len({j for _, j in got}) == n == len({i for i, _ in got})
        assert abs(sum(c[i][j] for i, j in got) - min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))) < 1e-6
    assert mapping.assign([]) == []
    assert abs(stats.gamma_q(4.0, 5.0) - 0.265026) < 1e-6 and abs(stats.gamma_q(0.5, 1.0) - 0.157299) < 1e-6 and stats.gamma_q(2.0, 0.0) == 1.0


def test_search_in_blocks(spark):
    import numpy as np

    v = np.random.default_rng(1).standard_normal((120, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None)], "id long, e array<double>")
    got = matching.top_k_search(df, df.where("id % 10 = 0"), "id", "e", 3, rows=25, block=4).collect()
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    for q in range(0, 120, 10):
        mine = [r.id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r.rank)]
        assert mine == sorted(range(120), key=lambda i: (-round(float(u[q] @ u[i]), 12), i))[:3]


def test_hot_keys_meet_in_parts(spark):
    """A tenth of the rows under one key: all pairs, in groups of bounded size."""
    from tessera.operators import blocking

    keys = spark.range(300).select("id", F.when(F.col("id") % 10 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    whole = {(r.a, r.b) for r in blocking.pairs_of(keys).collect()}
    parts = {(r.a, r.b) for r in blocking.pairs_of(keys, part=7).collect()}
    assert whole == parts and len([p for p in whole if p[0] % 10 == 0 and p[1] % 10 == 0]) == 30 * 29 // 2


def test_queries_and_sql_need_no_session():
    """The entry file imports, and gives queries and SQL, before any session is there."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
