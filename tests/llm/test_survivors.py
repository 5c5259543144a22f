import datetime as dt

from tessera.llm import survivors as S

T = [dt.datetime(2025, 1, d) for d in range(1, 9)]


def test_claims():
    got = S.claims_of('{"name": " Ann  Lee", "mail": "na@na.na", "contact": {"phone": "555", "x": null}, "born": 19000101, "tags": ["a", ""]}')
    assert [(c["field"], c["shown"]) for c in got] == [("full_name", "Ann Lee"), ("phone", "555"), ("tags[0]", "a")]
    assert S.claims_of(None) == [] and S.claims_of('{"cut": "of') == []


def test_survivors_and_values(spark):
    golden = spark.createDataFrame(
        [(1, 10, [1, 2], T[0]), (2, 10, [1, 2, 3, 3, 99], T[1]), (3, 10, [1], None), (4, 20, [4, 5], T[2]), (5, 30, [98], T[2]), (6, 40, None, T[2]), (7, 50, [6], T[3]), (4, 20, [4, 5], T[2])],
        "id long, cluster_id long, source_ids array<long>, merged_at timestamp",
    )
    recs = spark.createDataFrame(
        [
            (1, "s1", T[0], '{"first_name": "Ann", "city": "Rome"}'), (2, "s2", T[3], '{"first_name": "Ann", "city": "Oslo"}'), (3, "s3", T[3], '{"first_name": "Ann", "city": "Rome"}'), (3, "s3", T[3], '{"first_name": "Ann", "city": "Rome"}'),
            (4, "s1", T[5], '{"first_name": "B"}'), (5, "s1", T[1], '{"first_name": "B", "zip": "12345", "city": "?"}'), (6, None, None, None),
        ],
        "row_id long, source string, last_seen_at timestamp, payload string",
    )
    best, fused = S.resolve(golden, recs.withColumnRenamed("source", "source"))
    assert {(r.cluster_id, r.row_id, r.filled) for r in best.collect()} == {(10, 2, 2), (20, 5, 2), (50, 6, 0)}
    f = {r.cluster_id: r.record for r in fused.collect()}
    assert f[10] == {"first_name": "Ann", "city": "Rome"} and f[20]["zip"] == "12345"


def test_copied_votes_are_discounted(spark):
    rows = []
    for c in range(60):  # s1, s4 and s5 are independent; s3 copies s2, errors included
        truth, false = f"v{c}", f"w{c}"
        says = {"s1": truth, "s4": truth if c % 7 else f"x{c}", "s5": truth if c % 5 else f"y{c}", "s2": false if c % 2 else truth, "s3": false if c % 2 else truth}
        rows += [(c, i, s, T[0], "f", v, v) for i, (s, v) in enumerate(says.items())]
    claims = spark.createDataFrame(rows, "cluster_id long, row_id long, source string, last_seen_at timestamp, field string, value string, shown string")
    values, model = S.fuse(claims)
    assert model["dependence"]["s2", "s3"] > 0.9 > model["dependence"]["s1", "s4"]
    assert model["accuracy"]["s1"] > model["accuracy"]["s2"]
    top = {}
    for r in values.collect():
        if r.p > top.get(r.cluster_id, (0, ""))[0]:
            top[r.cluster_id] = (r.p, r.value)
    assert sum(v == f"v{c}" for c, (_, v) in top.items()) >= 58
    assert model.converged and all(0 < r.p < 1 for r in values.collect())
    by = {}
    for r in values.collect():
        by[r.cluster_id] = by.get(r.cluster_id, 0) + r.p
    assert max(by.values()) < 1  # values nobody claims keep their share


def test_copied_errors_do_not_outvote(spark):
    """Where only one good source is left against a wrong one and its copy, its single vote wins."""
    rows = []
    for c in range(200):
        t, w = f"t{c}", f"w{c}"
        says = {"good": t, "fair": t if c % 4 != 1 else f"u{c}", "plain": t if c % 4 != 1 else f"v{c}", "bad": w if c % 3 == 0 else t, "copy": w if c % 3 == 0 else t}
        rows += [(c, i, s, T[0], "f", v, v) for i, (s, v) in enumerate(says.items())]
    claims = spark.createDataFrame(rows, "cluster_id long, row_id long, source string, last_seen_at timestamp, field string, value string, shown string")
    values, model = S.fuse(claims)
    assert model.dependence["bad", "copy"] > 0.9 and model.accuracy["good"] > 0.9
    best = {}
    for r in values.collect():
        if r.p > best.get(r.cluster_id, (0, ""))[0]:
            best[r.cluster_id] = (r.p, r.value)
    assert sum(v == f"t{c}" for c, (_, v) in best.items()) >= 196


def test_posteriors_by_hand():
    import math

    # one source of accuracy 0.8 and 20 false values: its lone claim is right with 0.8
    s = math.log(20 * 0.8 / 0.2)
    assert abs(S.posteriors([s], [1], 20)[0] - 0.8) < 1e-9
    a, b = S.posteriors([s, s], [1, 1], 20)
    assert abs(a - b) < 1e-12 and abs(a - 80 / (160 + 19)) < 1e-9
    assert S.posteriors([900.0], [1], 20) == [1.0]


def test_empty(spark):
    golden = spark.createDataFrame([], "id long, cluster_id long, source_ids array<long>, merged_at timestamp")
    recs = spark.createDataFrame([], "row_id long, source string, last_seen_at timestamp, payload string")
    best, fused = S.resolve(golden, recs)
    assert best.count() == 0 and fused.count() == 0
