import random

import pytest

from tessera.llm import groups


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def run(spark, pairs):
    out = groups.connected_groups(spark.createDataFrame(pairs, "u long, v long")).collect()
    got = {r.vertex: r.group for r in out}
    assert len(got) == len(out)
    return got


rng = random.Random(5)
SHAPES = {
    "path in order": [(i, i + 1) for i in range(120)],
    "path shuffled": [(a, b) for p in [rng.sample(range(1000), 90)] for a, b in zip(p, p[1:])],
    "cycle and triangle": [(i, (i + 1) % 17) for i in range(17)] + [(30, 31), (31, 32), (30, 32)],
    "star, repeated, reversed, self, null": [(7, i) for i in range(60) if i != 7] + [(3, 7), (7, 3), (9, 9), (100, 100), (None, 4), (5, None)],
    "cliques joined": [(a, b) for k in (0, 50, 90) for a in range(k, k + 8) for b in range(a + 1, k + 8)] + [(7, 50)],
    "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(260)],
}


@pytest.mark.parametrize("name", SHAPES)
def test_against_union_find(spark, name):
    assert run(spark, SHAPES[name]) == brute(SHAPES[name])


def test_no_links(spark):
    assert run(spark, [(1, 1), (None, None)]) == {}


def test_record_links(spark):
    recs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (4, None)], "row_id long, record_id string")
    edges = spark.createDataFrame([("a", "b", "same_as"), ("b", "zz", "same_as"), ("a", "c", "conflicts_with"), (None, "a", "same_as"), ("c", "c", "same_as")], "record_a_id string, record_b_id string, kind string")
    log = spark.createDataFrame([(2, 3, " Merged"), (3, 4, "skipped"), (4, 99, "merged")], "record_id_a long, record_id_b long, action string")
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in groups.record_links(recs, edges, log).collect()}
    assert got == {(1, 2), (2, 3)}
