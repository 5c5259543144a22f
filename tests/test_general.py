"""Broken references, change feed and history on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import history, references
from tessera.streaming import changefeed

T = [dt.datetime(2025, 1, d) for d in range(1, 29)]


def refs_and_nodes(spark):
    nodes = spark.createDataFrame(
        [("e1", "active", T[0]), (" E2 ", "Retired", T[0]), ("e3", "active", T[9]), ("e3", "active", T[9]), ("e4", None, None), (None, "active", T[0]), ("", "retired", T[0])],
        "entity_id string, status string, created_at timestamp",
    )
    rows = [("a", "E1 ", T[3]), ("b", "e2", T[3]), ("c", "e3", T[3]), ("d", "e3", T[10]), ("e", "zz", T[3]), ("f", None, T[3]), ("g", "  ", T[3]), ("h", "e3", None), ("i", "zz", None), ("j", "e4", T[0]), ("b", "e2", T[3])]
    rows += [(f"hot{i}", "zz", T[4]) for i in range(300)]
    df = spark.createDataFrame(rows, "pk string, ref string, t timestamp").withColumn("k", F.lit("clash"))
    return references.references(df, "tab", "ref", "pk", "t"), references.parent_index(nodes, "entity_id", "status", "created_at")


@pytest.mark.parametrize("per_range", [2, 100, 200_000])
def test_broken_references(spark, per_range):
    r, p = refs_and_nodes(spark)
    got = {(x.row_key, x.state) for x in references.broken_references(r, p, per_range).collect()}
    assert got == {("b", "deleted"), ("c", "late"), ("e", "missing"), ("i", "missing")} | {(f"hot{i}", "missing") for i in range(300)}
    by = {(x.state, x.period): x.misses for x in references.misses_by_period(references.broken_references(r, p, per_range)).collect()}
    assert by["missing", T[0]] == 301 and by["missing", None] == 1 and by["deleted", T[0]] == 1


def test_references_of_empty_tables(spark):
    r, p = refs_and_nodes(spark)
    assert references.broken_references(r.limit(0), p).count() == 0
    assert {x.state for x in references.broken_references(r, p.limit(0)).collect()} == {"missing"}


def test_positions(spark):
    cases = {
        "2025-04-22T08:39:27Z": "2025-04-22 08:39:27", "2025-04-28 23:33:20": "2025-04-28 23:33:20", "2025-02-23T09:25:44+02:00": "2025-02-23 07:25:44", "2025-04-20 06:15:20-05:00": "2025-04-20 11:15:20",
        "1744070843000": "2025-04-08 00:07:23", "1759134784": "2025-09-29 08:33:04", "2025-04-22": "2025-04-22 00:00:00", "rubbish": None, "": None, None: None, "2025-04-22T08:39:27+0200": "2025-04-22 06:39:27",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", changefeed.parse_position(F.col("v")).cast("string").alias("o"))
    assert {r.v: r.o for r in df.collect()} == cases


def feed(spark):
    state = spark.createDataFrame(
        [(1, "a", T[2], 10, None), (2, "a", T[3], None, "2025-01-05T00:00:00Z"), (3, "a", None, 99, "2025-01-20"), (4, "b", T[1], None, None), (2, "a", T[3], None, "2025-01-05T00:00:00Z")],
        "id long, source_table string, last_processed_at timestamp, last_row_id long, last_incremental_value string",
    )
    log = spark.createDataFrame([(5, "a", T[3]), (6, "a", T[7]), (10, "a", T[4]), (11, "a", T[0]), (12, "b", T[0]), (13, "c", None), (14, None, T[0]), (6, "a", T[7])], "row_id long, source string, last_seen_at timestamp")
    return state, log


def test_change_feed(spark, tmp_path):
    state, log = feed(spark)
    got = sorted(r.row_id for r in changefeed.ChangeFeed(spark, f"file://{tmp_path}/f").run(state, log).collect())
    assert got == [6, 11, 12, 13, 14]


def test_replay_after_failure(spark, tmp_path):
    state, log = feed(spark)
    home = f"file://{tmp_path}/f"
    first = changefeed.ChangeFeed(spark, home)
    n = first.plan(state, log)
    first.sink(n, first.capture(n, log).limit(2), ["row_id"], ["last_seen_at"])  # died half way, nothing committed
    later = state.unionByName(spark.createDataFrame([(9, "a", T[20], 1000, None)], state.schema))
    again = changefeed.ChangeFeed(spark, home)
    assert again.plan(later, log) == n  # the plan on record, not the newer state
    assert sorted(r.row_id for r in again.run(later, log).collect()) == [6, 11, 12, 13, 14]
    assert again.plan(later, log) == n + 1


def test_growing_log_dying_after_each_step(spark, tmp_path):
    """Whatever step a run dies after, and although the log grows meanwhile, every record comes out once."""
    schema = "row_id long, source string, last_seen_at timestamp"
    grown = [[(1, "a", T[0]), (2, None, T[0])], [(3, "a", T[1]), (4, "b", T[1])], [(5, "b", T[2])], [(6, "a", T[3]), (1, "a", T[9])], [(7, "c", None)]]
    none = spark.createDataFrame([], "id long, source_table string, last_processed_at timestamp, last_row_id long, last_incremental_value string")
    home, rows, out = f"file://{tmp_path}/g", [], []
    for step, more in enumerate(grown):
        # record 1 changes in the fourth step: its old version is gone from the log
        rows = [r for r in rows if r[0] not in {m[0] for m in more}] + more
        log = spark.createDataFrame([*rows, rows[0]], schema)
        f = changefeed.ChangeFeed(spark, home)
        n = f.plan(none, log)
        if step > 0:
            got = f.capture(n, log)
            if step > 1:
                f.sink(n, got, ["row_id"], ["last_seen_at"])
                if step > 2:
                    f.commit(n)
    for _ in range(4):
        changefeed.ChangeFeed(spark, home).run(none, log)
    stored = spark.read.parquet(*[f"{home}/batch/{i}" for i in changefeed.ChangeFeed(spark, home)._list("batch")])
    got = sorted((r.row_id, r.last_seen_at) for r in stored.collect() if r.row_id < 7)
    assert got == [(1, T[9]), (2, T[0]), (3, T[1]), (4, T[1]), (5, T[2]), (6, T[3])]
    assert stored.where("row_id = 7").count() == 1


def brute(rows):
    out, by = set(), {}
    for e, t, i, c in sorted({r for r in rows if r[0] is not None and r[1] is not None}, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(e, []).append((i, c))
    for e, seq in by.items():
        opens = [i for k, (i, c) in enumerate(seq) if k == 0 or seq[k - 1][1] != c]
        out |= {(e, a, b) for a, b in zip(opens, [*opens[1:], -1])}
    return out


@pytest.mark.parametrize("partitions", [1, 2, 3, 7, 16])
def test_history_against_brute_force(spark, partitions):
    import random

    rng = random.Random(partitions)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice(T), i, rng.choice("xxxy")) for i in range(200)] + [(None, T[0], 900, "x"), (1, None, 901, "x"), (4, T[0], 902, None), (4, T[1], 903, None)]
    df = spark.createDataFrame([*rows, rows[0]], "entity long, t timestamp, id long, content string").withColumn("block", F.lit(1))
    want = brute([(e, t, i, c or "null") for e, t, i, c in rows])
    assert {(r.entity, r.id_from, r.id_to) for r in history.coalesce_history(df, partitions).collect()} == want


def test_history_edges(spark):
    df = spark.createDataFrame([], "entity long, t timestamp, id long, content string")
    assert history.coalesce_history(df).count() == 0


def test_json_content(spark):
    vs = ['{"a": "1", "b": "é"}', '{"b":"\\u00e9","a":"1"}', '{"a":"1","b":"é","c":null}', '{"a":"1"}', "not json", None, '{"a":"1","b":""}']
    got = [r.h for r in spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v string").select("i", history.json_content(F.col("v")).alias("h")).orderBy("i").collect()]
    assert got[0] == got[1] == got[2] and len(set(got)) == 5
