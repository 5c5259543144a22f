"""Consolidating pairwise matches into groups (connected components).

Method: repeatedly strip vertices of degree one and splice out vertices of
degree two (chains shrink by list ranking: in each round every chain vertex
that precedes its removable neighbours in a random order leaves the list, so a
chain of length n is gone after O(log n) rounds). What remains, the core in
which every vertex has three or more neighbours, is solved by contracting every
vertex into a neighbouring local minimum of a random order. Each removal leaves
one pointer; following the pointers restores the labels of removed vertices.

No step brings the edges of a vertex together: degrees are counted with partial
aggregation, removed edges are found by the pair, not by the vertex, and where
vertices take something from the vertex they point to, that vertex' row is sent to
as many parts as its pointers are cut into (see ``_follow``), so neither a hub nor
a giant component that holds a third of all links makes a hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, forget

#: Rows that may point to one vertex before they are cut into parts.
PART = 100_000


def _canonical(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _arcs(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("n")), F.struct(F.col("v").alias("x"), F.col("u").alias("n")))).alias("a")).select("a.*")


def strip(e: DataFrame, turn: int) -> DataFrame:
    """Vertices that leave the graph this round: x, n1, n2 (its neighbours, equal
    for degree one). No two of them are neighbours."""
    low = _arcs(e).groupBy("x").agg(F.count("*").alias("d"), F.min("n").alias("n1"), F.max("n").alias("n2")).where("d <= 2")
    ends = low.select("x", "d", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("n"))
    # a pair seen from both ends has two removable ends: one of them must stay
    both = ends.groupBy(F.least("x", "n").alias("a"), F.greatest("x", "n").alias("b")).agg(F.count("*").alias("c"), F.max(F.when(F.col("x") < F.col("n"), F.col("d"))).alias("da"), F.max(F.when(F.col("x") > F.col("n"), F.col("d"))).alias("db")).where("c = 2")
    later = F.xxhash64(F.lit(turn), "a") > F.xxhash64(F.lit(turn), "b")
    stays = both.select(F.when(F.col("da") < F.col("db"), F.col("b")).when((F.col("da") > F.col("db")) | (F.col("da") == 1) | later, F.col("a")).otherwise(F.col("b")).alias("x")).distinct()
    return low.join(stays, "x", "left_anti").select("x", "n1", "n2")


def without(e: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without the stripped vertices; a spliced vertex leaves a link between its neighbours."""
    lost = gone.select(F.explode(F.array_distinct(F.array(F.struct(F.least("x", "n1").alias("u"), F.greatest("x", "n1").alias("v")), F.struct(F.least("x", "n2").alias("u"), F.greatest("x", "n2").alias("v"))))).alias("p")).select("p.*")
    bridges = gone.where("n1 <> n2").select(F.col("n1").alias("u"), F.col("n2").alias("v"))
    return e.join(lost, ["u", "v"], "left_anti").unionByName(bridges).distinct()


def _follow(rows: DataFrame, to: DataFrame, key: str, how: str = "inner", part: int = PART) -> DataFrame:
    """``rows`` joined to ``to`` (one row per value of ``key``); a value that more than
    ``part`` rows carry is cut into parts, each of which meets its own copy of the row in ``to``."""
    hot = rows.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__c")).where(F.col("__c") > part).select("__k", F.ceil(F.col("__c") / part).cast("int").alias("__n"))
    x = rows.join(hot, F.col(key) == F.col("__k"), "left").withColumn("__s", F.pmod(F.xxhash64("x"), F.coalesce("__n", F.lit(1))).cast("int")).drop("__k", "__n")
    y = to.join(hot, F.col(key) == F.col("__k"), "left").withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__k", "__n")
    return x.join(y, [key, "__s"], how).drop("__s")


def contract(e: DataFrame, turn: int) -> DataFrame:
    """Core vertices to merge this round: x -> p, where p is a neighbour that is
    the first of its own neighbourhood in this round's random order."""
    key = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("i"))
    first = _arcs(e).groupBy("x").agg(F.min(key("n")).alias("m"))
    first = first.select("x", F.least(F.col("m"), key("x"))["i"].alias("p"))
    return _follow(first.where("x <> p"), first.where("x = p").select("p"), "p").select("x", "p")


def renamed(e: DataFrame, to: DataFrame) -> DataFrame:
    a, b = to.select(F.col("x").alias("u"), F.col("p").alias("pu")), to.select(F.col("x").alias("v"), F.col("p").alias("pv"))
    return _canonical(e.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v")))


def connected_groups(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """One row per linked vertex: ``vertex``, ``group`` (the smallest vertex
    reachable from it).

    Vertices are longs. Links may come in either order and repeated; a link with
    a null end or from a vertex to itself links nothing (a vertex that has no
    other link is left out). Extra columns are ignored; no links give no rows."""
    e = cut(_canonical(links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")))
    pointers, turn, left = [], 0, e.count()
    while left:
        gone = cut(strip(e, turn))
        pointers.append(gone)
        e = cut(without(e, gone), e)
        left, before = e.count(), left
        turn += 1
        if left > 0.7 * before:  # little to strip: the core
            to = cut(contract(e, turn))
            pointers.append(to)
            e = cut(renamed(e, to), e)
            left = e.count()
    if not pointers:
        return e.select(F.col("u").alias("vertex"), F.col("v").alias("group"))
    forest = None
    for p in pointers:
        f = p.select("x", F.col(p.columns[1]).alias("p"))
        forest = f if forest is None else forest.unionByName(f)
    forest, depth, parts = cut(forest), 1, pointers
    for p in parts:
        forget(p)
    while depth < len(parts):  # pointer doubling: no path is longer than the number of rounds
        up = forest.select(F.col("x").alias("p"), F.col("p").alias("q"))
        forest = cut(_follow(forest, up, "p", "left").select("x", F.coalesce("q", "p").alias("p")), forest)
        depth *= 2
    least = forest.groupBy("p").agg(F.least(F.min("x"), F.first("p")).alias("group"))
    least = cut(least)
    tree = _follow(forest, least, "p").select(F.col("x").alias("vertex"), "group")
    return tree.unionByName(least.select(F.col("p").alias("vertex"), "group"))


def record_links(records: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """Links u, v (row_id) between different existing records: edges of kind
    ``same_as`` and log rows with action ``merged``, in any letter case."""
    ids = records.select("row_id", "record_id")
    same = edges.where(F.lower(F.trim("kind")) == "same_as").where("record_a_id <> record_b_id").select("record_a_id", "record_b_id")
    a, b = ids.select(F.col("row_id").alias("u"), F.col("record_id").alias("record_a_id")), ids.select(F.col("row_id").alias("v"), F.col("record_id").alias("record_b_id"))
    named = same.join(a, "record_a_id").join(b, "record_b_id").select("u", "v")
    merged = log.where(F.lower(F.trim("action")) == "merged").select(F.col("record_id_a").alias("u"), F.col("record_id_b").alias("v")).where("u <> v")
    rows = ids.select("row_id")
    numbered = merged.join(rows.select(F.col("row_id").alias("u")), "u", "left_semi").join(rows.select(F.col("row_id").alias("v")), "v", "left_semi").select("u", "v")
    return named.unionByName(numbered)
