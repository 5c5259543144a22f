"""Clusters of matched pairs: components, confidence, splits, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def components(pairs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """member, cluster_id (the least member). Ids without a pair stay single.

    Minimum labels with pointer jumping: every vertex takes the least label among
    its neighbours, then the label of that label, until nothing changes."""
    e = pairs.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    arcs = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = cut(arcs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("l")))
    while True:
        near = arcs.join(lab.select(F.col("v").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("n"))
        step = lab.join(near, lab["v"] == near["a"], "left").select("v", F.least("l", "n").alias("l"), F.col("l").alias("old"))
        up = step.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        new = cut(step.join(up, "l", "left").select("v", F.least("l", "ll").alias("l"), "old"))
        changed = new.where("l <> old").limit(1).count()
        lab = new.select("v", "l")
        if not changed:
            break
    out = lab.select(F.col("v").alias("member"), F.col("l").alias("cluster_id"))
    if ids is None:
        return out
    every = ids.select(F.col(ids.columns[0]).alias("member")).distinct()
    return every.join(out, "member", "left").select("member", F.coalesce("cluster_id", "member").alias("cluster_id"))


def confidence(members: DataFrame, scored: DataFrame) -> DataFrame:
    """cluster_id, size, edges, min_edge, avg_edge, confidence, quality.

    0.4 x least + 0.3 x mean edge + 0.3 x share of possible edges; a cluster whose
    mean exceeds its least edge by more than 0.3 is ``weak`` and keeps 0.7 of it."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    e = scored.join(members.select(F.col("member").alias("a"), "cluster_id"), "a").groupBy("cluster_id").agg(F.count("*").alias("edges"), F.min("score").alias("min_edge"), F.avg("score").alias("avg_edge"))
    x = size.join(e, "cluster_id", "left")
    conn = F.col("edges") / (F.col("size") * (F.col("size") - 1) / 2)
    conf = F.when(F.col("size") == 1, 1.0).otherwise(0.4 * F.col("min_edge") + 0.3 * F.col("avg_edge") + 0.3 * conn)
    weak = F.coalesce(F.col("avg_edge") - F.col("min_edge") > 0.3, F.lit(False))
    return x.select("cluster_id", "size", F.coalesce("edges", F.lit(0)).alias("edges"), "min_edge", "avg_edge", F.when(weak, 0.7 * conf).otherwise(conf).alias("confidence"), F.when(weak, "weak").otherwise("strong").alias("quality"))


def split_oversized(members: DataFrame, scored: DataFrame, max_size: int = 100, step: float = 0.05) -> DataFrame:
    """member, cluster_id: clusters above ``max_size`` lose their weakest links, a
    ``step`` of score at a time, until every part fits or only links of score 1 are left."""
    done, rest, cut_at = None, members, 0.0
    while True:
        size = rest.groupBy("cluster_id").agg(F.count("*").alias("n"))
        marked = cut(rest.join(size, "cluster_id"))
        fits = marked.where(f"n <= {max_size}").select("member", "cluster_id")
        done = fits if done is None else done.unionByName(fits)
        rest = marked.where(f"n > {max_size}").select("member", "cluster_id")
        low = scored.join(rest.select(F.col("member").alias("a")), "a", "left_semi")
        least = low.where(F.col("score") > cut_at).agg(F.min("score")).first()[0]
        if least is None or not rest.take(1):
            return done.unionByName(rest)
        cut_at = max(least, cut_at + step)
        rest = components(low.where(F.col("score") > cut_at), rest.select("member"))
        if cut_at >= 1:
            return done.unionByName(rest)


def spanning_tree(scored: DataFrame) -> DataFrame:
    """a, b, score of the maximum spanning forest: in every round each part takes its best
    edge to another part (ties: the least pair), so parts at least halve in number."""
    e = cut(dedup(scored))
    lab = cut(e.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v")))
    tree = None
    while True:
        x = e.join(lab.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(lab.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").where("ca <> cb")
        ends = x.select(F.explode(F.array("ca", "cb")).alias("c"), "a", "b", "score", "ca", "cb")
        # least of (-score, a, b) is the same edge seen from either part, so no cycle can form
        best = ends.groupBy("c").agg(F.min(F.struct((-F.col("score")).alias("o"), "a", "b", "ca", "cb")).alias("m")).select("m.*").distinct()
        best = cut(best)
        if not best.take(1):
            break
        pick = best.select("a", "b", (-F.col("o")).alias("score"))
        tree = pick if tree is None else tree.unionByName(pick)
        up = components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        lab = cut(lab.join(up, lab["c"] == up["member"], "left").select("v", F.coalesce("cluster_id", "c").alias("c")), lab)
    return cut(tree) if tree is not None else scored.select("a", "b", "score").limit(0)


def dedup(scored: DataFrame) -> DataFrame:
    return scored.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def tree_parts(max_size: int):
    """Of one cluster: rows (a, b, score, h) are edges, rows without b members. The parts that
    :func:`split_by_tree` cuts it into."""

    def labels(n, p, q):
        import numpy as np

        lab = np.arange(n)
        while True:
            low = np.minimum(lab[p], lab[q])
            new = lab.copy()
            np.minimum.at(new, lab[p], low)
            np.minimum.at(new, lab[q], low)
            while True:
                up = new[new]
                if (up == new).all():
                    break
                new = up
            if (new == lab).all():
                return lab
            lab = new

    def parts(table):
        import numpy as np
        import pyarrow as pa

        is_edge = np.asarray(table["b"].is_valid())
        who = table["a"].combine_chunks()
        member = who.filter(pa.array(~is_edge))
        member = member.take(pa.compute.sort_indices(member))
        n = len(member)
        edges = table.filter(pa.array(is_edge))
        p, q = (np.asarray(pa.compute.index_in(edges[c].combine_chunks(), value_set=member)) for c in "ab")
        score, h = np.asarray(edges["score"], float), np.asarray(edges["h"], np.int64)
        root, tree = list(range(n)), []
        for i in np.lexsort((q, p, -score)).tolist():
            x, y = int(p[i]), int(q[i])
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                tree.append(i)
        tree = np.array(tree, int)
        tree = tree[np.lexsort((h[tree], score[tree]))]  # the weakest first
        lab = np.zeros(n, int)  # the cluster as it came
        while True:
            size = np.bincount(lab, minlength=n)
            of = lab[p[tree]]
            order = np.argsort(of, kind="stable")
            first = np.searchsorted(of[order], of[order])
            cut_ = np.zeros(len(tree), bool)
            cut_[order] = np.arange(len(tree)) - first < -(-size[of[order]] // max_size) - 1
            tree = tree[~cut_]
            new = labels(n, p[tree], q[tree])
            if not cut_.any() and (new == lab).all():
                break
            lab = new
        return pa.table({"member": member, "cluster_id": member.take(pa.array(lab))})

    return parts


def split_by_tree(members: DataFrame, scored: DataFrame, max_size: int = 100, local_edges: int = 1_000_000) -> DataFrame:
    """member, cluster_id: a cluster of n members above ``max_size`` loses the
    ceil(n / max_size) - 1 weakest edges of its maximum spanning tree - no fewer could
    do -, and so does every part that is still too large, until all fit. Equal scores are
    ordered by a hash of the pair.

    A cluster of up to ``local_edges`` edges is cut in one group; greater ones all at
    once, in rounds over shared tables."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    marked = cut(members.join(size, "cluster_id"))
    small, large = marked.where(f"n <= {max_size}").select("member", "cluster_id"), marked.where(f"n > {max_size}").select("member", "cluster_id")
    e = dedup(scored).join(large.select(F.col("member").alias("a"), "cluster_id"), "a").join(large.select(F.col("member").alias("b"), "cluster_id"), ["b", "cluster_id"])
    e = cut(e.select("cluster_id", "a", "b", "score", F.xxhash64("a", "b").alias("h")))
    far = cut(e.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") > local_edges).select("cluster_id"))
    kind = dict(members.dtypes)["member"]
    rows = e.withColumn("score", F.col("score").cast("double")).unionByName(large.select("cluster_id", F.col("member").alias("a")), allowMissingColumns=True)
    out = small.unionByName(rows.join(far, "cluster_id", "left_anti").groupBy("cluster_id").applyInArrow(tree_parts(max_size), f"member {kind}, cluster_id {kind}"))
    if not far.take(1):
        return out
    return out.unionByName(_split_in_rounds(cut(large.join(far, "cluster_id", "left_semi").select("member", "cluster_id")), e.join(far, "cluster_id", "left_semi").select("a", "b", "score"), max_size))


def _split_in_rounds(large: DataFrame, inside: DataFrame, max_size: int) -> DataFrame:
    tree = cut(spanning_tree(inside))
    while True:
        size = large.groupBy("cluster_id").agg(F.count("*").alias("n")).where(f"n > {max_size}")
        of = tree.join(large.select(F.col("member").alias("a"), "cluster_id"), "a").join(size, "cluster_id")
        w = Window.partitionBy("cluster_id").orderBy("score", F.xxhash64("a", "b"))
        weak = cut(of.withColumn("i", F.row_number().over(w)).where(F.col("i") < F.ceil(F.col("n") / max_size)).select("a", "b"))
        if not weak.take(1):
            return large
        tree = cut(tree.join(weak, ["a", "b"], "left_anti"), tree, weak)
        large = cut(components(tree, large.select("member")), large)


def bridges(members: DataFrame, scored: DataFrame, below: float = 0.9) -> DataFrame:
    """a, b, score, cluster_id of weak transitive bridges: links under ``below`` whose two ends
    have no common neighbour, so nothing but the link itself holds them together."""
    e = dedup(scored)
    arcs = cut(e.select("a", F.col("b").alias("n")).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("n"))))
    weak = e.where(F.col("score") < below)
    tri = weak.join(arcs.withColumnRenamed("n", "z"), "a").join(arcs.select(F.col("a").alias("b"), F.col("n").alias("z")), ["b", "z"]).select("a", "b").distinct()
    return weak.join(tri, ["a", "b"], "left_anti").join(members.select(F.col("member").alias("a"), "cluster_id"), "a").select("a", "b", "score", "cluster_id")


def split_bridges(members: DataFrame, scored: DataFrame, below: float = 0.9) -> DataFrame:
    """member, cluster_id after the weak bridges are cut."""
    rest = dedup(scored).join(bridges(members, scored, below).select("a", "b"), ["a", "b"], "left_anti")
    return components(rest, members.select("member"))


def evaluate(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairwise and B-cubed precision, recall and f1 of two assignments (member, cluster_id)
    over the members of both, from the sizes of the overlaps: no pair is made."""
    o = predicted.select("member", F.col("cluster_id").alias("p")).join(truth.select("member", F.col("cluster_id").alias("t")), "member").groupBy("p", "t").agg(F.count("*").cast("double").alias("n"))
    o = cut(o)
    np_, nt = o.groupBy("p").agg(F.sum("n").alias("np")), o.groupBy("t").agg(F.sum("n").alias("nt"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    x = o.join(np_, "p").join(nt, "t").agg(two("n").alias("tp"), F.sum(F.col("n") * F.col("n") / F.col("np")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("nt")).alias("br"), F.sum("n").alias("members"))
    x = x.crossJoin(np_.agg(two("np").alias("pp"))).crossJoin(nt.agg(two("nt").alias("pt")))  # one row each
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = x.select(F.coalesce("members", F.lit(0.0)).cast("long").alias("members"), ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("pt")).alias("recall"), ratio(F.col("bp"), F.col("members")).alias("bcubed_precision"), ratio(F.col("br"), F.col("members")).alias("bcubed_recall"))
    f1 = lambda p, r: ratio(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))
    return x.withColumn("f1", f1("precision", "recall")).withColumn("bcubed_f1", f1("bcubed_precision", "bcubed_recall"))


def size_distribution(members: DataFrame) -> DataFrame:
    """size, clusters, records."""
    n = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return n.groupBy("size").agg(F.count("*").alias("clusters"), F.sum("size").alias("records"))


def match_rate(members: DataFrame) -> DataFrame:
    """records, matched, clusters, match_rate (share of records in a cluster of two or more), reduction (1 - clusters / records)."""
    n = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    x = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("matched"), F.count("*").alias("clusters"))
    return x.withColumn("match_rate", F.coalesce(F.try_divide("matched", "records"), F.lit(0.0))).withColumn("reduction", F.coalesce(1 - F.try_divide("clusters", "records"), F.lit(0.0)))


def transitivity(pairs: DataFrame) -> DataFrame:
    """closed, open, rate: of the paths a - b - c, how many are closed by a - c. Paths are
    counted from degrees; only triangles are made, each once, from its least vertex on."""
    e = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    d = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("d"))
    paths = d.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("paths"))
    tri = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(e.select("a", F.col("b").alias("c")), ["a", "c"]).agg(F.count("*").alias("t"))
    x = paths.crossJoin(tri).select((3 * F.col("t")).alias("closed"), F.coalesce("paths", F.lit(0.0)).cast("long").alias("paths"))
    return x.select("closed", (F.col("paths") - F.col("closed")).alias("open"), F.coalesce(F.try_divide("closed", "paths"), F.lit(1.0)).alias("rate"))


def add_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Incremental: new pairs join or merge existing clusters; members without one stay as they are."""
    label = members.select(F.col("member").alias("v"), F.col("cluster_id").alias("l"))
    e = pairs.join(label.withColumnRenamed("v", "a").withColumnRenamed("l", "la"), "a", "left").join(label.withColumnRenamed("v", "b").withColumnRenamed("l", "lb"), "b", "left")
    e = e.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    to = components(e).select(F.col("member").alias("c"), F.col("cluster_id").alias("t"))
    fresh = pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct().join(members, "member", "left_anti").withColumn("cluster_id", F.col("member"))
    every = members.unionByName(fresh)
    return every.join(to, every["cluster_id"] == to["c"], "left").select("member", F.coalesce("t", "cluster_id").alias("cluster_id"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """unchanged, merged, partitioned, overlapping clusters of a against b, and the
    Talburt-Wang index sqrt(|A| |B|) / |overlaps|."""
    o = a.select("member", F.col("cluster_id").alias("ca")).join(b.select("member", F.col("cluster_id").alias("cb")), "member").groupBy("ca", "cb").agg(F.count("*").alias("n"))
    na, nb = o.groupBy("ca").agg(F.count("*").alias("parts"), F.sum("n").alias("size_a")), o.groupBy("cb").agg(F.count("*").alias("sources"), F.sum("n").alias("size_b"))
    x = o.join(na, "ca").join(nb, "cb")
    per = x.groupBy("ca").agg(F.max("parts").alias("parts"), F.max("sources").alias("sources"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))
    kind = F.when((F.col("parts") == 1) & (F.col("sources") == 1), "unchanged").when((F.col("parts") == 1), "merged").when(F.col("sources") == 1, "partitioned").otherwise("overlapping")
    k = per.select(kind.alias("k"))
    t = o.agg(F.count_distinct("ca").alias("na"), F.count_distinct("cb").alias("nb"), F.count("*").alias("v"))
    return k.agg(*[F.count_if(F.col("k") == n).alias(n) for n in ("unchanged", "merged", "partitioned", "overlapping")]).crossJoin(t).select("unchanged", "merged", "partitioned", "overlapping", F.coalesce(F.try_divide(F.sqrt(F.col("na").cast("double") * F.col("nb")), F.col("v")), F.lit(1.0)).alias("twi"))


def label_propagation(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """member, community: the most frequent label among the neighbours (ties: the least), until
    stable; labels that still move after ``rounds`` rounds are an error."""
    e = pairs.select("a", "b").where("a <> b").distinct()
    arcs = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = arcs.select(F.col("a").alias("v")).distinct().withColumn("l", F.col("v"))
    for _ in range(rounds):
        votes = arcs.join(lab.select(F.col("v").alias("b"), "l"), "b").groupBy("a", "l").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("new"))
        step = cut(lab.join(best, lab["v"] == best["a"]).select("v", "new", "l"))
        moved = step.where("new <> l").limit(1).count()
        # an even/odd flip is broken by keeping the smaller of the two labels
        lab = step.select("v", F.least("new", "l").alias("l"))
        if not moved:
            return lab.select(F.col("v").alias("member"), F.col("l").alias("community"))
    raise RuntimeError(f"labels are not stable after {rounds} rounds")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """vertex, hop: what is within ``hops`` edges of a seed."""
    arcs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = seeds.select(F.col(seeds.columns[0]).alias("vertex")).distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        front = cut(front.join(arcs, front["vertex"] == arcs["a"]).select(F.col("b").alias("vertex")).distinct().join(seen, "vertex", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    return seen
