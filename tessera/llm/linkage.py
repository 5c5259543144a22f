"""Matching entities across sources without keys: collective graph linkage.

1. Records with certainly equal identity collapse into nodes (no pairs).
2. Candidate graph: nodes that share a rare combination of attributes are
   joined; an edge weighs the rarity of all it shares (log of inverse frequency).
3. Meta-blocking: an edge lighter than half of the mean edge of both its ends
   is pruned, unless it shares two contacts or dates at once.
4. Edges are scored; a shared contact counts less the more nodes hold it. Edges
   above the threshold form clusters. Then similarity is propagated: what any
   member of one cluster shares with any member of another counts for both; two
   clusters with a common relative (a neighbour of another first name at the same
   contact) support each other, the more the fewer relations that neighbour has; and
   profiles without a birth date join the best cluster among their neighbours. This
   repeats until no link is left; each turn merges two clusters at least, so it ends.

Every block emits all its pairs. A block of more than BLOCK nodes (a hot entity, a
shared mailbox) is salted into parts of about that size, and each two parts are
paired as a group of their own: no group is large, and nothing is dropped. The
pairs of a block grow with the square of its nodes, and on large tables nearly all
of them are namesakes and strangers of one birth date. A pair out of such a block
leaves it only if it can count (``_counts``); what it leaves behind is exact: equal
names with clashing birth dates can only forbid a merge, and that is looked up for
the clusters about to be merged (``_vetoed``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import people as P
from tessera.llm.groups import connected_groups
from tessera.operators.blocking import meetings
from tessera.session import cut, forget

BLOCK = 40
#: Contacts: what people share who live or work together.
CONTACTS = P.EMAIL | P.PHONE | P.ADDR
#: Support of a common relative with two relations; it falls with the log of their number.
RELATIVE = 2.2
#: Score of equal whole names and nothing else.
NAME_ALONE = 8.0


def _keys():
    """(bit, kind, key columns): the combinations of attributes that make a candidate."""
    names = P.whole_name()
    start = lambda c: F.when(F.length(F.regexp_replace(c, r"\.", "")) > 1, F.substring(c, 1, 2))
    out = []
    for bit, attr in ((P.EMAIL, "email"), (P.PHONE, "phone"), (P.ADDR, "addr"), (P.DOB, "dob")):
        # one kind for both parts of the name: they may be swapped
        out += [(bit, attr, [F.col(attr), start("n1")]), (bit, attr, [F.col(attr), start("n2")])]
        if attr != "dob":
            out += [(bit | P.DOB, attr + "+dob", [F.col(attr), F.col("dob")])]
    out += [(P.ZIP, "zip", [names, F.col("zip")]), (P.ZIP, "zip+name", [F.col("zip"), F.col("n1")]), (P.ZIP, "zip+name", [F.col("zip"), F.col("n2")]), (P.CITY, "city", [names, F.col("city")]), (P.NAMES, "names", [names])]
    return out


def key_rows(profiles: DataFrame) -> DataFrame:
    """node, bit, k, v: the distinct keys of every node; v (n1, n2, dob) is what ``_counts``
    needs of the node, null where a pair always counts."""
    needs = {P.DOB: ("n1", "n2"), P.NAMES: ("dob",)}
    v = lambda bit: F.when(F.lit(bit in needs), F.struct(*[(F.col(c) if c in needs.get(bit, ()) else F.lit(None).cast("string")).alias(c) for c in ("n1", "n2", "dob")]))
    arr = [F.when(reduce(and_, [c.isNotNull() for c in cols]), F.struct(F.lit(bit).alias("bit"), F.xxhash64(F.lit(kind), *cols).alias("k"), v(bit).alias("v"))) for bit, kind, cols in _keys()]
    return profiles.select("node", F.explode(F.array_compact(F.array(*arr))).alias("s")).select("node", "s.bit", "s.k", "s.v").distinct()


def _counts(pairs: DataFrame) -> DataFrame:
    """bit, w, a, b of the pairs (bit, w, x, y: structs of node and v) that can count. An equal
    birth date alone counts if the names are not another person's, or the last names are equal
    (a twin forbids a merge); an equal name alone if the birth dates do not clash. Neither
    adds to the score of what else a pair shares, so other pairs lose nothing here."""
    e = pairs.select("bit", "w", F.col("x.node").alias("a"), F.col("y.node").alias("b"), *[F.col(f"{s}.v.{c}").alias(f"{t}_{c}") for s, t in (("x", "a"), ("y", "b")) for c in ("n1", "n2", "dob")])
    return e.where(f"case when bit = {P.DOB} then coalesce(a_n2 = b_n2, false) or {P._NAMES} > -5 when bit = {P.NAMES} then {P._DATES} >= 0 else true end").select("bit", "w", "a", "b")


def namesakes(rows: DataFrame) -> DataFrame:
    """vertex, k, dob: the dated nodes whose whole name (k) occurs with several birth dates."""
    dated = rows.where((F.col("bit") == P.NAMES) & F.col("v.dob").isNotNull()).select(F.col("node").alias("vertex"), "k", F.col("v.dob").alias("dob"))
    return dated.join(dated.groupBy("k").agg(F.min("dob").alias("lo"), F.max("dob").alias("hi")).where("lo < hi").select("k"), "k", "left_semi").select("vertex", "k", "dob")


def _vetoed(links: DataFrame, named: DataFrame) -> DataFrame:
    """The links a, b between clusters that hold one whole name with clashing birth dates."""
    a, b = (named.select(F.col("vertex").alias(x), "k", F.col("dob").alias(f"{x}_dob")) for x in "ab")
    return links.join(a, "a").join(b, ["b", "k"]).where(f"{P._DATES} < 0").select("a", "b").distinct()


def candidate_graph(rows: DataFrame, nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(edges, load). Edges a < b with mask (what is shared), w (its rarity), crowd (log of half the
    number of nodes that hold the rarest contact shared, 0 without one) and weak (keys among
    them whose pairs must count). Load, of every node x that shares a key: total, the rarity of
    all its pairs, and weak, the pairs of its weak keys, counting or not."""
    n = float(max(nodes.count(), 2))
    rarity = lambda c: F.struct(F.log(F.lit(n) / c).cast("float").alias("w"), F.when(F.col("bit").bitwiseAND(CONTACTS) > 0, F.log(c / 2)).cast("float").alias("crowd")).alias("w")
    hot = cut(rows.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > block))
    m = rows.join(hot, "k", "left_anti").groupBy("k", "bit").agg(F.collect_set(F.struct("node", "v")).alias("m")).where(F.size("m") > 1)
    small = cut(m.select("bit", rarity(F.size("m")), "m"))
    pairs = _counts(small.select("bit", "w", F.explode("m").alias("x"), "m").select("bit", "w", "x", F.explode("m").alias("y")).where("x.node < y.node"))
    # a node meets its own part and every other part once
    many = rows.join(hot, "k").select("k", "bit", rarity(F.col("c")), "node", "v", "c")
    salt = many.withColumn("n", F.ceil(F.col("c") / block)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    salt = salt.select("k", "bit", "w", "node", "v", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("o"))
    met = salt.groupBy("k", "bit", "w", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j")).agg(F.collect_set(F.struct("node", "v", "own")).alias("m"))
    met = met.select("bit", "w", "i", "j", F.explode("m").alias("x"), "m").select("bit", "w", "i", "j", "x", F.explode("m").alias("y")).where("x.node < y.node and (i = j or x.own <> y.own)")
    weak = F.col("bit").isin(P.DOB, P.NAMES)
    both = pairs.unionByName(_counts(met)).groupBy("a", "b")
    edges = cut(both.agg(F.bit_or("bit").alias("mask"), F.sum("w.w").alias("w"), F.coalesce(F.min("w.crowd"), F.lit(0.0)).cast("double").alias("crowd"), F.count_if(weak).alias("weak")))
    held = small.select(F.explode("m.node").alias("x"), "bit", "w", F.size("m").cast("long").alias("c")).unionByName(many.select(F.col("node").alias("x"), "bit", "w", "c"))
    load = cut(held.groupBy("x").agg(F.sum((F.col("c") - 1) * F.col("w.w")).alias("total"), F.sum(F.when(weak, F.col("c") - 1).otherwise(0)).alias("weak")), small, hot)
    return edges, load


def meta_block(edges: DataFrame, load: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted node pruning: an edge stays if it has half the mean weight of the edges at
    either end, or shares two or more of mail, phone, address and birth date. The mean is over
    all pairs of a node's blocks, also those that cannot count and are no edge. Edges come out
    with the profiles of both ends."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("x"), "weak").groupBy("x").agg(F.count("*").alias("kept"), F.sum("weak").alias("kept_weak")).join(load, "x")
    ends = ends.select(F.col("x").alias("node"), (F.col("total") / (F.col("kept") + F.col("weak") - F.col("kept_weak")) / 2).alias("m"))
    ends = cut(nodes.join(ends, "node"))
    a, b = (ends.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n1", "n2", "dob", "m")]) for x in "ab")
    sure = F.bit_count(F.col("mask").bitwiseAND(CONTACTS | P.DOB)) >= 2
    return edges.join(a, "a").join(b, "b").where((F.col("w") >= F.least("a_m", "b_m")) | sure).drop("w", "weak", "a_m", "b_m")


def _relabel(e: DataFrame, to: DataFrame) -> DataFrame:
    """Edges between the groups of ``to`` (vertex, group, open)."""
    for x in "ab":
        t = to.select(F.col("vertex").alias(x), F.col("group").alias("__g"), F.col("open").alias("__o"))
        e = e.join(t, x, "left").withColumns({x: F.coalesce("__g", x), f"{x}_open": F.coalesce("__o", f"{x}_open")}).drop("__g", "__o")
    return e.where("a <> b")


def _pooled(e: DataFrame) -> DataFrame:
    flip = F.col("a") > F.col("b")
    x = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "mask", "base", "clash", F.when(flip, F.col("b_open")).otherwise(F.col("a_open")).alias("a_open"), F.when(flip, F.col("a_open")).otherwise(F.col("b_open")).alias("b_open"))
    return x.groupBy("a", "b").agg(F.bit_or("mask").alias("mask"), F.max("base").alias("base"), F.max("clash").alias("clash"), F.min("a_open").alias("a_open"), F.min("b_open").alias("b_open"))


def _supported(p: DataFrame) -> DataFrame:
    """Pooled edges with s, their score; what falls short of the threshold by no more
    than RELATIVE gets the support of common relatives."""
    total = F.col("base") + P.shared_score(F.col("mask"))
    p = p.withColumn("s", total)
    weak = p.where(~F.col("clash") & (F.col("s") < P.ACCEPT) & (F.col("s") >= P.ACCEPT - RELATIVE)).select("a", "b")
    kin = p.where((F.col("base") <= -20) & (F.col("mask").bitwiseAND(CONTACTS) > 0))
    arcs = kin.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("z")), F.struct(F.col("b").alias("x"), F.col("a").alias("z")))).alias("e")).select("e.*")
    # a relative of one node only is common to none
    worth = arcs.groupBy("z").agg(F.count("*").alias("d")).where("d > 1").select("z", (RELATIVE * F.log(F.lit(3.0)) / F.log(1.0 + F.col("d"))).alias("v"))
    arcs = arcs.join(worth, "z")
    near = weak.join(arcs.select(F.col("x").alias("a"), "z", "v"), "a").join(arcs.select(F.col("x").alias("b"), "z"), ["b", "z"]).groupBy("a", "b").agg(F.max("v").alias("v"))
    return p.join(near, ["a", "b"], "left").withColumn("s", F.col("s") + F.coalesce("v", F.lit(0.0))).drop("v")


def clusters(scored: DataFrame, named: DataFrame | None = None) -> DataFrame | None:
    """vertex, group for every node linked to another; None if no two are. ``named``
    (see :func:`namesakes`, made by a cut) forbids links that no edge in ``scored`` forbids."""
    # weak edges stay for pooling, clashes as a veto, other people at the same contact as relatives
    p = cut(_pooled(scored.where((F.col("base") + P.shared_score(F.col("mask")) >= 2.0) | F.col("clash") | (F.col("mask").bitwiseAND(CONTACTS) > 0))))
    labels = None
    while True:
        good = _supported(p).where("not clash")
        sure = good.where("not a_open and not b_open").where(F.col("s") >= P.ACCEPT).select("a", "b", "a_open", "b_open")
        # a profile without a birth date joins one cluster only: the best of its neighbours
        # or, by its whole name alone, the only one of that name
        open_ = good.where("a_open or b_open").where(F.col("s") >= NAME_ALONE)
        both = (F.col("a_open") & F.col("b_open")).alias("both")
        ends = open_.select(F.when(F.col("a_open"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("a_open"), F.col("b")).otherwise(F.col("a")).alias("y"), "s", both)
        ends = ends.unionByName(open_.where("a_open and b_open").select(F.col("b").alias("x"), F.col("a").alias("y"), "s", both))
        best = ends.groupBy("x").agg(F.max_by(F.struct("y", "both"), F.struct((F.col("s") >= P.ACCEPT).alias("g"), ~F.col("both"), "s", -F.col("y"))).alias("y"), F.max("s").alias("s"), F.count("*").alias("n")).where((F.col("s") >= P.ACCEPT) | (F.col("n") == 1)).select(F.col("x").alias("a"), F.col("y.y").alias("b"), F.lit(True).alias("a_open"), F.col("y.both").alias("b_open"))
        links = cut(sure.unionByName(best))
        if named is not None:
            links = cut(links.join(_vetoed(links, named), ["a", "b"], "left_anti"), links)
        if not links.take(1):
            forget(p)
            return labels
        step = cut(connected_groups(links, "a", "b"))
        if labels is None:
            labels = step
        else:
            old = labels
            moved = old.join(step.select(F.col("vertex").alias("group"), F.col("group").alias("g2")), "group", "left").select("vertex", F.coalesce("g2", "group").alias("group"))
            fresh = step.join(old.select("vertex"), "vertex", "left_anti")
            labels = cut(moved.unionByName(fresh))
        # a group is open if all its members are
        dated = links.select(F.col("a").alias("vertex"), F.col("a_open").alias("o")).unionByName(links.select(F.col("b").alias("vertex"), F.col("b_open").alias("o")))
        to = cut(step.join(dated.join(step, "vertex").groupBy("group").agg(F.min("o").alias("open")), "group").select("vertex", "group", "open"), links)
        if named is not None:
            named = cut(named.join(to, "vertex", "left").select(F.coalesce("group", "vertex").alias("vertex"), "k", "dob").distinct(), named)
        p = cut(_pooled(_relabel(p, to)), p, to)


def link(records: DataFrame, fields: dict = P.FIELDS, stand_ins=P.STAND_INS) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(members, entities, support). members: row_id, source, node for each record
    with a name and another attribute; entities: vertex (node), group (None if no
    two nodes are linked; a node alone has no row); support: x (node), s (its best
    score). A node is named by its least row_id. Records whose payload is null or empty match nothing."""
    rec = P.profiles(records, "row_id", "source", fields=fields, stand_ins=stand_ins).where(P.known()).select("*", *P.identity())
    who = cut(rec.groupBy("h1", "h2").agg(F.min("row_id").alias("node"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.first("dob").alias("dob")))
    rec = cut(rec.join(who.select("h1", "h2", "node"), ["h1", "h2"]).drop("h1", "h2"))
    nodes = who.select("node", "n1", "n2", "dob")
    rows = cut(key_rows(rec))
    named = cut(namesakes(rows))
    graph, load = candidate_graph(rows, nodes)
    scored = cut(P.scored_edges(meta_block(graph, load, nodes)), rows, graph, load)
    total = (F.col("base") + P.shared_score(F.col("mask"))).alias("s")
    support = scored.select(F.explode(F.array("a", "b")).alias("x"), total).groupBy("x").agg(F.max("s").alias("s"))
    return rec.select("row_id", "source", "node"), clusters(scored, named), support


def _members(records: DataFrame, confidence: bool, **params) -> DataFrame:
    rec, ent, support = link(records, **params)
    m = rec.withColumn("group", F.col("node")) if ent is None else rec.join(ent.select(F.col("vertex").alias("node"), "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    if confidence:
        m = m.join(support.withColumnRenamed("x", "node"), "node", "left")
    return cut(m.select("row_id", "source", "group", *(["node", "s"] if confidence else [])).dropDuplicates(["row_id"]))


def entities(records: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """(links, members): the result in linear size. links: node_a < node_b, confidence of
    each node against the node its entity is named after; members: row_id, source, node,
    entity of every record with a name and another attribute."""
    m = _members(records, True, **params).select("row_id", "source", "node", F.col("group").alias("entity"), "s")
    n = m.where("node <> entity").groupBy(F.col("entity").alias("node_a"), F.col("node").alias("node_b")).agg(F.max("s").alias("s"))
    return n.select("node_a", "node_b", F.round(_logistic(F.coalesce("s", F.lit(P.ACCEPT))), 4).alias("confidence")), m.drop("s")


def _logistic(s):
    return 1 / (1 + F.exp((P.ACCEPT - s) / 3))


def matched_pairs(records: DataFrame, confidence: bool = False, **params) -> DataFrame:
    """row_id_a < row_id_b of different sources describing one entity; on request
    with a confidence: near 1 for records of one node, else a logistic function of
    the weaker record's best score against the threshold. A hot entity meets in parts."""
    m = meetings(_members(records, confidence, **params), ["group"], "row_id").where("x.source <> y.source")
    ids = [F.col("x.row_id").alias("row_id_a"), F.col("y.row_id").alias("row_id_b")]
    if not confidence:
        return m.select(*ids)
    c = F.when(F.col("x.node") == F.col("y.node"), F.lit(0.999)).otherwise(_logistic(F.least(F.coalesce("x.s", F.lit(P.ACCEPT)), F.coalesce("y.s", F.lit(P.ACCEPT)))))
    return m.select(*ids, F.round(c, 4).alias("confidence"))
