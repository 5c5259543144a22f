"""The identity graph: nodes over time, merges and splits, crosswalk, audit, screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fuzzy, scorers
from tessera.operators import clusters
from tessera.session import cut


def as_of(edges: DataFrame, valid: str, known: str) -> DataFrame:
    """Rows visible at a valid time as it was known at a transaction time: columns
    valid_from, valid_to, ingested_at, superseded_at (null ends are open)."""
    v, t = F.lit(valid).cast("timestamp"), F.lit(known).cast("timestamp")
    return edges.where((F.col("valid_from") <= v) & (F.col("valid_to").isNull() | (v < F.col("valid_to"))) & (F.col("ingested_at") <= t) & (F.col("superseded_at").isNull() | (t < F.col("superseded_at"))))


def stabilise(old: DataFrame, new: DataFrame) -> DataFrame:
    """member, entity_id for new clusters: a cluster keeps the old entity it shares
    most members with (ties: the least id), if that entity's largest part is this
    cluster; otherwise it is a new entity named after its least member."""
    o = new.join(old.select("member", F.col("cluster_id").alias("entity")), "member").groupBy("cluster_id", "entity").agg(F.count("*").alias("n"))
    mine = o.groupBy("cluster_id").agg(F.max_by("entity", F.struct("n", -F.col("entity"))).alias("entity"))
    theirs = o.groupBy("entity").agg(F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("cluster_id"))
    keep = mine.join(theirs, ["cluster_id", "entity"])
    return new.join(keep, "cluster_id", "left").select("member", F.coalesce("entity", "cluster_id").alias("entity_id"))


def events(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind (created, merged, split), entity, other: what changed between two assignments."""
    o, n = old.select("member", F.col("cluster_id").alias("a")), new.select("member", F.col("cluster_id").alias("b"))
    x = o.join(n, "member").groupBy("a", "b").agg(F.count("*").alias("k"))
    merged = x.groupBy("b").agg(F.count("*").alias("c"), F.min("a").alias("entity")).where("c > 1").join(x, "b").where("a <> entity").select(F.lit("merged").alias("kind"), "entity", F.col("a").alias("other"))
    split = x.groupBy("a").agg(F.count("*").alias("c"), F.min("b").alias("first")).where("c > 1").join(x, "a").where("b <> first").select(F.lit("split").alias("kind"), F.col("a").alias("entity"), F.col("b").alias("other"))
    created = n.join(o, "member", "left_anti").join(x.select("b").distinct(), "b", "left_anti").select(F.lit("created").alias("kind"), F.col("b").alias("entity"), F.lit(None).cast("long").alias("other")).distinct()
    return merged.unionByName(split).unionByName(created)


def crosswalk(records: DataFrame, members: DataFrame, source: str, pk: str, record: str) -> DataFrame:
    """source, source_pk, entity_id for every assigned record."""
    return records.select(F.col(source).alias("source"), F.col(pk).alias("source_pk"), F.col(record).alias("member")).join(members, "member").select("source", "source_pk", F.col("cluster_id").alias("entity_id")).distinct()


def seal(log: DataFrame, order: str, block: int = 10_000, segment: int = 500) -> DataFrame:
    """Audit seals of an append-only log: a digest per block of ``block`` order values,
    chained within segments of ``segment`` blocks and over the heads of the segments
    before, so a later change of any row breaks the chain. A segment is folded in one
    pass; only the heads (one a segment) stand in one window."""
    rest = [c for c in log.columns if c != order]
    h = log.select(F.floor(F.col(order) / block).alias("block"), F.sha2(F.to_json(F.struct(order, *rest)), 256).alias("h"))
    # the order-independent sum of row digests keeps a block out of a single buffer
    parts = h.groupBy("block").agg(F.count("*").alias("rows"), *[F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)])
    own = parts.select("block", "rows", F.sha2(F.concat_ws(":", "block", "rows", *[f"s{i}" for i in range(5)]), 256).alias("digest"))
    seg = own.groupBy(F.floor(F.col("block") / segment).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("block", "rows", "digest"))).alias("b"))
    # (chain so far, links): each block's link is the digest of the last link and its own digest
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("links"))

    def step(acc, x):
        link = F.sha2(F.concat(acc["last"], x["digest"]), 256)
        return F.struct(link.alias("last"), F.concat(acc["links"], F.array(link)).alias("links"))

    seg = cut(seg.select("seg", "b", F.aggregate("b", start, step).alias("c")))
    w = Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)  # one row per segment
    heads = seg.select("seg", F.coalesce(F.array_join(F.collect_list("c.last").over(w), ""), F.lit("")).alias("before"))
    x = seg.join(heads, "seg").select("before", F.explode(F.arrays_zip("b", F.col("c.links").alias("links"))).alias("z"))
    return x.select("z.b.block", "z.b.rows", "z.b.digest", F.sha2(F.concat("before", "z.links"), 256).alias("seal"))


def screen(records: DataFrame, watchlist: DataFrame, id: str, name: str, threshold: float = 0.85, top: int = 3) -> DataFrame:
    """record, entry, score, reason: the best ``top`` entries of a watchlist per record,
    among those that share a token with it."""
    tok = lambda d, x: d.select(F.col(id).alias(x), F.col(name).alias(f"{x}_name"), F.explode(F.array_distinct(F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1))).alias("k"))
    p = tok(records, "record").join(tok(watchlist, "entry"), "k").groupBy("record", "entry", "record_name", "entry_name").agg(F.array_sort(F.collect_set("k")).alias("shared"))
    s = p.withColumn("score", scorers.ensemble(F.lower("record_name"), F.lower("entry_name"))).where(F.col("score") >= threshold)
    w = Window.partitionBy("record").orderBy(F.desc("score"), "entry")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("record", "entry", "score", F.concat(F.lit("shares "), F.array_join("shared", ", ")).alias("reason"))


def private_linkage(a: DataFrame, b: DataFrame, id: str, columns: list[str], threshold: float = 0.85, preset: str = "default", key: bytes = b"", bands: int = 32) -> DataFrame:
    """a, b, score by Dice of encoded keys; candidates share a band of the filter, so
    no cleartext and no cross join is needed."""

    def enc(d, x):
        e = cut(d.select(F.col(id).alias(x), fuzzy.clk(columns, preset, key).alias(f"k{x}")).where(f"k{x} is not null"))
        return e, e.select(x, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substr(F.hex(f"k{x}"), i * (F.length(F.hex(f"k{x}")) / bands).cast("int") + 1, (F.length(F.hex(f"k{x}")) / bands).cast("int")))).alias("i", "band")).where(~F.col("band").rlike("^0+$"))

    (ea, ka), (eb, kb) = enc(a, "a"), enc(b, "b")
    p = ka.join(kb, ["i", "band"]).select("a", "b").distinct()
    return p.join(ea, "a").join(eb, "b").select("a", "b", fuzzy.clk_dice(F.col("ka"), F.col("kb")).alias("score")).where(F.col("score") >= threshold)


def collective(scored: DataFrame, alpha: float = 0.3, threshold: float = 0.7) -> DataFrame:
    """a, b, score refined by neighbours: (1 - alpha) x attribute score + alpha x the
    share of each other's neighbours they have in common. A score never falls again, so
    the accepted pairs only grow, and the rounds end when they no longer do."""
    now = cut(scored.select("a", "b", F.col("score").alias("attr"), F.col("score")))
    accepted = -1
    while True:
        good = cut(now.where(F.col("score") >= threshold).select("a", "b"))
        n = good.count()
        if n == accepted:
            return now.select("a", "b", "score")
        accepted = n
        arcs = good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b")))
        deg = arcs.groupBy("a").agg(F.count("*").alias("d"))
        common = now.select("a", "b").join(arcs.select("a", F.col("b").alias("z")), "a").join(arcs.select(F.col("a").alias("b"), F.col("b").alias("z")), ["b", "z"]).groupBy("a", "b").agg(F.count("*").alias("c"))
        x = now.join(common, ["a", "b"], "left").join(deg, "a", "left").join(deg.select(F.col("a").alias("b"), F.col("d").alias("e")), "b", "left")
        nb = F.coalesce(F.try_divide(F.col("c"), F.coalesce("d", F.lit(0)) + F.coalesce("e", F.lit(0)) - F.col("c")), F.lit(0.0))
        now = cut(x.select("a", "b", "attr", F.greatest("score", F.when(nb > 0, F.col("attr") * (1 - alpha) + alpha * nb)).alias("score")), now)


def resolve_profiles(scored: DataFrame, threshold: float) -> DataFrame:
    return clusters.components(scored.where(F.col("score") >= threshold))
