"""Mixing sources to target weights.

Method: hash-threshold histograms. Every record has a hash of its id. Tokens are
summed by source and hash bucket; the cumulated histogram shows in which bucket
a source's budget is reached. Only that boundary bucket is refined, by the next
bits of the hash, until it holds the budget's edge exactly; the result is one
hash threshold per source, and records are chosen by comparing their hash with
it. Nothing is sorted. A budget of several times a source takes all records that
many times and the threshold for the rest (the thresholds are nested: a record
of the smaller share is in every larger one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import token_counts
from tessera.session import cut

BITS, LEVELS = 12, 5  # 5 levels of 4,096 buckets: 60 bits of hash
#: Sources up to which their few numbers are broadcast; beyond it rows meet them in SPREAD parts.
SOURCES, SPREAD = 100_000, 16


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows joined to the numbers of their source: broadcast while there are at most
    SOURCES of them, else spread, so that no source is a hot key."""
    if per_source.count() <= SOURCES:
        return rows.join(F.broadcast(per_source), "source")
    spread = per_source.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("__s", F.pmod("h", F.lit(SPREAD)).cast("int")).join(spread, ["source", "__s"]).drop("__s")


def _thresholds(sized: DataFrame, budget: DataFrame) -> DataFrame:
    """source, threshold: the records with h < threshold are the prefix (in order of
    hash) whose tokens come closest to the source's rest budget."""
    state = cut(budget.select("source", F.lit(0).cast("long").alias("base"), F.col("rest").alias("left")))
    rows = sized
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = _with(rows, state)
        if level:
            inside = inside.where(F.shiftright("h", shift + BITS) == F.shiftright("base", shift + BITS))
        if level == 1:  # from here on only the rows of the boundary buckets are read
            inside = cut(inside)
            rows = inside.select("source", "tokens", "h")
        hist = inside.groupBy("source", "base", "left", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("t"))
        # at most 4,096 buckets a source
        w = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        run = hist.withColumn("c", F.sum("t").over(w))
        edge = run.groupBy("source").agg(
            F.min(F.when(F.col("c") > F.col("left"), F.struct("b", (F.col("c") - F.col("t")).alias("before"), "t"))).alias("e"),
        )
        # a source that stays within its budget takes all that is left of its bucket
        # the record at the edge is taken if that brings the source closer to its budget
        closer = F.lit(0) if shift else F.when(F.col("e.t") < 2 * (F.col("left") - F.col("e.before")), 1).otherwise(0)
        state = state.join(edge, "source", "left").select(
            "source",
            F.when(F.col("e").isNotNull(), F.shiftleft(F.col("e.b"), shift) + closer).otherwise(F.lit(2**60) if level == 0 else F.col("base") + F.lit(1 << (shift + BITS))).alias("base"),
            F.when(F.col("e").isNotNull(), F.col("left") - F.col("e.before")).otherwise(F.lit(-1).cast("long")).alias("left"),
        )
        state = cut(state)
    return state.select("source", F.col("base").alias("threshold"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: doc_id, source, tokens, repeats for every record used at least once.
    shares: source, target_share, max_repeats, available_tokens, chosen_tokens,
    share_of_total, actual_share for every source of either table. A budget is a share
    of the total size; ``share_of_total`` compares what was chosen with the same total,
    ``actual_share`` with all that was chosen: where one source falls short, the
    others' part of the mix is larger than their target, and only there.

    The total size is ``total_tokens`` or, by default, the tokens of all
    documents. A source gets floor(share x total) tokens: whole repeats of all
    its records, then records by hash up to the rest, never more than
    ``max_repeats`` of one record; a source that is too small falls short, and
    ``actual_share`` says so. Sources without a target, null included, have share
    0. Repeated rows of a document count once; a null share or repeat limit counts as 0; texts without tokens are never chosen."""
    # repeated rows go once the texts are numbers
    sized = token_counts(docs, id, text, ("source",), vocabulary)
    sized = cut(sized.dropDuplicates([id]).select(F.col(id).alias("doc_id"), "source", "tokens", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id)), 4).alias("h")))
    size = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    total = total_tokens if total_tokens is not None else (sized.agg(F.sum("tokens")).first()[0] or 0)
    goals = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    want = F.floor(F.col("target_share") * F.lit(float(total)) + 1e-6).cast("long")
    plan = goals.join(size, "source").withColumn("want", want).where("available_tokens > 0")
    whole = F.floor(F.col("want") / F.col("available_tokens"))
    plan = plan.select("source", F.least(whole, "max_repeats").cast("int").alias("full"), F.when(whole >= F.col("max_repeats"), F.lit(0)).otherwise(F.col("want") - whole * F.col("available_tokens")).cast("long").alias("rest"))
    plan = cut(plan)
    plan = cut(plan.join(_thresholds(sized.where("tokens > 0"), plan.where("rest > 0")), "source", "left"))
    chosen = _with(sized, plan).withColumn("repeats", F.col("full") + F.coalesce((F.col("h") < F.col("threshold")).cast("int"), F.lit(0))).where("repeats > 0 and tokens > 0").select("doc_id", "source", "tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"))
    all_sources = size.join(goals, size["source"].eqNullSafe(goals["source"]), "full").select(F.coalesce(size["source"], goals["source"]).alias("source"), "available_tokens", "target_share", "max_repeats")
    shares = all_sources.join(used.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("chosen_tokens", F.lit(0)).alias("chosen_tokens"),
    )
    whole_used = used.agg(F.sum("chosen_tokens").alias("all_used"))
    shares = shares.crossJoin(F.broadcast(whole_used))  # one row
    of_total = F.lit(0.0) if not total else F.col("chosen_tokens") / F.lit(float(total))
    return chosen, shares.withColumn("share_of_total", of_total).withColumn("actual_share", F.coalesce(F.col("chosen_tokens") / F.col("all_used"), F.lit(0.0))).drop("all_used")
