"""Operators over an order: differences, as-of and range joins, versions, periods, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocking import ID, with_row_id


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all the columns are filled."""
    return df.dropna(subset=list(columns))


def unique(df: DataFrame, subset: list[str], order: str, keep: str = "first") -> DataFrame:
    """One row per value of ``subset`` (null is a value): the first or last by ``order``, or
    with ``keep`` none only the rows whose value is not repeated. Ties keep the least row by
    its text. Aggregated map-side, so a hot value is no hot task."""
    row = F.struct(*df.columns)
    by = F.struct(F.col(order).alias("o"), F.to_json(row).alias("t"))
    pick = {"first": F.min_by(row, by), "last": F.max_by(row, by), "none": F.min_by(row, by)}[keep]
    g = df.groupBy(*[F.col(c).alias(f"__{c}") for c in subset]).agg(pick.alias("__r"), F.count("*").alias("__n"))
    return (g.where("__n = 1") if keep == "none" else g).select("__r.*")


def sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About ``share`` of the rows, chosen by the hash of a key: the same rows on every run
    and partitioning, and a larger share holds a smaller one."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))


def stratified(df: DataFrame, key: str, by: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of every stratum (all of a smaller one): those of least hash of their key."""
    row = F.struct(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.struct(*df.columns).alias("r"))
    # the n least are kept while aggregating: first per part of a stratum, then of all parts
    part = df.select(by, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(64)).alias("__p"), row.alias("__x"))
    w1, w2 = Window.partitionBy(by, "__p").orderBy("__x.h", f"__x.r.{key}"), Window.partitionBy(by).orderBy("__x.h", f"__x.r.{key}")
    few = part.withColumn("__i", F.row_number().over(w1)).where(F.col("__i") <= n)
    return few.withColumn("__i", F.row_number().over(w2)).where(F.col("__i") <= n).select("__x.r.*")


def consecutive_diff(df: DataFrame, column: str, *order: str) -> DataFrame:
    """The columns of ``order``, value, diff: each value less the one before it in the order of
    the whole table (null for the first). Positions come from range partitions; a row meets
    its predecessor by position."""
    x = with_row_id(df.select(*order, F.col(column).alias("value")), *order)
    prev = x.select((F.col(ID) + 1).alias("__next"), F.col("value").alias("__before"))
    return x.join(prev, F.col(ID) == F.col("__next"), "left").select(*order, "value", (F.col("value") - F.col("__before")).alias("diff"))


def is_sorted(df: DataFrame, column: str, *order: str) -> DataFrame:
    """ascending, descending: whether the column never falls or never rises in that order (nulls are passed over)."""
    d = consecutive_diff(df.where(F.col(column).isNotNull()), column, *order)
    return d.agg(F.coalesce(F.min("diff") >= 0, F.lit(True)).alias("ascending"), F.coalesce(F.max("diff") <= 0, F.lit(True)).alias("descending"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str, value: list[str], bucket: str = "day") -> DataFrame:
    """``left`` with the columns ``value`` of the last row of ``right`` of the same key at or
    before its time (null without one; of equal times the greatest value counts).

    Time is cut into buckets, so a hot key is many groups: inside a bucket the last row
    is found by one ordered pass, and what a bucket starts with comes from the bucket
    ends before it (one row a key and bucket)."""
    b = F.date_trunc(bucket, F.col(time)).alias("__b")
    v = F.struct(*[F.col(c) for c in value])
    cols = left.columns
    lx = left.select(F.struct(*cols).alias("__l"), F.col(key).alias("__k"), F.col(time).alias("__t"), b, F.lit(1).alias("__side"), F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType).alias("__v"))
    rx = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.lit(None).cast(lx.schema["__l"].dataType).alias("__l"), F.col(key).alias("__k"), F.col(time).alias("__t"), b, F.lit(0).alias("__side"), v.alias("__v"))
    # the row a bucket leaves behind, handed on to later buckets
    ends = rx.groupBy("__k", "__b").agg(F.max(F.struct("__t", "__v")).alias("e"))
    every = ends.unionByName(lx.select("__k", "__b", F.lit(None).cast(ends.schema["e"].dataType).alias("e")).distinct()).groupBy("__k", "__b").agg(F.max("e").alias("e"))
    w = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    start = every.select(F.col("__k").alias("__sk"), F.col("__b").alias("__sb"), F.last("e.__v", ignorenulls=True).over(w).alias("__start"))
    inside = Window.partitionBy("__k", "__b").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    x = lx.unionByName(rx).withColumn("__last", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    x = x.join(start, F.col("__k").eqNullSafe(F.col("__sk")) & F.col("__b").eqNullSafe(F.col("__sb")), "left").withColumn("__last", F.coalesce("__last", "__start"))
    return x.select("__l.*", *[F.col(f"__last.{c}").alias(c) for c in value])


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float, on: str | None = None) -> DataFrame:
    """Points joined to the intervals [low, high] that hold them (and share ``on``). Both meet
    in cells of ``width``: an interval stands in every cell it touches, a point in one."""
    cell = lambda c: F.floor(F.col(c).cast("double") / width)
    p = points.withColumn("__c", cell(point))
    i = intervals.where(F.col(low) <= F.col(high)).withColumn("__c", F.explode(F.sequence(cell(low), cell(high))))
    return p.join(i, [*([on] if on else []), "__c"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__c")


def versions(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, keys, changing, share, kind: for how many keys an attribute has more than one
    value over the table's snapshots; ``slowly_changing`` above none and up to half of the keys."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) > 1).alias(c) for c in columns])
    flat = g.agg(F.count("*").alias("keys"), *[F.count_if(F.col(c)).alias(c) for c in columns])
    x = flat.select("keys", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changing")) for c in columns])).alias("x")).select("x.column", "keys", "x.changing")
    share = F.coalesce(F.try_divide("changing", "keys"), F.lit(0.0))
    return x.withColumn("share", share).withColumn("kind", F.when(F.col("changing") == 0, "fixed").when(F.col("share") <= 0.5, "slowly_changing").otherwise("fast_changing"))


def periods(df: DataFrame, time: str, measure: Column, period: str = "month") -> DataFrame:
    """period, value, previous, change, year_ago, running: a measure per period against the
    one before, the same period a year ago, and its running total (one row a period)."""
    g = df.where(F.col(time).isNotNull()).groupBy(F.date_trunc(period, time).alias("period")).agg(measure.alias("value"))
    w = Window.orderBy("period")
    ago = g.select(F.add_months("period", 12).cast("timestamp").alias("period"), F.col("value").alias("year_ago"))
    x = g.join(ago, "period", "left").withColumn("previous", F.lag("value").over(w))
    return x.select("period", "value", "previous", (F.try_divide(F.col("value"), F.col("previous")) - 1).alias("change"), "year_ago", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


def ks_uniform(df: DataFrame, column: str) -> DataFrame:
    """n, d: the Kolmogorov-Smirnov distance of a column from the uniform distribution between
    its least and greatest value, from the cumulated counts of its distinct values."""
    c = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    x = with_row_id(c, "x").withColumn("__p", F.spark_partition_id())
    lim = c.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("c").alias("n"))  # one row
    inside = Window.partitionBy("__p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    sizes = x.groupBy("__p").agg(F.sum("c").alias("s"), F.min("x").alias("m"))
    before = sizes.select("__p", F.coalesce(F.sum("s").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    r = x.withColumn("cum", F.sum("c").over(inside)).join(before, "__p").crossJoin(F.broadcast(lim)).withColumn("cum", F.col("cum") + F.col("b"))
    u = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(1.0))
    return r.agg(F.max("n").alias("n"), F.max(F.greatest(F.abs(F.col("cum") / F.col("n") - u), F.abs((F.col("cum") - F.col("c")) / F.col("n") - u))).alias("d"))
