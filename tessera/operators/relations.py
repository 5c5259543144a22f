"""Relations between columns and tables: keys, dependencies, order, references."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def composite_keys(df: DataFrame, candidates: list[str], max_size: int = 3) -> list[tuple[str, ...]]:
    """Minimal column sets of 2 to ``max_size`` with as many distinct tuples as rows,
    none of whose parts is a key. One aggregate per size; only counts come back."""
    n = df.count()
    found: list[tuple[str, ...]] = []
    keys = {(c,) for c, k in zip(candidates, df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).alias(c) for c in candidates]).first() or []) if k == n}
    for size in range(2, max_size + 1):
        sets = [s for s in combinations(candidates, size) if not any(set(k) <= set(s) for k in [*found, *keys])]
        if not sets:
            continue
        row = df.agg(*[F.count_distinct(F.struct(*s)).alias(str(i)) for i, s in enumerate(sets)]).first()
        found += [s for i, s in enumerate(sets) if row[i] == n]
    return found


def functional_dependencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """determinant, dependent of every exact dependency; unique determinants and
    constant columns are skipped."""
    n, spark = df.count(), df.sparkSession
    pairs = [(a, b) for a in columns for b in columns if a != b]
    single = df.agg(*[F.count_distinct(F.struct(c)).alias(c) for c in columns]).first()
    pairs = [(a, b) for a, b in pairs if 1 < single[a] < n and single[b] > 1]
    if not pairs:
        return spark.createDataFrame([], "determinant string, dependent string")
    row = df.agg(*[F.count_distinct(F.struct(a, b)).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    return spark.createDataFrame([(a, b) for i, (a, b) in enumerate(pairs) if row[i] == single[a]], "determinant string, dependent string")


def approximate_dependency(df: DataFrame, det: str, dep: str) -> DataFrame:
    """groups, violations, confidence of det -> dep: rows that differ from their group's most frequent value."""
    g = df.where(F.col(det).isNotNull()).groupBy(det, dep).agg(F.count("*").alias("n"))
    m = g.groupBy(det).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return m.agg(F.count("*").alias("groups"), F.sum(F.col("n") - F.col("top")).alias("violations"), (1 - F.sum(F.col("n") - F.col("top")) / F.sum("n")).alias("confidence"))


def dependency_violations(df: DataFrame, det: str, dep: str, order: str) -> DataFrame:
    """Rows whose dep differs from the mode of their det group (ties: the value seen first by ``order``)."""
    g = df.where(F.col(det).isNotNull()).groupBy(F.col(det).alias("__d"), F.col(dep).alias("__v")).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    mode = g.groupBy("__d").agg(F.max_by("__v", F.struct("n", -F.col("f"))).alias("expected"))
    return df.join(mode, df[det] == mode["__d"]).where(~F.col(dep).eqNullSafe(F.col("expected"))).drop("__d")


def referential_integrity(child: DataFrame, parent: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """child_column, orphans, rows: child values without a parent key (nulls refer to nothing)."""
    out = None
    for c, p in mapping.items():
        keys = parent.select(F.col(p).alias("k")).distinct()
        x = child.select(F.col(c).alias("k")).where("k is not null").join(keys, "k", "left_anti").groupBy("k").agg(F.count("*").alias("n"))
        r = x.agg(F.lit(c).alias("child_column"), F.count("*").alias("orphans"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        out = r if out is None else out.unionByName(r)
    return out


def temporal_order(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """start, end, violations: rows whose start is later than their end."""
    flat = df.agg(*[F.count_if(F.col(a) > F.col(b)).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.col(f"v{i}").alias("violations")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def null_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, agreement: share of rows in which both are null or both are not."""
    pairs = list(combinations(columns, 2))
    flat = df.agg(*[F.avg((F.col(a).isNull() == F.col(b).isNull()).cast("double")).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{i}").alias("agreement")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def key_certificate(df: DataFrame, grain: list[str], measures: list[str]) -> DataFrame:
    """groups, duplicate_groups, max_fan_out and, per measure, fan_out = sum over sum
    of the group maxima (1 where that is 0)."""
    g = df.groupBy(*grain).agg(F.count("*").alias("n"), *[F.sum(m).alias(f"s_{m}") for m in measures], *[F.max(m).alias(f"x_{m}") for m in measures])
    ratio = lambda m: F.coalesce(F.try_divide(F.sum(f"s_{m}"), F.sum(f"x_{m}")), F.lit(1.0)).alias(f"fan_out_{m}")
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.max("n").alias("max_fan_out"), *[ratio(m) for m in measures])


def sequence_gaps(df: DataFrame, column: str) -> DataFrame:
    """gap_start, gap_end of missing integers between the least and the largest value.
    Neighbours meet by range, so no task sees the whole column."""
    v = df.select(F.col(column).cast("long").alias("v")).where("v is not null").distinct()
    width = 1_000_000
    b = v.withColumn("b", F.floor(F.col("v") / width))
    inner = b.withColumn("nx", F.lead("v").over(Window.partitionBy("b").orderBy("v")))
    edge = b.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    nxt = edge.withColumn("nx", F.lead("lo").over(Window.orderBy("b")))  # one row per million values
    gaps = inner.where("nx > v + 1").select("v", "nx").unionByName(nxt.where("nx > hi + 1").select(F.col("hi").alias("v"), "nx"))
    return gaps.select((F.col("v") + 1).alias("gap_start"), (F.col("nx") - 1).alias("gap_end"))
