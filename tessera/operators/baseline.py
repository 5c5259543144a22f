"""Baselines and drift, and denial constraints."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import stats


def create(df: DataFrame) -> DataFrame:
    """Append-only metrics of a table: column, metric, value."""
    num = stats.numeric_columns(df)
    long = stats.profile(df).select("column", F.explode(F.create_map(F.lit("null_ratio"), F.col("null_ratio"), F.lit("distinct"), F.col("distinct").cast("double"))).alias("metric", "value"))
    if num:
        s = stats.numeric_stats(df, num)
        long = long.unionByName(s.select("column", F.explode(F.create_map(*[x for m in ("mean", "std", "min", "max") for x in (F.lit(m), F.col(m))])).alias("metric", "value")))
    return long


def drift(baseline: DataFrame, current: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """column, metric, before, after, finding for metrics that moved: nulls by more
    than ``tolerance``, a mean by more than three standard deviations, a bound that
    is exceeded, distinct values by more than half, columns that came or went."""
    b, c = baseline.select("column", "metric", F.col("value").alias("before")), current.select("column", "metric", F.col("value").alias("after"))
    x = b.join(c, ["column", "metric"], "full")
    sd = b.where("metric = 'std'").select("column", F.col("before").alias("sd"))
    x = x.join(sd, "column", "left")
    d = F.abs(F.col("after") - F.col("before"))
    what = (
        F.when(F.col("before").isNull() & F.col("after").isNotNull(), "new")
        .when(F.col("after").isNull() & F.col("before").isNotNull(), "gone")
        .when((F.col("metric") == "null_ratio") & (d > tolerance), "null_drift")
        .when((F.col("metric") == "mean") & (d > 3 * F.col("sd")), "mean_drift")
        .when((F.col("metric") == "min") & (F.col("after") < F.col("before")) | (F.col("metric") == "max") & (F.col("after") > F.col("before")), "bound_drift")
        .when((F.col("metric") == "distinct") & (d > 0.5 * F.col("before")), "cardinality_drift")
    )
    return x.withColumn("finding", what).where("finding is not null").select("column", "metric", "before", "after", "finding")


def regressions(history: DataFrame, gain: dict[str, int], tolerance: float = 0.05, last: int = 7) -> DataFrame:
    """run_id, key, value, baseline, change: values that are worse than the median of
    the ``last`` runs by more than the tolerance. history: run_id, key, value; gain: key -> 1 (higher is better) or -1."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("run_id").rowsBetween(-last, -1)
    a = F.sort_array(F.collect_list("value").over(w))
    n = F.size(a)
    med = F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)
    g = F.create_map(*[F.lit(x) for kv in gain.items() for x in kv])
    x = history.withColumn("baseline", med).withColumn("change", F.try_divide((F.col("value") - F.col("baseline")) * g[F.col("key")], F.abs("baseline")))
    return x.where(F.col("change") < -tolerance)


def predicates(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Comparisons within a row between columns of one type."""
    kinds = dict(df.dtypes)
    ops = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    return {f"{a} {o} {b}": f(F.col(a), F.col(b)) for a, b in combinations(columns, 2) if kinds[a] == kinds[b] for o, f in ops.items()}


def denial_constraints(df: DataFrame, columns: list[str], max_violation: float = 0.05) -> DataFrame:
    """constraint, violation: conjunctions of one or two row predicates that (almost)
    never hold. All candidates are counted in one aggregate; a pair is listed only if
    neither of its parts is."""
    ps = predicates(df, columns)
    cand = {(k,): e for k, e in ps.items()} | {(a, b): ps[a] & ps[b] for a, b in combinations(ps, 2) if a.split()[::2] != b.split()[::2]}
    row = df.agg(F.count("*").alias("n"), *[F.count_if(e).alias(f"v{i}") for i, e in enumerate(cand.values())]).first()
    n = row["n"] or 1
    found = {}
    for i, k in enumerate(cand):
        if row[f"v{i}"] / n <= max_violation and not any((p,) in found for p in k if len(k) > 1):
            found[k] = row[f"v{i}"] / n
    return df.sparkSession.createDataFrame([("not (" + " and ".join(k) + ")", v) for k, v in found.items()], "constraint string, violation double")


def validate(df: DataFrame, condition: Column) -> DataFrame:
    """Exact share of rows for which a denied condition holds."""
    return df.agg(F.coalesce(F.try_divide(F.count_if(condition), F.count("*")), F.lit(0.0)).alias("violation"))
