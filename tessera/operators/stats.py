"""Column and frame statistics in one pass, as plans."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def _long(df: DataFrame, aggs: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over the frame, one output row per column."""
    flat = df.agg(*[e.alias(f"{c}\x1f{m}") for c, ms in aggs.items() for m, e in ms.items()])
    names = list(next(iter(aggs.values())))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}\x1f{m}`").alias(m) for m in names]) for c in aggs])
    return flat.select(F.explode(rows).alias("r")).select("r.*")


def profile(df: DataFrame) -> DataFrame:
    """column, rows, nulls, null_ratio, distinct (a null counts as one value)."""
    def one(c):
        nulls = F.count_if(F.col(c).isNull())
        return {
            "rows": F.count("*"),
            "nulls": nulls,
            "null_ratio": F.coalesce(F.try_divide(nulls, F.count("*")), F.lit(0.0)),
            "distinct": F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int")),
        }

    return _long(df, {c: one(c) for c in df.columns})


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, mean, std (n - 1), min, max over non-null values."""
    x = lambda c: F.col(c).cast("double")
    return _long(df, {c: {"n": F.count(c), "mean": F.avg(x(c)), "std": F.stddev_samp(x(c)), "min": F.min(x(c)), "max": F.max(x(c))} for c in columns or numeric_columns(df)})


def string_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    n = lambda c: F.length(c)
    return _long(df, {c: {"n": F.count(c), "blank": F.count_if(F.trim(c) == ""), "min_length": F.min(n(c)), "max_length": F.max(n(c)), "avg_length": F.avg(n(c))} for c in columns or string_columns(df)})


def quantiles(df: DataFrame, column: str, qs: list[float]) -> DataFrame:
    """q, value with linear interpolation."""
    flat = df.agg(F.percentile(F.col(column), F.array(*[F.lit(q) for q in qs])).alias("v"))
    return flat.select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("i") + 1).alias("q"), "value")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, low, high, n: equal widths over [min, max], the last bin closed; equal
    values form one bin; empty bins are listed with 0."""
    b = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(column).cast("double")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counts = df.where(x.isNotNull()).crossJoin(F.broadcast(b)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # b is one row
    grid = b.where("lo is not null").withColumn("bin", F.explode(F.when(F.col("hi") == F.col("lo"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """value, n, share (nulls are a value); ``top`` keeps the most frequent."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    n = df.agg(F.count("*").alias("total"))
    out = out.crossJoin(F.broadcast(n)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def value_frequencies(df: DataFrame, column: str, transform=lambda c: c) -> DataFrame:
    """Relative frequency of the transformed non-null values."""
    v = df.select(transform(F.col(column)).alias("value")).where("value is not null")
    n = v.agg(F.count("*").alias("total"))
    return v.groupBy("value").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("value", (F.col("n") / F.col("total")).alias("frequency"))


def benford(df: DataFrame, column: str) -> DataFrame:
    """digit, n, expected: leading digits of non-zero values."""
    d = F.regexp_extract(F.abs(F.col(column)).cast("decimal(38,10)").cast("string"), r"([1-9])", 1).try_cast("int")
    got = df.select(d.alias("digit")).where("digit is not null").groupBy("digit").agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(i, math.log10(1 + 1 / i)) for i in range(1, 10)], "digit int, expected double")
    return grid.join(F.broadcast(got), "digit", "left").select("digit", F.coalesce("n", F.lit(0)).alias("n"), "expected")


def chi2_gof(observed: list[float], expected: list[float]) -> tuple[float, float]:
    """Statistic and p-value (regularised incomplete gamma)."""
    stat = sum((o - e) ** 2 / e for o, e in zip(observed, expected) if e > 0)
    return stat, gamma_q((len(observed) - 1) / 2, stat / 2)


def gamma_q(a: float, x: float) -> float:
    """Q(a, x) for whole and half a, as chi-square needs: the tail of a Poisson sum for
    whole a, the same sum from 1/2 on and erfc for half a. Terms are summed as logs."""
    if x <= 0:
        return 1.0
    if 2 * a != round(2 * a):
        raise ValueError("a must be a multiple of 1/2")
    half = a % 1
    terms = (math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in (half + i for i in range(math.ceil(a - half))))
    return min(1.0, math.fsum([math.erfc(math.sqrt(x)) if half else 0.0, *terms]))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    flat = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 and V of the contingency table of two columns (rows with a null left out)."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra, rb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    # sum n^2/(na nb) over filled cells gives chi2 = N (that - 1) without the empty ones
    x = t.join(ra, "a").join(rb, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.sum("n").alias("total"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    chi2 = F.greatest(F.col("total") * (F.col("s") - 1), F.lit(0.0))
    return x.select(chi2.alias("chi2"), F.coalesce(F.sqrt(F.try_divide(chi2, F.col("total") * (F.least("ka", "kb") - 1))), F.lit(0.0)).alias("v"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy in bits of the non-null values."""
    f = value_frequencies(df, column)
    return f.agg((-F.sum(F.col("frequency") * F.log2("frequency"))).alias("entropy"))


def duplicate_rows(df: DataFrame, near: bool = False) -> DataFrame:
    """signature, n of groups of equal rows; with ``near``, strings are compared in
    lower case without other characters than letters and digits, and groups of
    wholly equal rows are left out."""
    strings = set(string_columns(df))
    soft = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]", "") if c in strings else F.col(c).cast("string")
    sig = lambda f: F.sha2(F.concat_ws("\x1f", *[F.coalesce(f(c), F.lit("")) for c in df.columns]), 256)
    exact = sig(lambda c: F.col(c).cast("string"))
    if not near:
        return df.groupBy(exact.alias("signature")).agg(F.count("*").alias("n")).where("n > 1")
    return df.select(sig(soft).alias("signature"), exact.alias("e")).groupBy("signature").agg(F.count("*").alias("n"), F.min("e").alias("a"), F.max("e").alias("b")).where("a <> b").select("signature", "n")


def duplicate_row_ratio(df: DataFrame) -> DataFrame:
    """Share of rows that are in a group of equal rows; 0 for an empty frame."""
    d = duplicate_rows(df).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("d"))
    return d.crossJoin(df.agg(F.count("*").alias("t"))).select(F.coalesce(F.try_divide("d", "t"), F.lit(0.0)).alias("ratio"))


def frame_summary(df: DataFrame) -> DataFrame:
    """rows, columns, mean_null_ratio."""
    p = profile(df)
    return p.agg(F.max("rows").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.avg("null_ratio").alias("mean_null_ratio"))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 over type-tagged fields in name order; internal columns (``__``) do not count."""
    kinds = dict(df.dtypes)
    cols = sorted(c for c in columns or df.columns if not c.startswith("__"))

    def field(c):
        k = kinds[c]
        tag = "bool" if k == "boolean" else "int" if k in ("tinyint", "smallint", "int", "bigint") else "float" if k in ("float", "double") or k.startswith("decimal") else "bytes" if k == "binary" else "str"
        return F.concat(F.lit(c + "\x1f"), F.when(F.col(c).isNull(), F.lit("null\x1f")).otherwise(F.concat(F.lit(tag + "\x1f"), F.col(c).cast("string"))))

    return F.sha2(F.concat_ws("\x1e", *[field(c) for c in cols]), 256)


def otsu(df: DataFrame, score: str, bins: int = 100) -> DataFrame:
    """threshold of greatest between-class variance over [0, 1] (middle of a plateau),
    null where it explains less than 0.7 of the variance. Only the histogram of
    ``bins`` counts is gathered."""
    h = df.where(F.col(score).isNotNull()).groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count("*").cast("double").alias("n"))
    mid = (F.col("b") + 0.5) / bins
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    whole = Window.partitionBy()
    r = h.select("b", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * mid).over(w).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * mid).over(whole).alias("s"), F.sum(F.col("n") * mid * mid).over(whole).alias("q"))
    m0, m1 = F.col("s0") / F.col("n0"), F.try_divide(F.col("s") - F.col("s0"), F.col("n") - F.col("n0"))
    between = F.round(F.col("n0") / F.col("n") * (F.col("n") - F.col("n0")) / F.col("n") * F.pow(m0 - m1, 2), 12)
    total = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    r = r.select("b", between.alias("v"), total.alias("t")).where("v is not null")
    best = r.agg(F.max("v").alias("top"), F.max("t").alias("t"))
    at = r.drop("t").crossJoin(F.broadcast(best)).where("v = top").agg(F.avg("b").alias("b"), F.max("top").alias("top"), F.max("t").alias("t"))
    return at.select(F.when(F.col("top") >= 0.7 * F.col("t"), (F.col("b") + 1) / bins).alias("threshold"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Sources of different columns, aligned by name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
