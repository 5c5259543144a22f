"""One value per cluster: survivorship strategies as aggregates.

Every strategy has a total order (the row id breaks ties), so results do not
depend on partitioning. Each gives ``<column>`` and ``<column>_confidence``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import transforms as T

STRATEGIES: dict[str, Callable] = {}


def strategy(f):
    STRATEGIES[f.__name__] = f
    return f


def _order(c: Column, *by: Column, row: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)], (-row).alias("r")))


def _distinct(c):
    return F.count_distinct(c)


@strategy
def most_complete(c, row, **_):
    """The longest text; among equals the first. Confidence 1, or 0.7 where different values share the length."""
    n = F.length(c.cast("string"))
    first, last = F.max_by(c, _order(c, n, row=row)), F.max_by(c, _order(c, n, row=-row))
    return first, F.when(F.count(c) == 0, 0.0).when(_distinct(c) == 1, 1.0).when(first == last, 1.0).otherwise(0.7)


STRATEGIES["longest_value"] = most_complete


@strategy
def shortest_value(c, row, **_):
    return F.max_by(c, _order(c, -F.length(c.cast("string")), row=row)), F.lit(1.0)


@strategy
def first_non_null(c, row, **_):
    return F.max_by(c, _order(c, row=row)), F.when(F.count(c) == 0, 0.0).when(_distinct(c) == 1, 1.0).otherwise(0.6)


@strategy
def unanimous_or_null(c, row, **_):
    return F.when(_distinct(c) == 1, F.max(c)), F.when(_distinct(c) == 1, 1.0).otherwise(0.0)


@strategy
def most_recent(c, row, date: Column | None = None, **_):
    if date is None:
        raise NotImplementedError("most_recent needs a date column")
    return F.max_by(c, _order(c, date, row=row)), F.when(F.count(c) == 0, 0.0).otherwise(1.0)


@strategy
def source_priority(c, row, source: Column | None = None, priority: list[str] = (), **_):
    """The first source of the list that has a value; 0.1 less confidence a place, 0.1 at least."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), source), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    best = F.min(F.when(c.isNotNull(), rank))
    return F.max_by(c, _order(c, -rank, row=row)), F.coalesce(F.greatest(F.lit(0.1), 1.1 - 0.1 * best), F.lit(0.0))


@strategy
def numeric_max(c, row, **_):
    return F.max(c.cast("double")), F.lit(1.0)


@strategy
def numeric_min(c, row, **_):
    return F.min(c.cast("double")), F.lit(1.0)


@strategy
def numeric_mean(c, row, **_):
    x = c.cast("string").try_cast("double")
    return F.avg(x), F.coalesce(F.try_divide(F.count(x), F.count("*")), F.lit(0.0))


@strategy
def numeric_sum(c, row, **_):
    return F.sum(c.cast("double")), F.lit(1.0)


@strategy
def numeric_median(c, row, **_):
    """The lower middle value, not interpolated."""
    return _lower_median(c), F.lit(1.0)


def _lower_median(c):
    return F.call_function("percentile_approx", c.cast("double"), F.lit(0.5), F.lit(1_000_000))


@strategy
def numeric_weighted_average(c, row, weight: Column | None = None, **_):
    w = F.when(c.isNotNull(), weight if weight is not None else F.lit(1.0))
    return F.try_divide(F.sum(c.cast("double") * w), F.sum(w)), F.lit(1.0)


@strategy
def count_distinct(c, row, **_):
    return F.count_distinct(c), F.lit(1.0)


@strategy
def count_non_null(c, row, **_):
    return F.count(c), F.lit(1.0)


@strategy
def concat_unique(c, row, sep: str = "; ", **_):
    return F.array_join(F.sort_array(F.collect_set(c)), sep), F.lit(1.0)


def golden(df: DataFrame, cluster: str, row: str, rules: dict[str, str | tuple[str, dict]]) -> DataFrame:
    """One row per cluster. rules: column -> strategy or (strategy, options); options
    name columns (``date``, ``source``, ``weight``) or values (``priority``, ``sep``).

    ``majority_vote`` and ``agreement_rate`` need value counts, so each adds one
    grouped count; the others share a single aggregate."""
    r = F.col(row)
    aggs, votes = [], []
    for col, rule in rules.items():
        name, opts = rule if isinstance(rule, tuple) else (rule, {})
        opts = {k: F.col(v) if k in ("date", "source", "weight") else v for k, v in opts.items()}
        if name in VOTES:
            votes.append((col, name))
        elif name in STRATEGIES:
            value, conf = STRATEGIES[name](F.col(col), r, **opts)
            aggs += [value.alias(col), conf.cast("double").alias(f"{col}_confidence")]
        else:
            raise NotImplementedError(f"unknown strategy {name!r}")
    out = df.groupBy(cluster).agg(F.count("*").alias("size"), *aggs)
    for col, name in votes:
        out = out.join(vote(df, cluster, row, col, VOTES[name], rate=name == "agreement_rate"), cluster, "left")
    return out


#: Voting strategies and how they bring values to one form before the vote.
VOTES: dict[str, Callable[[Column], Column]] = {
    "majority_vote": lambda c: c,
    "agreement_rate": lambda c: c,
    "email_normalize": T.email_canonical,
    "phone_digits_only": T.phone_digits,
    "url_canonical": T.url_canonical,
    "whitespace_normalize": lambda c: F.trim(T.collapse_whitespace(c)),
    "boolean_normalize": T.boolean_normalize,
}


def vote(df: DataFrame, cluster: str, row: str, col: str, form: Callable[[Column], Column], weight: Column | None = None, rate: bool = False) -> DataFrame:
    """The value of most rows (or weight); among equals the one seen first; confidence is its share."""
    w = weight if weight is not None else F.lit(1.0)
    g = df.select(cluster, form(F.col(col)).alias("v"), w.alias("w"), F.col(row).alias("r")).where("v is not null").groupBy(cluster, "v").agg(F.sum("w").alias("n"), F.min("r").alias("f"))
    value = F.max("n") / F.sum("n") if rate else F.max_by("v", F.struct("n", (-F.col("f")).alias("f")))
    return g.groupBy(cluster).agg(value.alias(col), (F.max("n") / F.sum("n")).alias(f"{col}_confidence"))


def confidence_majority(df: DataFrame, pairs: DataFrame, cluster: str, row: str, col: str) -> DataFrame:
    """Vote weighted by the scores of the pairs a row is in (a row without a pair counts 0)."""
    s = pairs.select(F.explode(F.array("a", "b")).alias(row), "score").groupBy(row).agg(F.sum("score").alias("__w"))
    return vote(df.join(s, row, "left"), cluster, row, col, lambda c: c, F.coalesce(F.col("__w"), F.lit(0.0)))


def field_group(df: DataFrame, cluster: str, row: str, columns: list[str], date: str | None = None) -> DataFrame:
    """All columns of the group from one row: the one with most of them filled, then the latest, then the first."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    order = F.struct(filled.alias("n"), *([F.col(date).alias("d")] if date else []), (-F.col(row)).alias("r"))
    g = df.groupBy(cluster).agg(F.max_by(F.struct(F.col(row).alias("winner"), *columns), order).alias("w"))
    return g.select(cluster, "w.*")


def conditional(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The first rule that fires decides; a missing operand does not fire."""
    out = None
    for when, value in rules:
        out = F.when(F.coalesce(when, F.lit(False)), value) if out is None else out.when(F.coalesce(when, F.lit(False)), value)
    return out.otherwise(default) if out is not None else default


def provenance(df: DataFrame, cluster: str, row: str, gold: DataFrame, columns: list[str]) -> DataFrame:
    """cluster, field, value, rows: the members whose value equals the surviving one."""
    long = df.select(cluster, F.col(row).alias("r"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")).select(cluster, "r", "f.*")
    want = gold.select(cluster, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")).select(cluster, "f.*")
    return want.join(long, [cluster, "field", "value"]).groupBy(cluster, "field", "value").agg(F.min("r").alias("first_row"), F.count("*").alias("rows"))
