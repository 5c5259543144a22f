"""Referential integrity: references to parents that are missing, deleted or late.

Method: the key space is cut into ranges, each range holds its parents as one
sorted array, and batches of references are probed with a vectorised binary
search. A range whose references exceed the batch target is split by salt (its
parent array is sent to every salt), so one hot key never lands in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

OUT = "table_name string, row_key string, state string, ref_time timestamp"


def canonical_key(col):
    """Letter case and outer white space do not distinguish keys; blank is null."""
    k = F.lower(F.regexp_replace(col.cast("string"), r"^\s+|\s+$", ""))
    return F.when(k != "", k)


def parent_index(parents: DataFrame, key: str, status: str, created: str, deleted_value: str = "retired") -> DataFrame:
    """One row per distinct parent key: hash, key, gone, born.

    Copies of a parent collapse; where several parents share a canonical key, it
    counts as deleted only if all are, and as born when the first one was."""
    k = canonical_key(F.col(key))
    return (
        parents.select(k.alias("k"), (F.lower(F.trim(F.col(status))) == deleted_value).alias("g"), F.col(created).alias("t"))
        .where("k is not null")
        .groupBy("k")
        .agg(F.min(F.coalesce("g", F.lit(False))).alias("gone"), F.min("t").alias("born"))
        .select(F.xxhash64("k").alias("h"), "k", "gone", "born")
    )


def references(df: DataFrame, table_name: str, key: str, row_key: str, time: str) -> DataFrame:
    """References of one table; null and blank keys refer to nothing and are left out."""
    k = canonical_key(F.col(key))
    return df.select(F.lit(table_name).alias("table_name"), F.col(row_key).cast("string").alias("row_key"), k.alias("k"), F.col(time).alias("ref_time")).where("k is not null").withColumn("h", F.xxhash64("k"))


def probe(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """Binary search of a batch of references in the sorted arrays of its range (one row, or none)."""
    if not len(refs):
        return pd.DataFrame({"table_name": pd.Series(dtype=object), "row_key": pd.Series(dtype=object), "state": pd.Series(dtype=object), "ref_time": pd.Series(dtype="datetime64[us]")})
    rh, rk = refs.h.to_numpy(np.int64), refs.k.to_numpy(object)
    at, state = np.full(len(refs), -1), np.full(len(refs), "missing", object)
    if len(parents):
        p = parents.iloc[0]
        ph, pk, gone, born = np.asarray(p.h, np.int64), np.asarray(p.k, object), np.asarray(p.gone, bool), np.asarray(p.born, np.int64)
        lo, hi = np.searchsorted(ph, rh, "left"), np.searchsorted(ph, rh, "right")
        one = hi > lo
        first = np.minimum(lo, len(ph) - 1)
        same = one & (pk[first] == rk)
        at[same] = first[same]
        for i in np.flatnonzero(one & ~same):  # keys whose 64-bit hashes collide
            for j in range(lo[i] + 1, hi[i]):
                if pk[j] == rk[i]:
                    at[i] = j
                    break
        found = at >= 0
        time = refs.ref_time.to_numpy("datetime64[us]")
        late = found & ~np.isnat(time) & (born[at] > time.astype(np.int64))
        state[found] = ""
        state[late] = "late"
        state[found & gone[at]] = "deleted"
    out = refs.assign(state=state)[["table_name", "row_key", "state", "ref_time"]]
    return out[out.state != ""]


def sorted_ranges(parents: DataFrame, rng) -> DataFrame:
    """One row per range r: its parents as arrays h, k, gone, born (microseconds; the least
    long for none), sorted by h. A range holds about as many parents as it was cut for."""
    born = F.coalesce(F.unix_micros("born"), F.lit(-(2**63)))
    x = parents.withColumn("r", rng).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("h", "k", "gone", born.alias("born")))).alias("p"))
    return x.select("r", *[F.col(f"p.{c}").alias(c) for c in ("h", "k", "gone", "born")])


def broken_references(refs: DataFrame, parents: DataFrame, per_range: int = 25_000, per_batch: int | None = None) -> DataFrame:
    """References whose parent is ``missing``, ``deleted`` or ``late``.

    refs: table_name, row_key, k, h, ref_time (see :func:`references`); parents
    as from :func:`parent_index`. Both are read once; the parents are stored as one
    sorted array per range. ``per_range`` is about the number of parents of a range,
    ``per_batch`` (twice that) of references probed at once: the arrays of a range are
    sent to every batch of it, so small ranges are sent less often. A parent without a
    birth time, or a reference without a time, is never late. Empty tables give no rows."""
    parents, refs = cut(parents), cut(refs.select("table_name", "row_key", "k", "h", "ref_time"))
    n = max(1, math.ceil(max(parents.count(), 1) / per_range))
    # equal ranges of the 64-bit key space, ascending
    rng = F.least(F.lit(n - 1), F.floor((F.col("h").cast("double") / 2.0**63 + 1) / 2 * n)).cast("int")
    refs = refs.withColumn("r", rng)
    salts = cut(refs.groupBy("r").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(per_batch or 2 * per_range))).cast("int").alias("salts")))
    r = refs.join(salts, "r").withColumn("s", F.pmod(F.xxhash64("table_name", "row_key"), F.col("salts")).cast("int"))
    p = cut(sorted_ranges(parents, rng)).join(salts, "r").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    r = r.select("r", "s", "table_name", "row_key", "k", "h", "ref_time")
    p = p.select(F.col("r").alias("pr"), F.col("s").alias("ps"), "h", "k", "gone", "born")
    return r.groupBy("r", "s").cogroup(p.groupBy("pr", "ps")).applyInPandas(probe, OUT)


def misses_by_period(broken: DataFrame, period: str = "month") -> DataFrame:
    """Misses per table, period and state; references without a time form period null."""
    return broken.dropDuplicates(["table_name", "row_key"]).groupBy("table_name", F.date_trunc(period, "ref_time").alias("period"), "state").agg(F.count("*").alias("misses"))
