"""Incremental processing: log-based change capture with a write-ahead plan.

The records table is read as a log of partitions (feeds). Each partition has
two offsets, the highest row number and the latest change time processed. A
run (1) writes its batch plan ahead of any work - for every partition the offsets
it starts after and those it ends at -, (2) captures what lies between the offsets
of the *written* plan, (3) hands it to a sink that keeps one row per key and offset
over all batches, and (4) commits the plan. The next plan starts where the last
committed one ended. A run that finds a plan without a commit replays that plan:
its end offsets make it the same batch although the log has grown since, so a
failure neither skips nor repeats a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import new_path

PLAN_BROADCAST_ROWS = 100_000


def parse_position(col):
    """A time written by any client: ISO 8601 with zone, without zone (UTC), with
    a blank for the T, or epoch seconds / milliseconds / microseconds."""
    v = F.trim(col)
    digits = F.length(v)
    num = v.try_cast("decimal(20,0)")
    epoch = F.when(v.rlike(r"^\d{9,16}$"), F.timestamp_micros((num * F.when(digits <= 11, 1_000_000).when(digits <= 14, 1_000).otherwise(1)).cast("long")))
    iso = F.regexp_replace(F.regexp_replace(v, r"\s*(?i:UTC|GMT)$", "Z"), r"^(\d{4}-\d\d-\d\d)[Tt ]+", "$1T")
    zoned = F.when(iso.rlike(r"([Zz]|[+-]\d\d:?\d\d)$"), iso).when(iso.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(iso, F.lit("T00:00:00Z"))).otherwise(F.concat(iso, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.coalesce(epoch, zoned.try_cast("timestamp"))


def offsets(state: DataFrame) -> DataFrame:
    """Per partition the two positions of the latest finished run that has one:
    part, row_pos, time_pos. Unfinished runs do not count; runs equal in time
    are ordered by id."""
    s = state.where(F.col("last_processed_at").isNotNull()).withColumn("tp", parse_position(F.col("last_incremental_value")))
    order = F.struct("last_processed_at", "id")
    return s.groupBy(F.col("source_table").alias("part")).agg(
        F.max_by("last_row_id", F.when(F.col("last_row_id").isNotNull(), order)).alias("row_pos"),
        F.max_by("tp", F.when(F.col("tp").isNotNull(), order)).alias("time_pos"),
    )


class ChangeFeed:
    """Write-ahead plans, captured batches and commits under one folder.

    layout: ``plan/<n>`` the offsets of batch n (part, row_pos, time_pos, row_end,
    time_end), ``batch/<n>`` what it captured, ``commit/<n>`` an empty marker.
    ``home`` defaults to a new folder in the cluster's shared storage."""

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark, self.home = spark, home or new_path(spark, "changefeed")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, kind: str) -> list[int]:
        p = self._path(f"{self.home}/{kind}")
        if not self._fs.exists(p):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit() and (kind == "commit" or self._fs.exists(self._path(f"{self.home}/{kind}/{n}/_SUCCESS"))))

    def _plan(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/plan/{n}")

    def plan(self, state: DataFrame, log: DataFrame, part: str = "source", row: str = "row_id", changed: str = "last_seen_at") -> int:
        """Number of the batch to run: an uncommitted plan is taken up again as written;
        otherwise a new one goes from the later of the last commit's end and the
        position in ``state`` to the end of the log as it is now. A null partition is
        one of its own."""
        plans, commits = self._list("plan"), set(self._list("commit"))
        pending = [n for n in plans if n not in commits]
        if pending:
            return pending[0]
        n = (plans[-1] + 1) if plans else 0
        start = offsets(state)
        if plans:
            start = start.unionByName(self._plan(plans[-1]).select("part", F.col("row_end").alias("row_pos"), F.col("time_end").alias("time_pos")))
        start = start.groupBy("part").agg(F.max("row_pos").alias("row_pos"), F.max("time_pos").alias("time_pos"))
        end = log.groupBy(F.col(part).alias("p")).agg(F.max(row).alias("row_end"), F.max(changed).alias("time_end"))
        both = start.join(end, F.col("part").eqNullSafe(F.col("p")), "full").select(F.coalesce("part", "p").alias("part"), "row_pos", "time_pos", F.greatest("row_pos", "row_end").alias("row_end"), F.greatest("time_pos", "time_end").alias("time_end"))
        both.coalesce(1).write.mode("overwrite").parquet(f"{self.home}/plan/{n}")  # one row per partition of the log
        return n

    def capture(self, n: int, log: DataFrame, part: str = "source", row: str = "row_id", changed: str = "last_seen_at") -> DataFrame:
        """Records of the log between the offsets of plan n: beyond one start, and beyond
        no end. A partition whose plan has no start position is captured from its beginning;
        one that has come up since is not in the plan and waits for the next."""
        plan = self._plan(n).select(F.col("part").alias("__part"), F.col("row_pos").alias("__rp"), F.col("time_pos").alias("__tp"), F.col("row_end").alias("__re"), F.col("time_end").alias("__te"))
        if plan.count() <= PLAN_BROADCAST_ROWS:  # one row per partition of the log
            plan = F.broadcast(plan)
        new = (F.col("__rp").isNull() & F.col("__tp").isNull()) | F.coalesce(F.col(row) > F.col("__rp"), F.lit(False)) | F.coalesce(F.col(changed) > F.col("__tp"), F.lit(False))
        old = (F.col(row).isNull() | F.coalesce(F.col(row) <= F.col("__re"), F.lit(False))) & (F.col(changed).isNull() | F.coalesce(F.col(changed) <= F.col("__te"), F.lit(False)))
        return log.join(plan, log[part].eqNullSafe(plan["__part"])).where(new & old).drop("__part", "__rp", "__tp", "__re", "__te")

    def sink(self, n: int, rows: DataFrame, key: list[str], offset: list[str]) -> DataFrame:
        """Write batch n and return what is stored: one row per key and offset, none that
        an earlier batch stored. A replay overwrites its own folder. Of the earlier
        batches only rows within the offsets of this one are read."""
        ids, rows = [*key, *offset], rows.dropDuplicates([*key, *offset])
        before = [f"{self.home}/batch/{i}" for i in self._list("batch") if i < n]
        if before:
            o = offset[0]
            lo, hi = rows.agg(F.min(o), F.max(o)).first()
            held = self.spark.read.parquet(*before).select(*ids)
            held = held.where(F.col(o).isNull() | F.col(o).between(F.lit(lo), F.lit(hi))) if lo is not None else held.where(F.col(o).isNull())
            held = held.toDF(*[f"__{c}" for c in ids])
            same = F.lit(True)
            for c in ids:
                same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
            rows = rows.join(held, same, "left_anti")
        rows.write.mode("overwrite").parquet(f"{self.home}/batch/{n}")
        return self.spark.read.parquet(f"{self.home}/batch/{n}")

    def commit(self, n: int) -> None:
        self._fs.mkdirs(self._path(f"{self.home}/commit/{n}"))

    def run(self, state: DataFrame, log: DataFrame, columns: list[str] | None = None, part: str = "source", row: str = "row_id", changed: str = "last_seen_at") -> DataFrame:
        """One whole run; returns the stored batch."""
        n = self.plan(state, log, part, row, changed)
        rows = self.capture(n, log, part, row, changed)
        rows = rows.select(*dict.fromkeys([*(columns or rows.columns), row, changed]))
        out = self.sink(n, rows, [row], [changed])
        self.commit(n)
        return out
