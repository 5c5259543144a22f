"""Streams: batch-wise matching against a growing base, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocking, clusters, matching


class StreamMatcher:
    """``foreachBatch`` handler. Every micro-batch is matched against the base and
    itself; base and assignments are tables with one folder per batch id, so a
    batch that is delivered again replaces its own output."""

    def __init__(self, spark: SparkSession, home: str, id: str, key: list, fields: list, threshold: float):
        self.spark, self.home, self.id, self.key, self.fields, self.threshold = spark, home.rstrip("/"), id, key, fields, threshold

    def _before(self, kind: str, batch: int, schema) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{kind}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):  # nothing written yet
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.home}/{kind}").where(F.col("batch") < batch).drop("batch")

    def __call__(self, df: DataFrame, batch: int) -> None:
        base = self._before("base", batch, df.schema)
        new = df.join(base.select(self.id), self.id, "left_anti").dropDuplicates([self.id])
        every = base.unionByName(new)
        key = blocking.static_key(self.key).alias("k")
        n, a = new.select(F.col(self.id).alias("id"), key).where("k is not null"), every.select(F.col(self.id).alias("id2"), key).where("k is not null")
        keys = n.select("k").distinct()
        a = a.join(keys, "k", "left_semi")  # of the base only the blocks the batch touches go on
        pairs = n.join(a, "k").where("id <> id2").select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
        touched = every.join(a.select(F.col("id2").alias(self.id)), self.id, "left_semi")
        scored = matching.score_pairs(pairs, touched, self.id, self.fields, self.threshold)
        new.write.mode("overwrite").parquet(f"{self.home}/base/batch={batch}")
        scored.write.mode("overwrite").parquet(f"{self.home}/pairs/batch={batch}")

    def assignments(self) -> DataFrame:
        """member, cluster_id over everything that has arrived."""
        pairs = self.spark.read.parquet(f"{self.home}/pairs")
        return clusters.components(pairs, self.spark.read.parquet(f"{self.home}/base").select(self.id))

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False):
        w = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()


def transform_stream(stream: DataFrame, f: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True):
    """A stream of files through a row-wise transform into Parquet, exactly once."""
    w = f(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def windows(df: DataFrame, time: str, width: str, slide: str | None = None, by: tuple[str, ...] = (), late: str | None = None, **aggs: Column) -> DataFrame:
    """Tumbling or sliding event-time windows; ``late`` sets the watermark of a stream."""
    d = df.withWatermark(time, late) if late else df
    g = d.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by).agg(*[v.alias(k) for k, v in aggs.items()])
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *aggs)


def sessions(df: DataFrame, time: str, gap: str, by: tuple[str, ...], late: str | None = None, **aggs: Column) -> DataFrame:
    d = df.withWatermark(time, late) if late else df
    g = d.groupBy(F.session_window(time, gap), *by).agg(*[v.alias(k) for k, v in aggs.items()])
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, *aggs)
