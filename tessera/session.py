"""Session helpers: table loading, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

INTERNAL_PREFIX = "__"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: The JVM does not compile methods of more bytecode, so a wide projection is
#: faster as several methods than as one generated loop.
JIT_LIMIT = "8000"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for the time of a block."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. ``spark.checkpoint.dir`` names it on a
    cluster; only where that is unset in local mode a local folder is made: on a
    cluster its executors could not read each other's files, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    as the files are ordinary shared storage a lost executor loses nothing.
    Tables in ``done`` (made by an earlier cut) are no longer needed and deleted."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    with settings(spark, {"spark.sql.codegen.hugeMethodLimit": JIT_LIMIT}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    for d in done:
        forget(d)
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a cut table."""
    path = df.__dict__.pop("_cut_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
