"""Sources and sinks: files by suffix, several sources at once, databases, reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.blocking import with_row_id
from tessera.operators.stats import union_all

DELIMITERS = {".csv": ",", ".tsv": "\t", ".tab": "\t", ".psv": "|", ".txt": ",", ".dat": ","}


def read(spark: SparkSession, path: str, separator: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """By suffix: delimited text (every column a string: no leading zero is lost),
    Parquet, ORC, JSON lines, Avro. Paths may be of any file system Spark knows."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in DELIMITERS:
        return spark.read.csv(path, header=True, sep=separator or DELIMITERS[ext], encoding=encoding, inferSchema=False, multiLine=False, quote='"', escape='"')
    if ext in (".json", ".jsonl", ".ndjson"):
        return spark.read.json(path)
    if ext in (".orc", ".parquet", ""):
        return spark.read.format("orc" if ext == ".orc" else "parquet").load(path)
    if ext == ".avro":
        return spark.read.format("avro").load(path)
    if ext in (".xlsx", ".xls"):
        raise NotImplementedError("spreadsheets need a reader that is not part of Spark")
    raise NotImplementedError(f"unknown file type {ext!r}")


def infer_types(df: DataFrame) -> DataFrame:
    """Strings to bigint, double or boolean where every non-empty value converts;
    numbers with a leading zero stay text; empty becomes null. One aggregate."""
    cols = df.columns
    c = lambda x: F.nullif(F.trim(F.col(x)), F.lit(""))
    tests = lambda x: {"lead": F.count_if(c(x).rlike(r"^-?0\d")), "bigint": F.count_if(c(x).isNotNull() & c(x).try_cast("bigint").isNull()), "double": F.count_if(c(x).isNotNull() & c(x).try_cast("double").isNull()), "boolean": F.count_if(c(x).isNotNull() & ~F.lower(c(x)).isin("true", "false")), "n": F.count(c(x))}
    row = df.agg(*[e.alias(f"{x}\x1f{k}") for x in cols for k, e in tests(x).items()]).first()

    def kind(x):
        if not row[f"{x}\x1fn"] or row[f"{x}\x1flead"]:
            return "string"
        return next((k for k in ("bigint", "double", "boolean") if row[f"{x}\x1f{k}"] == 0), "string")

    return df.select(*[c(x).cast(kind(x)).alias(x) for x in cols])


def load_sources(spark: SparkSession, specs: list[tuple], key: list[str]) -> DataFrame:
    """specs: (path or frame, source name, column map). One frame with ``__source__``
    and ``__row_id__`` over the given key."""
    frames = []
    for src, name, columns in specs:
        df = src if isinstance(src, DataFrame) else read(spark, src)
        frames.append(df.withColumnsRenamed(columns or {}).withColumn("__source__", F.lit(name)))
    return with_row_id(union_all(frames), "__source__", *key)


def read_table(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: dict | None = None, **options) -> DataFrame:
    """JDBC source. partition: {column, lower, upper, parts} for a parallel read."""
    r = spark.read.format("jdbc").option("url", url).options(**options)
    r = r.option("query", query) if query else r.option("dbtable", table)
    if partition:
        r = r.option("partitionColumn", partition["column"]).option("lowerBound", partition["lower"]).option("upperBound", partition["upper"]).option("numPartitions", partition["parts"])
    return r.load()


#: Connector name -> data source format and the options it needs.
CONNECTORS = {
    "postgres": ("jdbc", ["url"]), "mysql": ("jdbc", ["url"]), "sqlserver": ("jdbc", ["url"]), "redshift": ("jdbc", ["url"]), "duckdb": ("jdbc", ["url"]), "databricks": ("jdbc", ["url"]),
    "snowflake": ("snowflake", ["sfUrl", "sfDatabase"]), "bigquery": ("bigquery", ["table"]), "mongodb": ("mongodb", ["connection.uri"]),
}


def connect(spark: SparkSession, name: str, config: dict) -> DataFrame:
    """A registered connector; missing options fail before anything runs."""
    if name not in CONNECTORS:
        raise NotImplementedError(f"unknown connector {name!r}")
    fmt, needed = CONNECTORS[name]
    missing = [o for o in needed if o not in config]
    if missing:
        raise ValueError(f"{name}: missing {', '.join(missing)}")
    if fmt == "jdbc":
        return read_table(spark, **config)
    return spark.read.format(fmt).options(**config).load()


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to top-level columns named by their path."""
    from pyspark.sql.types import StructType

    def walk(schema, prefix):
        for f in schema:
            path = [*prefix, f.name]
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, path)
            else:
                yield F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))

    return df.select(*walk(df.schema, []))


def write(df: DataFrame, directory: str, run_name: str, kind: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """golden / dupes / unique of a run; returns the path."""
    path = f"{directory.rstrip('/')}/{run_name}_{kind}.{fmt}"
    w = df.write.mode(mode)
    w.csv(path, header=True) if fmt == "csv" else w.format(fmt).save(path)
    return path


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key, others are added."""
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def report_json(df: DataFrame, limit: int = 1000) -> str:
    """A summary table (metrics, findings) as JSON; ``limit`` bounds what reaches the driver."""
    return json.dumps([r.asDict(recursive=True) for r in df.limit(limit).collect()], default=str, indent=1)


def report_markdown(df: DataFrame, limit: int = 1000) -> str:
    rows = df.limit(limit).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def report_html(df: DataFrame, limit: int = 1000) -> str:
    from html import escape

    rows = df.limit(limit).collect()
    cell = lambda t, v: f"<{t}>{escape('' if v is None else str(v))}</{t}>"
    return "<table><tr>" + "".join(cell("th", c) for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows) + "</table>"
