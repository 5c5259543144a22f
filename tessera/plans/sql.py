"""SQL surface: comparators and normalisers as functions of a session, tables as JSON calls."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType

from tessera.functions import fuzzy, scorers
from tessera.operators import blocking, clusters, frames, identity, matching, quality, relations, stats

#: Normalisers as SQL text; they run in the JVM and give their input back where it cannot be read.
FUNCTIONS = {
    "tessera_strip": "regexp_replace(x, '^\\\\s+|\\\\s+$', '')",
    "tessera_whitespace": "trim(regexp_replace(x, '\\\\s+', ' '))",
    "tessera_email": "case when lower(trim(x)) rlike '^[^@\\\\s]+@[^@\\\\s]+\\\\.[^@\\\\s]+$' then concat(regexp_replace(substring_index(lower(trim(x)), '@', 1), '\\\\+.*$', ''), '@', substring_index(lower(trim(x)), '@', -1)) else x end",
    "tessera_phone": "case when length(regexp_replace(x, '[^0-9]', '')) = 10 then concat('+1', regexp_replace(x, '[^0-9]', '')) else x end",
    "tessera_date": "coalesce(date_format(try_to_date(x), 'yyyy-MM-dd'), x)",
    "tessera_url": "case when trim(x) <> '' then regexp_replace(regexp_replace(lower(trim(x)), '^(?!https?://)', 'https://'), '/$', '') end",
    "tessera_company": "trim(regexp_replace(lower(trim(x)), '[\\s,]+(incorporated|inc|corporation|corp|company|co|limited|ltd|llc|llp|lp|plc|gmbh|ag|sa)\\.?$', ''))",
    "tessera_name_proper": "initcap(trim(regexp_replace(x, '\\s+', ' ')))",
    "tessera_near_signature": "regexp_replace(lower(x), '[^0-9a-z]', '')",
}


def register(spark: SparkSession) -> list[str]:
    """Registers every function and returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(x string) returns string return {body}")
    names = list(FUNCTIONS)
    from pyspark.sql import functions as F

    for name, f in {"jaro_winkler": scorers.jaro_winkler_py, "token_sort": scorers.token_sort_py, "damerau": scorers.damerau_py, **fuzzy.RATIOS}.items():
        spark.udf.register(f"tessera_{name}", F.pandas_udf(scorers._vectorised(f), DoubleType()))
        names.append(f"tessera_{name}")
    return names


def _pairs(spark: SparkSession, name: str) -> DataFrame:
    """A table of pairs: a, b and, where it is there, score."""
    return spark.table(name)


def _passes(c: dict) -> list:
    return [[(k, ts) for k, ts in p] for p in c["passes"]]


def _dedupe(df, c):
    r = matching.dedupe(df, c["id"], _passes(c), [tuple(f) for f in c.get("fields", [])], c["threshold"], dict(c.get("rules", {})))
    return {"golden": r.golden, "pairs": r.scored_pairs, "clusters": r.clusters}[c.get("output", "clusters")]


def _levels(df, c):
    fields = [(f, s, list(t)) for f, s, t in c["fields"]]
    pairs = blocking.multi_pass(df, c["id"], _passes(c))
    lv = matching.levels(matching.attach(pairs, df, df, c["id"], [f[0] for f in fields]), fields)
    return lv, [len(f[2]) + 1 for f in fields], [f[0] for f in fields]


def _train_em(df, c):
    lv, n, names = _levels(df, c)
    return matching.model_report(df.sparkSession, matching.train(lv, n), names)


def _probabilistic(df, c):
    lv, n, _ = _levels(df, c)
    model = matching.train(lv, n)
    return lv.select("a", "b", model.score(len(n)).alias("score"), matching.posterior(model, len(n)).alias("posterior"))


def _explain(df, c):
    fields = [tuple(f) for f in c["fields"]]
    from pyspark.sql import functions as F

    one = df.sparkSession.createDataFrame([(c["a"], c["b"])], ["a", "b"])
    kind = dict(df.dtypes)[c["id"]]
    return matching.explain(matching.attach(one.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")), df, df, c["id"], [f[0] for f in fields]), fields)


def _anomalies(df, c):
    return quality.scan(df).where("check in ('range_distribution', 'future_dated', 'encoding_detection', 'format_detection') and severity = 'WARNING'")


def _preflight(df, c):
    """What a match run would cost before it runs: rows, and blocks and pairs of each pass."""
    from pyspark.sql import functions as F

    out = None
    for i, p in enumerate(_passes(c)):
        keys = df.select(F.col(c["id"]).alias("id"), blocking.static_key(p).alias("k"))
        one = blocking.block_sizes(keys.where("k is not null")).crossJoin(keys.agg(F.count("*").alias("rows"), F.count_if(F.col("k").isNull()).alias("without_key"))).withColumn("pass", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


#: Table functions by name: (table, configuration) to rows.
TABLE_FUNCTIONS = {
    "profile_table": lambda df, c: stats.profile(df),
    "quality_table": lambda df, c: quality.scan(df),
    "health": lambda df, c: quality.health(quality.scan(df)),
    "autofix_table": lambda df, c: frames.auto_fix(df)[0],
    "validate_table": lambda df, c: frames.validate(df, c["rules"])[2],
    "detect_anomalies": _anomalies,
    "threshold": lambda df, c: stats.otsu(df, c["column"]),
    "dedupe_table": _dedupe,
    "match_tables": lambda df, c: matching.match_tables(df, df.sparkSession.table(c["reference"]), c["id"], [(k, ts) for k, ts in c["key"]], [tuple(f) for f in c.get("fields", [])], c["threshold"]),
    "train_em": _train_em,
    "score_probabilistic": _probabilistic,
    "score_pairs": lambda df, c: matching.score_pairs(_pairs(df.sparkSession, c["pairs"]), df, c["id"], [tuple(f) for f in c["fields"]], c.get("threshold", 0.0)),
    "explain": _explain,
    "evaluate": lambda df, c: matching.evaluate_pairs(df, _pairs(df.sparkSession, c["truth"])),
    "evaluate_clusters": lambda df, c: clusters.evaluate(df, df.sparkSession.table(c["truth"])),
    "compare_clusters": lambda df, c: clusters.compare(df, df.sparkSession.table(c["other"])),
    "preflight": _preflight,
    "postflight": lambda df, c: clusters.match_rate(df),
    "benford": lambda df, c: stats.benford(df, c["column"]),
    "near_duplicates": lambda df, c: stats.duplicate_rows(df.select(*c["columns"]) if "columns" in c else df, near=True),
    "discover_dependencies": lambda df, c: relations.functional_dependencies(df, c["columns"]),
    "approximate_dependency": lambda df, c: relations.approximate_dependency(df, c["determinant"], c["dependent"]),
    "composite_keys": lambda df, c: df.sparkSession.createDataFrame([(", ".join(k),) for k in relations.composite_keys(df, c["columns"])], "key string"),
    "certify_keys": lambda df, c: relations.key_certificate(df, c["key"], c.get("measures", [])),
    "similar_texts": lambda df, c: blocking.minhash_links(df, c["id"], c["column"], threshold=c.get("threshold", 0.8)),
    "perceptual_pairs": lambda df, c: blocking.perceptual(df, c["id"], c["column"]),
    "crosswalk": lambda df, c: identity.crosswalk(df, df.sparkSession.table(c["members"]), c["source"], c["source_pk"], c["record"]),
    "identity_events": lambda df, c: identity.events(df, df.sparkSession.table(c["new"])),
    "resolve": lambda df, c: identity.screen(df.sparkSession.table(c["records"]), df, c["id"], c["name"], c.get("threshold", 0.85), c.get("top", 3)),
    "audit_seals": lambda df, c: identity.seal(df, c["order"]),
}


def call(spark: SparkSession, function: str, table: str, config: str = "{}") -> DataFrame:
    """A function of TABLE_FUNCTIONS on a table, with a JSON configuration."""
    if function not in TABLE_FUNCTIONS:
        raise NotImplementedError(f"unknown table function {function!r}")
    return TABLE_FUNCTIONS[function](spark.table(table), json.loads(config))
