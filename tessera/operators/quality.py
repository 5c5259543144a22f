"""Data-quality checks. Each gives findings: severity, column, check, message,
affected_rows, confidence. Column checks share one aggregate over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType

from tessera.operators import stats

FINDING = "severity string, column string, check string, message string, affected_rows long, confidence double"
ID_LIKE = ("id", "key", "code", "number", "uuid", "no")
FORMATS = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "phone": r"^\+?[0-9(][0-9 ().\-]{6,18}[0-9]$", "url": r"(?i)^https?://\S+$"}


def _id_like(name: str) -> bool:
    return any(p in ID_LIKE for p in name.lower().split("_")) or name.lower().endswith(("id", "key"))


def measures(df: DataFrame) -> dict[str, dict]:
    """The counts all column checks need, one row back. Distinct values are first
    estimated; exact counts follow only where a check depends on them: few values
    (as a set, bounded by the estimate) or nearly unique ones (one branch a column)."""
    aggs, n = [F.count("*").alias("n")], df.schema
    for i, f in enumerate(n):
        c = F.col(f"`{f.name}`")
        aggs += [F.count_if(c.isNull()).alias(f"null_{i}"), F.approx_count_distinct(c, 0.02).alias(f"distinct_{i}")]
        if isinstance(f.dataType, StringType):
            # each expensive test runs only on values that a cheap one lets through
            if_ = lambda cheap, test: F.count_if(F.when(cheap, test))
            number, wide = c.rlike(r"^\s*[-+.0-9NnIi]"), F.length(c) != F.octet_length(c)
            aggs += [if_(number, c.try_cast("double").isNotNull()).alias(f"numeric_{i}"), if_(number, c.try_cast("bigint").isNotNull()).alias(f"integer_{i}")]
            guard = {"email": c.contains("@"), "phone": F.length(c) <= 20, "url": F.lower(F.substring(c, 1, 4)) == "http"}
            aggs += [if_(guard[k], c.rlike(p)).alias(f"{k}_{i}") for k, p in FORMATS.items()]
            aggs += [if_(wide, c.rlike(r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]")).alias(f"zero_{i}"), if_(wide, c.rlike("[‘’“”]")).alias(f"quote_{i}"), F.count_if(c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).alias(f"control_{i}"), F.count_if(wide).alias(f"ascii_{i}")]
        if isinstance(f.dataType, NumericType):
            x = c.cast("double")
            aggs += [F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
        if isinstance(f.dataType, (DateType, TimestampType)):
            aggs += [F.count_if(c > F.current_timestamp()).alias(f"future_{i}"), F.datediff(F.current_date(), F.max(c).cast("date")).alias(f"age_{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, f in enumerate(n):
        out[f.name] = {k[: -len(str(i)) - 1]: row[k] for k in row.asDict() if k.endswith(f"_{i}") and k.rsplit("_", 1)[1] == str(i)} | {"n": row["n"], "type": f.dataType}
    few = [c for c, v in out.items() if v["distinct"] <= 50]
    many = [c for c, v in out.items() if c not in few and v["distinct"] >= 0.9 * (v["n"] - v["null"])]
    if few:
        row = df.agg(*[F.size(F.collect_set(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(few)]).first()
        for i, c in enumerate(few):
            out[c]["distinct"] = row[i]
    exact = [df.agg(F.lit(c).alias("c"), F.count_distinct(F.col(f"`{c}`")).alias("k")) for c in many]
    if exact:
        for r in reduce(DataFrame.unionByName, exact).collect():
            out[r.c]["distinct"] = r.k
    return out


def _outliers(df: DataFrame, m: dict) -> dict[str, tuple[int, int]]:
    cols = [(c, v) for c, v in m.items() if v.get("std")]
    if not cols:
        return {}
    x = lambda c, v: F.abs(F.col(f"`{c}`").cast("double") - v["mean"])
    row = df.agg(*[e for i, (c, v) in enumerate(cols) for e in (F.count_if(x(c, v) > 3 * v["std"]).alias(f"a{i}"), F.count_if(x(c, v) > 5 * v["std"]).alias(f"b{i}"))]).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, (c, _) in enumerate(cols)}


def scan(df: DataFrame) -> DataFrame:
    """Nullability, uniqueness, cardinality, type, range, format, encoding and date checks as findings."""
    m = measures(df)
    out = []
    add = lambda sev, c, check, msg, rows=0, conf=1.0: out.append((sev, c, check, msg, int(rows), float(conf)))
    for c, v in m.items():
        n, nulls, d = v["n"], v["null"], v["distinct"]
        if not n:
            continue
        filled = n - nulls
        if nulls == n:
            add("ERROR", c, "nullability", "all values are null", n, 0.99)
        elif nulls == 0 and n >= 10:
            add("INFO", c, "nullability", "no nulls: may be required", 0, 0.95 if n >= 1000 else 0.5 if n < 50 else 0.7)
        elif 0 < nulls < 0.05 * n and n >= 100:
            add("WARNING", c, "nullability", "nulls in a column that is nearly always filled", nulls, 0.75)
        elif nulls > 0.8 * n or (nulls > 0.05 * n and n >= 100):
            add("INFO", c, "nullability", "optional column", nulls)
        if filled and d == filled and n >= 10:
            add("INFO", c, "uniqueness", "all values are different", 0, 0.95)
        elif filled and d > 0.95 * filled and _id_like(c):
            add("WARNING", c, "uniqueness", "repeated values in a column that looks like an id", filled - d, 0.6)
        if filled and d < 20 and n >= 50:
            add("INFO", c, "cardinality", f"{d} distinct values: may be an enumeration")
        if isinstance(v["type"], StringType) and filled:
            if v["numeric"] >= 0.8 * filled:
                add("WARNING", c, "type_inference", "integers kept as text" if v["integer"] > 0.9 * filled else "numbers kept as text", v["numeric"], v["numeric"] / filled)
            elif 0 < v["numeric"] <= 0.05 * filled:
                add("INFO", c, "type_inference", "a few numbers among text", v["numeric"], 0.3)
            for k in FORMATS:
                if v[k] > 0.7 * filled and v[k] < filled:
                    add("WARNING", c, "format_detection", f"values that are no {k}", filled - v[k], 0.8)
                elif v[k] == filled:
                    add("INFO", c, "format_detection", f"all values are {k}s")
            for k, what in (("zero", "zero-width characters"), ("quote", "typographic quotes"), ("control", "control characters"), ("ascii", "characters outside ASCII")):
                if v[k]:
                    add("INFO" if k == "ascii" else "WARNING", c, "encoding_detection", what, v[k], 0.9)
        if isinstance(v["type"], NumericType) and _id_like(c):
            add("WARNING", c, "type_inference", "numeric column that looks like an id", 0, 0.5)
        if v.get("future"):
            add("WARNING", c, "future_dated", "values in the future", v["future"], 0.8)
        if v.get("age") is not None and v["age"] > 365 and "update" in c.lower():
            add("WARNING", c, "stale_data", f"newest value is {v['age']} days old", 0, 0.7)
    for c, (three, five) in _outliers(df, m).items():
        add("INFO", c, "range_distribution", f"min {m[c]['min']}, max {m[c]['max']}, mean {m[c]['mean']}")
        if three:
            add("WARNING", c, "range_distribution", "values beyond three standard deviations", three, 0.9 if five else 0.7)
    return df.sparkSession.createDataFrame(out, FINDING)


def patterns(df: DataFrame, column: str) -> DataFrame:
    """pattern, n, share: letters become L, digits D."""
    p = F.regexp_replace(F.regexp_replace(F.col(column), r"\p{L}", "L"), r"[0-9]", "D")
    g = df.where(F.col(column).isNotNull()).groupBy(p.alias("pattern")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("pattern", "n", (F.col("n") / F.col("t")).alias("share"))


def pattern_findings(df: DataFrame, column: str) -> DataFrame:
    """Rare patterns: below 5 % WARNING, below 30 % INFO."""
    return patterns(df, column).where("share < 0.3").select(F.when(F.col("share") < 0.05, "WARNING").otherwise("INFO").alias("severity"), F.lit(column).alias("column"), F.lit("pattern_consistency").alias("check"), F.concat(F.lit("rare pattern "), "pattern").alias("message"), F.col("n").alias("affected_rows"), F.lit(0.7).alias("confidence"))


def drift(df: DataFrame, column: str, order: str) -> DataFrame:
    """Mean of the second half of the rows (by order) against the first: first_mean, second_mean, sigmas."""
    from tessera.operators.blocking import ID, with_row_id

    x = with_row_id(df.select(order, F.col(column).cast("double").alias("x")), order)
    n = x.agg(F.count("*").alias("n"))
    h = x.crossJoin(F.broadcast(n)).select("x", (F.col(ID) < F.floor(F.col("n") / 2)).alias("first"))
    return h.agg(F.avg(F.when(F.col("first"), F.col("x"))).alias("first_mean"), F.avg(F.when(~F.col("first"), F.col("x"))).alias("second_mean"), F.stddev_samp(F.when(F.col("first"), F.col("x"))).alias("s")).select("first_mean", "second_mean", F.try_divide(F.abs(F.col("second_mean") - F.col("first_mean")), "s").alias("sigmas"))


def new_categories(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    return second.select(column).distinct().where(F.col(column).isNotNull()).join(first.select(column).distinct(), column, "left_anti")


def check_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Pinned rules (see ``frames.rule_holds``) as findings; columns that are missing are errors."""
    from tessera.operators.frames import rule_holds

    out = [("ERROR", r["column"], "existence", "column is missing", 0, 1.0) for r in rules if r["column"] not in df.columns]
    here = [r for r in rules if r["column"] in df.columns]
    if here:
        row = df.agg(*[F.count_if(~rule_holds(r)).alias(f"r{i}") for i, r in enumerate(here)]).first()
        out += [("ERROR", r["column"], r["rule_type"], "rule is broken", int(row[i]), 1.0) for i, r in enumerate(here) if row[i]]
    known = {r["column"] for r in rules}
    out += [("INFO", c, "unmapped_column", "no rule names this column", 0, 1.0) for c in df.columns if c not in known]
    return df.sparkSession.createDataFrame(out, FINDING)


def boosted(findings: DataFrame) -> DataFrame:
    """Corroboration: a column flagged by two checks gains 0.1 confidence, by three or more 0.2 (1 at most)."""
    k = findings.where("severity <> 'INFO'").groupBy("column").agg(F.count_distinct("check").alias("k"))
    gain = F.when(F.col("k") >= 3, 0.2).when(F.col("k") == 2, 0.1).otherwise(0.0)
    return findings.join(k, "column", "left").withColumn("confidence", F.when(F.col("severity") == "INFO", F.col("confidence")).otherwise(F.least(F.lit(1.0), F.col("confidence") + gain))).drop("k").select(*findings.columns)


def health(findings: DataFrame) -> DataFrame:
    """score (100 less 10 per error and 3 per warning, 20 a column at most) and grade."""
    per = findings.groupBy("column").agg(F.least(10 * F.count_if(F.col("severity") == "ERROR") + 3 * F.count_if(F.col("severity") == "WARNING"), F.lit(20)).alias("p"))
    s = per.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum("p"), F.lit(0))).alias("score"))
    g = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return s.withColumn("grade", g)


def fuzzy_values(df: DataFrame, column: str, ratio: float = 0.82) -> DataFrame:
    """value_a, value_b, similarity of distinct values that are nearly alike (blocked by trigrams of the value)."""
    from tessera.functions.scorers import levenshtein, qgrams

    v = df.select(F.trim(F.col(column)).alias("v")).where("v <> ''").distinct()
    k = v.select("v", F.explode(qgrams(F.col("v"), 3)).alias("k"))
    a, b = k.select(F.col("v").alias("value_a"), "k"), k.select(F.col("v").alias("value_b"), "k")
    p = a.join(b, "k").where("value_a < value_b").select("value_a", "value_b").distinct()
    return p.withColumn("similarity", levenshtein(F.lower("value_a"), F.lower("value_b"))).where(F.col("similarity") >= ratio)


def string_profile(df: DataFrame) -> DataFrame:
    return stats.string_digest(df)
