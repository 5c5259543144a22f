"""Frame-level projections: renames, mappings, splits, standardising, validation, fixes."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import transforms as T
from tessera.operators.stats import string_columns


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are not there are ignored."""
    return df.drop(*columns)


def filter_compare(df: DataFrame, column: str, op: str, value: str) -> DataFrame:
    """``column > value`` and the like; the value is text cast to the column's type."""
    c, v = F.col(column), F.lit(value).cast(df.schema[column].dataType)
    ops = {">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v, "=": c == v, "!=": c != v}
    return df.where(ops[op])


def map_columns(df: DataFrame, specs: list[dict]) -> DataFrame:
    """specs: {source, target: name or names, transform: name, names or None}."""
    out = []
    for s in specs:
        ts = s.get("transform") or []
        e = reduce(T.apply, [ts] if isinstance(ts, str) else ts, F.col(s["source"]))
        out += [e.alias(t) for t in ([s["target"]] if isinstance(s["target"], str) else s["target"])]
    return df.select(*out)


def split_column(df: DataFrame, column: str, method: str) -> DataFrame:
    """``split_name``, ``split_name_reverse``, ``split_address``: one column into several."""
    return df.withColumn("__s", T.apply(column, method)).select(*df.columns, "__s.*")


#: Standardisers by name; text they cannot read stays as it is.
STANDARDIZERS = {
    "email": T.email_normalize, "name_proper": T.name_proper, "name_upper": lambda c: F.upper(F.trim(c)), "name_lower": lambda c: F.lower(F.trim(c)), "phone": T.phone_e164,
    "zip5": T.zip_normalize, "address": T.address_standardize, "state": T.state_abbreviate, "strip": T.strip, "trim_whitespace": lambda c: F.trim(T.collapse_whitespace(c)),
}


def standardize(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    def one(c, names):
        e = reduce(lambda x, n: STANDARDIZERS[n](x), names, F.col(c))
        return F.coalesce(e, F.col(c))

    return df.withColumns({c: one(c, names) for c, names in rules.items()})


def auto_fix(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixed, log). Strings: byte-order marks and control characters go, white space
    collapses and is trimmed, null words become null; then rows without any value go.
    log: column, changed (one aggregate over the input)."""
    cols = string_columns(df)

    def fix(c):
        e = F.trim(F.regexp_replace(F.regexp_replace(F.col(c), r"[\x{FEFF}\x{200B}\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"\s+", " "))
        return F.when(~F.lower(e).isin(T.NULL_WORDS), e)

    fixed = df.withColumns({c: fix(c) for c in cols}) if cols else df
    if not cols:
        return fixed.na.drop("all"), df.sparkSession.createDataFrame([], "column string, changed long")
    flat = df.agg(*[F.count_if(~F.col(c).eqNullSafe(fix(c))).alias(c) for c in cols])
    log = flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in cols])).alias("x")).select("x.*")
    return fixed.na.drop("all"), log


FORMATS = {"email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "phone": r"^\+?[0-9][0-9 ().\-]{6,}$", "zip5": r"^\d{5}(-\d{4})?$"}


def rule_holds(rule: dict) -> Column:
    c, kind = F.col(rule["column"]), rule["rule_type"]
    p = rule.get("params", {})
    if kind == "not_null":
        return c.isNotNull()
    ok = {
        "regex": lambda: c.rlike(p["pattern"]),
        "min_length": lambda: F.length(c) >= p["length"],
        "max_length": lambda: F.length(c) <= p["length"],
        "in_set": lambda: c.isin(list(p["values"])),
        "format": lambda: F.trim(c).rlike(FORMATS[p["format"]]),
        "range": lambda: c.between(p["min"], p["max"]),
    }
    if kind not in ok:
        raise NotImplementedError(f"unknown rule {kind!r}")
    return c.isNull() | ok[kind]()


def validate(df: DataFrame, rules: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, quarantined, report). Action ``flag`` adds ``__vf_<column>_<rule>__``,
    ``null`` empties the value, ``quarantine`` moves the row with the reasons in
    ``__quarantine_reason__``; report: column, rule, failed."""
    flat = df.agg(*[F.count_if(~rule_holds(r)).alias(f"r{i}") for i, r in enumerate(rules)])
    report = flat.select(F.explode(F.array(*[F.struct(F.lit(r["column"]).alias("column"), F.lit(r["rule_type"]).alias("rule"), F.col(f"r{i}").alias("failed")) for i, r in enumerate(rules)])).alias("x")).select("x.*")
    reasons = [F.when(~rule_holds(r), F.lit(f"{r['column']}:{r['rule_type']}")) for r in rules if r.get("action", "flag") == "quarantine"]
    why = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    flags = {f"__vf_{r['column']}_{r['rule_type']}__": ~rule_holds(r) for r in rules if r.get("action", "flag") == "flag"}
    marked = df.withColumns({"__quarantine_reason__": F.nullif(why, F.lit("")), **flags})
    emptied = {r["column"]: F.when(rule_holds(r), F.col(r["column"])) for r in rules if r.get("action") == "null"}
    kept = marked.where("__quarantine_reason__ is null").drop("__quarantine_reason__")
    return kept.withColumns(emptied) if emptied else kept, marked.where("__quarantine_reason__ is not null"), report


def stride_sample(df: DataFrame, max_rows: int, *order: str) -> DataFrame:
    """Rows i * n // max_rows of the given order: deterministic, evenly spread."""
    from tessera.operators.blocking import ID, with_row_id

    n = df.agg(F.count("*").alias("__n"))
    x = with_row_id(df, *order).crossJoin(F.broadcast(n))
    i = F.col(ID)
    take = F.floor((i * max_rows + F.col("__n") - 1) / F.col("__n"))
    return x.where((F.col("__n") <= max_rows) | (F.floor(take * F.col("__n") / max_rows) == i) & (take < max_rows)).drop(ID, "__n")


_OPS = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def predicate(text: str) -> Column:
    """A condition in a small safe grammar (and, or, not, comparisons, in, not in;
    names are columns, ``a.x`` a field of struct a). A missing operand makes its
    comparison false."""

    def walk(n) -> Column:
        match n:
            case ast.Expression():
                return walk(n.body)
            case ast.BoolOp():
                return reduce((lambda a, b: a & b) if isinstance(n.op, ast.And) else (lambda a, b: a | b), map(walk, n.values))
            case ast.UnaryOp(op=ast.Not()):
                return ~walk(n.operand)
            case ast.Compare(ops=[op], comparators=[right]):
                if isinstance(op, (ast.In, ast.NotIn)):
                    vals = [e.value for e in right.elts]
                    e = value(n.left).isin(vals)
                    return F.coalesce(~e if isinstance(op, ast.NotIn) else e, F.lit(False))
                if type(op) in _OPS:
                    return F.coalesce(_OPS[type(op)](value(n.left), value(right)), F.lit(False))
        raise NotImplementedError(f"not allowed in a condition: {ast.dump(n)[:60]}")

    def value(n) -> Column:
        match n:
            case ast.Constant():
                return F.lit(n.value)
            case ast.Name():
                return F.col(n.id)
            case ast.Attribute(value=ast.Name()):
                return F.col(f"{n.value.id}.{n.attr}")
        raise NotImplementedError(f"not allowed in a condition: {ast.dump(n)[:60]}")

    return walk(ast.parse(text, mode="eval"))


def frame_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """column, changed: rows of both frames whose value differs; __added__ and __removed__ count keys."""
    cols = [c for c in old.columns if c in new.columns and c != key]
    x = old.select(F.col(key).alias("k"), F.struct(*cols).alias("o")).join(new.select(F.col(key).alias("k"), F.struct(*cols).alias("n")), "k", "full")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    flat = x.agg(F.count_if(F.col("o").isNull()).alias("__added__"), F.count_if(F.col("n").isNull()).alias("__removed__"), *[F.count_if(both & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias(c) for c in cols])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in ["__added__", "__removed__", *cols]])).alias("x")).select("x.*")
