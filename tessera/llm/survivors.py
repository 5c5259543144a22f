"""Best representative of each duplicate group: Bayesian fusion with copy detection.

Every filled value of a member record is a claim of its source (the feed).
Source accuracies and value posteriors are estimated in turn; for each pair of
sources the probability that one copies the other is estimated from how often
they agree on values that are judged false, and copied votes are discounted.
The fused record takes the value of maximum posterior in every field; the
surviving record is the one with most claims, then the latest, then the first.

The posterior of a value depends only on which sources stand behind it and behind
its rivals. So the items (cluster, field) are counted by that pattern - the sets of
sources behind their values - and the estimation runs over the distinct patterns,
until no accuracy and no dependence moves any more; only the model itself (a number
per source and per pair of sources) ever reaches the driver. Claims stay distributed:
they are counted per (cluster, field, value) with partial aggregation, and an item
enters its pattern as at most one entry per set of sources, so a cluster of a third of
all rows does not meet in one task.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Values that only stand in for a missing one (compared trimmed, in lower case).
STAND_INS = frozenset(
    ["", "n/a", "na", "null", "nan", "none", "nil", "unknown", "tbd", "-", "--", "---", ".", "?", "(blank)", "blank", "not provided", "not available", "missing", "na@na.na", "noreply@none.invalid", "none@none.invalid", "0000000000", "000-000-0000", "9999999999", "999-999-9999", "00000", "99999"]
    + ["1900-01-01", "19000101", "01/01/1900", "01.01.1900", "01 jan 1900"]
)
#: Payload keys of the feeds by canonical field.
FIELDS = {
    "first_name": ["first_name", "given", "fname"],
    "last_name": ["last_name", "surname", "lname"],
    "full_name": ["full_name", "name", "applicant", "contact_name", "patient"],
    "email": ["email", "email_addr", "email1", "mail", "contact_email"],
    "phone": ["phone", "tel", "phone_no", "phone1", "mobile", "telephone", "contact_phone"],
    "address": ["address", "street", "addr1", "line1", "addr_line", "residence"],
    "city": ["city", "town"],
    "state": ["state", "st"],
    "zip": ["zip", "postal_code", "zip5"],
    "birth_date": ["birth_date", "dob", "date_of_birth", "birth", "birthdate", "born"],
}
CANONICAL = {k: f for f, ks in FIELDS.items() for k in ks}
CLAIMS = "cluster_id long, row_id long, source string, last_seen_at timestamp, claims array<struct<field:string,value:string,shown:string>>"


def _leaves(o, path=""):
    if isinstance(o, dict):
        for k, v in o.items():
            yield from _leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(o, list):
        for i, v in enumerate(o):
            yield from _leaves(v, f"{path}[{i}]")
    else:
        yield path, o


def claims_of(payload: str | None) -> list[dict]:
    """Filled values of a payload, nested values singly; none for text that is null or not JSON."""
    try:
        o = json.loads(payload)
    except (TypeError, ValueError):
        return []
    out = []
    for path, v in _leaves(o):
        if v is None:
            continue
        shown = re.sub(r"\s+", " ", v if isinstance(v, str) else json.dumps(v)).strip()
        low = shown.lower()
        if low in STAND_INS:
            continue
        out.append({"field": CANONICAL.get(path.rpartition(".")[2].lower(), path) if not path.endswith("]") else path, "value": re.sub(r"[^\w@]+", " ", low).strip() or low, "shown": shown})
    return out


def _claims(batches):
    for pdf in batches:
        pdf["claims"] = [claims_of(p) for p in pdf.payload]
        yield pdf[["cluster_id", "row_id", "source", "last_seen_at", "claims"]]


def members(golden: DataFrame, records: DataFrame) -> DataFrame:
    """cluster_id, row_id, source, last_seen_at, payload of the members named by
    each cluster's latest row (by merged_at, then id; a null merged_at is ignored).
    A null or empty member list, or members that do not exist, give no rows."""
    latest = golden.where("merged_at is not null").groupBy("cluster_id").agg(F.max_by("source_ids", F.struct("merged_at", "id")).alias("ids"))
    named = latest.select("cluster_id", F.explode(F.array_distinct("ids")).alias("row_id"))
    return records.select("row_id", "source", "last_seen_at", "payload").join(named, "row_id").dropDuplicates(["cluster_id", "row_id"])


@dataclass
class Model:
    """Accuracy per source, P(one copies the other) per pair, and how the estimation ended."""

    accuracy: dict[str, float]
    dependence: dict[tuple[str, str], float] = field(default_factory=dict)
    copying: float = 0.8
    n_false: float = 20.0
    rounds: int = 0
    converged: bool = False

    def __getitem__(self, name: str):
        return getattr(self, name)

    def votes(self, by: list[str]) -> float:
        """Log score of a value: each source's vote, less what it may have copied from a better one."""
        total, above = 0.0, []
        for s in sorted(by, key=lambda s: (-self.accuracy[s], s)):
            own = math.prod(1 - self.copying * self.dependence.get((s, t), 0.0) for t in above)
            total += own * math.log(self.n_false * self.accuracy[s] / (1 - self.accuracy[s]))
            above.append(s)
        return total


def posteriors(scores: list[float], counts: list[int], n_false: float) -> list[float]:
    """P(value) for values of these scores (``counts`` values each); what none of the
    n_false + 1 possible values has claimed keeps its share."""
    top = max([*scores, 0.0])
    free = max(0.0, n_false + 1 - sum(counts)) * math.exp(-top)
    z = free + sum(m * math.exp(s - top) for s, m in zip(scores, counts))
    return [math.exp(s - top) / z for s in scores]


def _evidence(model: Model):
    """Per batch of patterns the sums a round needs: of a source its expected true claims
    and its claims; of a pair how often it agrees on true, on false values, or differs."""

    def run(batches):
        acc: dict[str, list[float]] = {}
        pair: dict[tuple[str, str], list[float]] = {}
        for pdf in batches:
            for pattern, c in zip(pdf.pattern, pdf.c):
                by = [list(e["by"]) for e in pattern]
                n = [int(e["m"]) for e in pattern]
                p = posteriors([model.votes(b) for b in by], n, model.n_false)
                best: dict[str, int] = {}
                for i, b in enumerate(by):
                    for s in b:
                        x = acc.setdefault(s, [0.0, 0.0])
                        x[0] += c * n[i] * p[i]
                        x[1] += c * n[i]
                        if s not in best or p[i] > p[best[s]]:
                            best[s] = i
                said = sorted(best)
                for i, a in enumerate(said):
                    for b in said[i + 1 :]:
                        x = pair.setdefault((a, b), [0.0, 0.0, 0.0])
                        x[2 if best[a] != best[b] else 0 if p[best[a]] > 0.5 else 1] += c
        rows = [(a, None, *v, 0.0) for a, v in acc.items()] + [(a, b, *v) for (a, b), v in pair.items()]
        yield pd.DataFrame(rows, columns=["a", "b", "x", "y", "z"])

    return run


def _copies(a: float, b: float, true: float, false: float, differ: float, copying: float, prior: float, n_false: float) -> float:
    """P(one of two sources of these accuracies copies the other), from how they agree."""
    pt, pf, mean = a * b, (1 - a) * (1 - b) / n_false, (a + b) / 2
    qt, qf = copying * mean + (1 - copying) * pt, copying * (1 - mean) + (1 - copying) * pf
    logs = true * math.log(pt / qt) + false * math.log(pf / qf) - differ * math.log(1 - copying)
    return 1 / (1 + (1 - prior) / prior * math.exp(min(50.0, max(-50.0, logs))))


def estimate(patterns: DataFrame, copying: float = 0.8, prior: float = 0.1, n_false: float = 20.0, tolerance: float = 0.001, rounds: int = 200) -> Model:
    """The model of maximum agreement with the patterns (pattern: array of by, m; c: items).

    Rounds go on until nothing moves by ``tolerance``; after the first ten each goes half
    the way, so an estimate that swings comes to rest. ``converged`` says whether it did
    within ``rounds``."""
    model = Model({}, {}, copying, n_false)
    names = [r.s for r in patterns.select(F.explode("pattern").alias("e")).select(F.explode("e.by").alias("s")).distinct().collect()]  # the feeds
    model.accuracy = dict.fromkeys(names, 0.8)
    # an item only one source speaks of says nothing of it
    shared = cut(patterns.where("size(array_distinct(flatten(pattern.by))) > 1"))
    while not model.converged and model.rounds < rounds:
        sums = shared.mapInPandas(_evidence(model), "a string, b string, x double, y double, z double").groupBy("a", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z")).collect()
        acc = model.accuracy | {r.a: min(0.99, max(0.05, r.x / r.y)) for r in sums if r.b is None}
        dep = {}
        for r in sums:
            if r.b is not None:
                dep[r.a, r.b] = dep[r.b, r.a] = _copies(acc[r.a], acc[r.b], r.x, r.y, r.z, copying, prior, n_false)
        step = 1.0 if model.rounds < 10 else 0.5
        acc = {s: model.accuracy[s] + step * (v - model.accuracy[s]) for s, v in acc.items()}
        dep = {k: (old := model.dependence.get(k, 0.0)) + step * (v - old) for k, v in dep.items()}
        moved = max([abs(v - model.accuracy[s]) for s, v in acc.items()] + [abs(v - model.dependence.get(k, 0.0)) for k, v in dep.items()], default=0.0)
        model.accuracy, model.dependence = acc, dep
        model.rounds += 1
        model.converged = moved < tolerance
    return model


def fuse(claims: DataFrame, **params) -> tuple[DataFrame, Model]:
    """Posterior of every claimed value. claims: cluster_id, row_id, source,
    last_seen_at, field, value, shown. Returns (values, model): values has
    cluster_id, field, value, seen, shown, p.

    A source that makes one claim in several records of a cluster has one vote. A
    null source is one source of its own. Ties keep the later, then the smaller value."""
    item = ["cluster_id", "field"]
    feed = F.coalesce("source", F.lit(""))
    # as many sources a value as there are feeds, at most
    values = cut(claims.select("*", feed.alias("feed")).groupBy(*item, "value").agg(F.array_sort(F.collect_set("feed")).alias("by"), F.max("last_seen_at").alias("seen"), F.max_by("shown", F.struct("last_seen_at", "shown")).alias("shown")))
    sets = values.groupBy(*item, "by").agg(F.count("*").alias("m")).groupBy(*item).agg(F.array_sort(F.collect_list(F.struct("by", "m"))).alias("pattern"))
    patterns = cut(sets.groupBy("pattern").agg(F.count("*").alias("c")))
    model = estimate(patterns, **params)

    def votes(batches):
        for pdf in batches:
            pdf["score"] = [model.votes(list(b)) for b in pdf.by]
            yield pdf

    score = cut(values.select("by").distinct().mapInPandas(votes, "by array<string>, score double"))
    w = Window.partitionBy(*item)
    top = F.greatest(F.max("score").over(w), F.lit(0.0))
    e = values.join(score, "by").select(*item, "value", "seen", "shown", "score", top.alias("top"))
    e = e.withColumn("e", F.exp(F.col("score") - F.col("top")))
    free = F.greatest(F.lit(0.0), model.n_false + 1 - F.count("*").over(w)) * F.exp(-F.col("top"))
    return cut(e.select(*item, "value", "seen", "shown", (F.col("e") / (F.sum("e").over(w) + free)).alias("p")), values, patterns), model


def resolve(golden: DataFrame, records: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """(survivors, fused).

    survivors: cluster_id, row_id, filled, support (mean posterior of the
    record's values). fused: cluster_id, record (field -> value of maximum
    posterior), confidence (mean posterior of the chosen values).
    Records without a filled value can survive only where no member has one."""
    people = members(golden, records)
    flat = cut(people.mapInPandas(_claims, CLAIMS).select("cluster_id", "row_id", "source", "last_seen_at", F.explode_outer("claims").alias("c")).select("cluster_id", "row_id", "source", "last_seen_at", "c.*"))
    values, _ = fuse(flat.where("field is not null"), **params)
    scored = flat.join(values.select("cluster_id", "field", "value", "p"), ["cluster_id", "field", "value"], "left")
    per_record = scored.groupBy("cluster_id", "row_id").agg(F.count("p").alias("filled"), F.avg("p").alias("support"), F.max("last_seen_at").alias("seen"))
    best = F.struct("filled", "seen", (-F.col("row_id")).alias("o"))
    survivors = per_record.groupBy("cluster_id").agg(F.max_by(F.struct("row_id", "filled", "support"), best).alias("r")).select("cluster_id", "r.*")
    pick = values.groupBy("cluster_id", "field").agg(F.max_by(F.struct("shown", "p"), F.struct("p", "seen", "value")).alias("b"))
    fused = pick.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "b.shown")))).alias("record"), F.avg("b.p").alias("confidence"))
    return survivors, fused
