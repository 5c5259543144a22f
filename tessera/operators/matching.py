"""Scoring candidate pairs: weighted matchkeys, linkage, Fellegi-Sunter."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scorers as S
from tessera.operators import blocking, clusters, survivorship


def exact_matches(df: DataFrame, id: str, key: Column) -> DataFrame:
    """Pairs a < b of rows with equal, non-null and non-blank keys; score 1."""
    k = df.select(F.col(id).alias("id"), key.alias("k")).where(F.trim("k") != "")
    return blocking.pairs_of(k).withColumn("score", F.lit(1.0))


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """Canonical order, one row per pair, the best score."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def attach(pairs: DataFrame, left: DataFrame, right: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """a, b and structs x, y of the compared columns."""
    x = left.select(F.col(id).alias("a"), F.struct(*columns).alias("x"))
    y = right.select(F.col(id).alias("b"), F.struct(*columns).alias("y"))
    return pairs.join(x, "a").join(y, "b")


def score_pairs(pairs: DataFrame, df: DataFrame, id: str, fields: list[tuple[str, str, float]], threshold: float, right: DataFrame | None = None, negative: list[tuple[str, str, float, float]] = ()) -> DataFrame:
    """a, b, score of the pairs at or above the threshold. fields: (column, scorer,
    weight); negative: (column, scorer, below, penalty) lowers the score where both
    values are known and too different."""
    cols = list(dict.fromkeys([f[0] for f in fields] + [n[0] for n in negative]))
    s = S.weighted(fields, "x", "y")
    for col, name, below, penalty in negative:
        x, y = F.col(f"x.{col}"), F.col(f"y.{col}")
        s = s - F.when(x.isNotNull() & y.isNotNull() & (S.score(name, x, y) < below), penalty).otherwise(0.0)
    return attach(pairs, df, df if right is None else right, id, cols).select("a", "b", s.alias("score")).where(F.col("score") >= threshold)


def without_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that were not matched before, in either order."""
    k = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(k, ["a", "b"], "left_anti")


def match_tables(target: DataFrame, reference: DataFrame, id: str, key_fields, fields, threshold: float) -> DataFrame:
    """a (target), b (reference), score for pairs of one block."""
    t = target.select(F.col(id).alias("a"), blocking.static_key(key_fields).alias("k")).where("k is not null")
    r = reference.select(F.col(id).alias("b"), blocking.static_key(key_fields).alias("k")).where("k is not null")
    return score_pairs(t.join(r, "k").select("a", "b").distinct(), target, id, fields, threshold, right=reference)


def best_one_to_one(scored: DataFrame) -> DataFrame:
    """Greedy assignment: repeatedly the pairs that are best for both their ends (each end is used once)."""
    from tessera.session import cut

    rest, out = cut(scored.select("a", "b", "score")), None
    while rest.take(1):
        order = lambda o: F.struct("score", (-F.col(o)).alias("o"))
        ba = rest.groupBy("a").agg(F.max_by("b", order("b")).alias("b"))
        bb = rest.groupBy("b").agg(F.max_by("a", order("a")).alias("a"))
        pick = cut(ba.join(bb, ["a", "b"]).join(rest, ["a", "b"]).select("a", "b", "score"))
        out = pick if out is None else out.unionByName(pick)
        rest = cut(rest.join(pick.select("a"), "a", "left_anti").join(pick.select("b"), "b", "left_anti"))
    return out if out is not None else scored.select("a", "b", "score").limit(0)


@dataclass
class DedupeResult:
    scored_pairs: DataFrame
    clusters: DataFrame
    golden: DataFrame
    dupes: DataFrame
    unique: DataFrame
    stats: dict = field(default_factory=dict)


def dedupe(df: DataFrame, id: str, passes: list, fields: list[tuple[str, str, float]], threshold: float, rules: dict, max_cluster: int = 100) -> DedupeResult:
    """Block, score, cluster, split what is too large, and merge each cluster into one record."""
    scored = score_pairs(blocking.multi_pass(df, id, passes), df, id, fields, threshold)
    m = clusters.split_oversized(clusters.components(scored, df.select(id)), scored, max_cluster)
    rows = df.join(m, df[id] == m["member"]).drop("member")
    size = m.groupBy("cluster_id").agg(F.count("*").alias("n"))
    many = rows.join(size.where("n > 1").select("cluster_id"), "cluster_id", "left_semi")
    single = rows.join(size.where("n = 1").select("cluster_id"), "cluster_id", "left_semi")
    return DedupeResult(scored, m, survivorship.golden(many, "cluster_id", id, rules), many, single)


# ---- Fellegi-Sunter -----------------------------------------------------
def levels(pairs: DataFrame, fields: list[tuple[str, str, list[float]]]) -> DataFrame:
    """a, b, g0.. : the agreement level of each field; a field with thresholds
    [t1 > t2 > ..] has levels 0 (below all) to len; null on either side is -1."""
    out = []
    for i, (col, name, ts) in enumerate(fields):
        x, y = F.col(f"x.{col}"), F.col(f"y.{col}")
        s = S.score(name, x, y)
        e = F.lit(0)
        for j, t in enumerate(sorted(ts)):
            e = F.when(s >= t, F.lit(j + 1)).otherwise(e)
        out.append(F.when(x.isNull() | y.isNull(), F.lit(-1)).otherwise(e).alias(f"g{i}"))
    return pairs.select("a", "b", *out)


@dataclass
class FellegiSunter:
    match_share: float
    m: list[list[float]]
    u: list[list[float]]

    def weights(self) -> list[list[float]]:
        return [[math.log2(max(a, 1e-9) / max(b, 1e-9)) for a, b in zip(x, y)] for x, y in zip(self.m, self.u)]

    def score(self, n_fields: int) -> Column:
        """Sum of weights over the observed fields, scaled by the fixed range of all of them to [0, 1], 4 digits."""
        w = self.weights()
        total = F.lit(0.0)
        for i in range(n_fields):
            g = F.col(f"g{i}")
            total = total + F.when(g < 0, 0.0).otherwise(F.element_at(F.array(*[F.lit(x) for x in w[i]]), g + 1))
        lo, hi = sum(min(x) for x in w), sum(max(x) for x in w)
        return F.round((total - lo) / (hi - lo), 4)


def train(patterns: DataFrame, n_levels: list[int], u: list[list[float]] | None = None, rounds: int = 50, tolerance: float = 1e-6, start_share: float = 0.05) -> FellegiSunter:
    """EM over counted level patterns. The pairs are grouped to one row per distinct
    pattern (at most the product of level counts, whatever the number of pairs);
    only that table is gathered."""
    k = len(n_levels)
    return train_counts([(tuple(r[f"g{i}"] for i in range(k)), r["n"]) for r in patterns.groupBy(*[f"g{i}" for i in range(k)]).agg(F.count("*").alias("n")).collect()], n_levels, u, rounds, tolerance, start_share)


def train_counts(counts: list[tuple[tuple[int, ...], int]], n_levels: list[int], u: list[list[float]] | None = None, rounds: int = 50, tolerance: float = 1e-6, start_share: float = 0.05) -> FellegiSunter:
    """EM over (levels, number of pairs), one entry per pattern."""
    counts = sorted(counts)
    if u is None:
        u = []
        for i, levels_ in enumerate(n_levels):
            c = [1e-6] * levels_
            for g, n in counts:
                if g[i] >= 0:
                    c[g[i]] += n
            u.append([x / sum(c) for x in c])
    m = [[2.0**j / sum(2.0**q for q in range(n)) for j in range(n)] for n in n_levels]
    share = start_share
    for _ in range(rounds):
        new = [[1e-6] * n for n in n_levels]
        match = total = 0.0
        for g, n in counts:
            a, b = share, 1 - share
            for i, lv in enumerate(g):
                if lv >= 0:
                    a, b = a * m[i][lv], b * u[i][lv]
            p = a / (a + b) if a + b else 0.0
            match, total = match + p * n, total + n
            for i, lv in enumerate(g):
                if lv >= 0:
                    new[i][lv] += p * n
        nxt = [[x / sum(row) for x in row] for row in new]
        moved = max(abs(x - y) for r, s in zip(nxt, m) for x, y in zip(r, s))
        m, share = nxt, min(max(match / total if total else share, 1e-6), 1 - 1e-6)
        if moved < tolerance:
            break
    return FellegiSunter(share, m, u)


def link_all(df: DataFrame, id: str, fields: list[tuple[str, str, list[float]]], threshold: float, rows: int = 4000, least: int = 8) -> DataFrame:
    """a < b, score of all pairs of rows at or above the threshold of a Fellegi-Sunter model.

    Every row meets every row, so nothing is lost to a block: blocks of about ``rows`` rows
    meet as matrices, once to count the patterns that train the model and once to give
    the pairs that meet the threshold. Time and result grow with the square of the rows."""
    from tessera.functions import patterns as P

    specs, n_levels = [(s, sorted(ts)) for _, s, ts in fields], [len(ts) + 1 for _, _, ts in fields]
    form = {P.DICE: lambda c: F.transform(S.tokens(c), lambda w: F.xxhash64(w)), P.EXACT: lambda c: c.cast("string"), P.PERCENT: lambda c: c.try_cast("double")}
    x = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), *[form[P.kind_of(s)](F.col(c)).alias(f"f{i}") for i, (c, s, _) in enumerate(fields)])
    n = x.count()
    nb = max(math.ceil(n / rows), min(least, math.ceil(n / P.TILE)), 1)
    x = x.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int"))
    groups = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select("*", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j")).drop("o").groupBy("i", "j")

    counts = groups.applyInArrow(P.counter(specs), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # one row per pattern

    def levels_of(code):
        out = []
        for m in reversed(n_levels):
            code, g = divmod(code, m + 1)
            out.append(g - 1)
        return tuple(reversed(out))

    model = train_counts([(levels_of(r["code"]), r["n"]) for r in counts], n_levels)
    kind = dict(x.dtypes)["id"]
    scored = df.sparkSession.createDataFrame([(r["code"], *levels_of(r["code"])) for r in counts], "code int, " + ", ".join(f"g{i} int" for i in range(len(fields))))
    score = {r["code"]: r["score"] for r in scored.select("code", model.score(len(fields)).alias("score")).where(F.col("score") >= threshold).collect()}
    if not score:
        return x.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score")).limit(0)
    size = math.prod(m + 1 for m in n_levels)
    import numpy as np

    hits = groups.applyInArrow(P.finder(specs, np.isin(np.arange(size), list(score))), f"x {kind}, y {kind}, code int")
    value = F.element_at(F.array(*[F.lit(score.get(i)).cast("double") for i in range(size)]), F.col("code") + 1)
    return hits.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), value.alias("score"))


# ---- evaluation ---------------------------------------------------------
def evaluate_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; the order within a pair does not matter."""
    c = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = c(predicted).withColumn("p", F.lit(1)).join(c(truth).withColumn("t", F.lit(1)), ["a", "b"], "full")
    n = x.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    z = F.lit(0.0)
    n = n.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), z)).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), z))
    return n.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), z))


def threshold_sweep(scored: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 of every threshold in one pass over the pairs."""
    t = truth.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("t", F.lit(1))
    x = dedup_pairs(scored).join(t, ["a", "b"], "full")
    flat = x.agg(F.count("t").alias("true"), *[e for i, th in enumerate(thresholds) for e in (F.count_if((F.col("score") >= th) & F.col("t").isNotNull()).alias(f"tp{i}"), F.count_if((F.col("score") >= th) & F.col("t").isNull()).alias(f"fp{i}"))])
    rows = flat.select("true", F.explode(F.array(*[F.struct(F.lit(float(th)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, th in enumerate(thresholds)])).alias("r")).select("r.*", (F.col("true") - F.col("r.tp")).alias("fn"))
    z = F.lit(0.0)
    rows = rows.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), z)).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), z))
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), z))


def top_k_similar(df: DataFrame, id: str, vector: str, query: list[float], k: int = 10, threshold: float = 0.0) -> DataFrame:
    """The k rows most similar to a query vector (cosine), best first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(F.col(id).alias("id"), S.cosine(F.col(vector), q).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k)


def top_k_search(df: DataFrame, queries: DataFrame, id: str, vector: str, k: int = 10, rows: int = 20_000, block: int = 2_000) -> DataFrame:
    """query, id, score, rank: for every query vector the k rows of greatest cosine (ties: the
    least id), a query itself among them if it is a row.

    Blocks of about ``block`` queries meet blocks of about ``rows`` rows as one matrix
    product each, which keeps k per query; those are merged per query. Every row is
    compared with every query. Zero and null vectors score 0 and nothing."""
    import numpy as np

    d = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    q = queries.select(F.col(id).alias("query"), F.col(vector).cast("array<double>").alias("q")).where("q is not null")
    nd, nq = max(1, math.ceil(d.count() / rows)), max(1, math.ceil(q.count() / block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = d.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(nd)).cast("int").alias("r"), every(nq).alias("c"))
    q = q.select("query", "q", F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int").alias("c"), every(nd).alias("r"))

    def unit(vs):
        m = np.stack([np.asarray(v, float) for v in vs])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def best(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        left = left.sort_values("id", ignore_index=True)
        s = unit(right.q) @ unit(left.v).T
        n = min(k, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :n]  # stable: ties keep the least id
        return pd.DataFrame({"query": np.repeat(right["query"].to_numpy(), n), "id": left.id.to_numpy()[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    part = d.groupBy("r", "c").cogroup(q.groupBy("r", "c")).applyInPandas(best, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- term frequency -----------------------------------------------------
def term_frequencies(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Per column a table value, tf (share of the non-null rows)."""
    out = {}
    for c in columns:
        v = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
        n = v.agg(F.sum("n").alias("all"))
        out[c] = v.crossJoin(F.broadcast(n)).select("value", (F.col("n") / F.col("all")).alias("tf"))  # one row
    return out


def with_term_frequency(pairs: DataFrame, tables: dict[str, DataFrame], u: dict[str, float]) -> DataFrame:
    """``pairs`` (a, b, structs x, y) with ``tf_<column>``: log2(u / tf) where both hold the same
    value, so an agreement on a rare value counts more than the average agreement (u) and
    one on a common value less; 0 where they differ or one is null."""
    for c, t in tables.items():
        t = t.select(F.col("value").alias("__v"), F.col("tf").alias("__tf"))
        same = F.when(F.col(f"x.{c}") == F.col(f"y.{c}"), F.col(f"x.{c}"))
        pairs = pairs.join(t, same == F.col("__v"), "left").withColumn(f"tf_{c}", F.coalesce(F.log2(F.lit(float(u[c])) / F.col("__tf")), F.lit(0.0))).drop("__v", "__tf")
    return pairs


def estimate_u(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, u: probability that two rows drawn at random agree exactly, from value counts."""
    one = lambda c, t: t.agg(F.coalesce(F.sum(F.col("tf") * F.col("tf")), F.lit(0.0)).alias("u")).select(F.lit(c).alias("column"), "u")
    from functools import reduce

    return reduce(DataFrame.unionByName, [one(c, t) for c, t in term_frequencies(df, columns).items()])


def supervised(patterns: DataFrame, n_levels: list[int], label: str = "match") -> FellegiSunter:
    """m, u and the match share from labelled patterns (g0.., boolean label), counted in one aggregate."""
    k = len(n_levels)
    rows = patterns.groupBy(label, *[f"g{i}" for i in range(k)]).agg(F.count("*").alias("n")).collect()  # at most 2 x the patterns
    m, u = ([[1e-6] * n for n in n_levels] for _ in range(2))
    total = {True: 0, False: 0}
    for r in rows:
        total[bool(r[label])] += r["n"]
        for i in range(k):
            if r[f"g{i}"] >= 0:
                (m if r[label] else u)[i][r[f"g{i}"]] += r["n"]
    norm = lambda t: [[x / sum(row) for x in row] for row in t]
    return FellegiSunter(total[True] / max(1, sum(total.values())), norm(m), norm(u))


def posterior(model: FellegiSunter, n_fields: int) -> Column:
    """P(match) of a pattern: prior odds times the Bayes factors of its observed fields."""
    bits = F.lit(math.log2(model.match_share / (1 - model.match_share)))
    for i, w in enumerate(model.weights()[:n_fields]):
        g = F.col(f"g{i}")
        bits = bits + F.when(g < 0, 0.0).otherwise(F.element_at(F.array(*[F.lit(x) for x in w]), g + 1))
    return 1 / (1 + F.pow(F.lit(2.0), -bits))


def model_report(spark, model: FellegiSunter, names: list[str]) -> DataFrame:
    """field, level, m, u, weight of every level, and two_random (the match share) on each row."""
    rows = [(f, j, float(a), float(b), float(w), float(model.match_share)) for f, x, y, z in zip(names, model.m, model.u, model.weights()) for j, (a, b, w) in enumerate(zip(x, y, z))]
    return spark.createDataFrame(rows, "field string, level int, m double, u double, weight double, two_random double")


def explain(pairs: DataFrame, fields: list[tuple[str, str, float]]) -> DataFrame:
    """a, b, field, score, weight, share: what each field adds to a weighted score
    (share of the weights known on both sides; null where a side is null)."""
    parts, den = [], F.lit(0.0)
    for col, name, w in fields:
        x, y = F.col(f"x.{col}"), F.col(f"y.{col}")
        seen = x.isNotNull() & y.isNotNull()
        den = den + F.when(seen, F.lit(float(w))).otherwise(0.0)
        parts.append(F.struct(F.lit(col).alias("field"), F.when(seen, S.score(name, x, y)).alias("score"), F.lit(float(w)).alias("weight")))
    p = pairs.select("a", "b", den.alias("den"), F.explode(F.array(*parts)).alias("p")).select("a", "b", "den", "p.*")
    return p.select("a", "b", "field", "score", "weight", F.try_divide(F.col("score") * F.col("weight"), F.col("den")).alias("share"))


def recall_estimate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Capture and recapture: pairs found by two independent ways, by both, and the estimated
    number of true pairs (Chapman) and recall of their union. Columns n_a, n_b, n_both, total, recall."""
    c = lambda d, n: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(n, F.lit(1))
    x = c(a, "p").join(c(b, "q"), ["a", "b"], "full").agg(F.count("p").alias("n_a"), F.count("q").alias("n_b"), F.count(F.col("p") + F.col("q")).alias("n_both"))
    total = (F.col("n_a") + 1) * (F.col("n_b") + 1) / (F.col("n_both") + 1) - 1
    return x.withColumn("total", total).withColumn("recall", F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("n_a") + F.col("n_b") - F.col("n_both"), "total")), F.lit(1.0)))


def top_k_fuzzy(df: DataFrame, queries: DataFrame, id: str, column: str, scorer: str = "levenshtein", k: int = 3, q: int = 3) -> DataFrame:
    """query, id, score, rank: the k best values of a column for every query text (ties: the
    least id), among those that share a q-gram with it; equal texts are scored once, and as no
    more than the k least ids of a text can be among the best, only those meet the queries."""
    gram = lambda c: F.explode(S.qgrams(F.col(c), q))
    d = df.where(F.col(column).isNotNull()).select(F.col(id).alias("id"), F.col(column).alias("t"))
    u = queries.where(F.col(column).isNotNull()).select(F.col(id).alias("query"), F.col(column).alias("u"))
    best = lambda by, *o: F.row_number().over(Window.partitionBy(by).orderBy(*o))
    first = d.withColumn("i", best("t", "id")).where(F.col("i") <= k).select("id", "t")
    words, asked = first.select("t").distinct(), u.select("u").distinct()
    met = asked.select("u", gram("u").alias("g")).join(words.select("t", gram("t").alias("g")), "g").select("u", "t").distinct()
    s = met.withColumn("score", S.score(scorer, F.col("u"), F.col("t"))).join(first, "t")
    s = s.withColumn("rank", best("u", F.desc("score"), "id")).where(F.col("rank") <= k)
    return u.join(s, "u").select("query", "id", "score", "rank")


def ann_pairs(df: DataFrame, id: str, vector: str, dim: int, threshold: float = 0.9, planes: int = 64, bands: int = 8, also: DataFrame | None = None) -> DataFrame:
    """a, b, score: pairs of vectors of at least this cosine among those that share a band of
    their SimHash; ``also`` adds candidate pairs (a, b) of another blocking to them."""
    cand = blocking.simhash(df, id, vector, dim, planes, bands)
    cand = cand if also is None else cand.unionByName(also.select("a", "b")).distinct()
    x = attach(cand, df, df, id, [vector])
    return x.select("a", "b", S.cosine(F.col(f"x.{vector}"), F.col(f"y.{vector}")).alias("score")).where(F.col("score") >= threshold)
