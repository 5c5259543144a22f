"""Deduplicating new batches against all history with a segment index.

Method: a segment index for edit distance. The identifying strings of a record
(name parts, whole name, birth date) stand in a scope it shares only with
possible duplicates of its feed (a contact, an address, a birth date, a name). A
string of length l with bound t is stored as t + 1 segments, each under its
scope, l, the segment's number and content. A string within t edits of another
must contain at least one of the other's segments, so a new string probes the
index with its own substrings of the lengths l - t to l + t around those positions
(multi-match-aware selection). Hits are verified by bounded edit distance, then by
the score of the two profiles; chains of duplicates end in one entity. A batch
appends its own segments after it has been probed.

The index (:class:`Gate`) lives in a folder of shared storage. All its tables are
cut into RANGES ranges of a hash, and a batch reads only the ranges it hits.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linkage as L
from tessera.llm import people as P
from tessera.operators.blocking import PART
from tessera.session import JIT_LIMIT, cut, forget, new_path, settings

#: Ranges of the index; a table holds one folder per batch and range. The more there
#: are, the less of the history a small batch reads.
RANGES = 16


def _spread(rows: DataFrame, keep: list[str], items: list[Column], name: str) -> DataFrame:
    """``keep`` and a row for each of ``items`` that is not null. The array stands in a projection
    of its own and holds its nulls: an expression in the generator itself, or a lambda such as
    that of array_compact, is interpreted row by row instead of compiled."""
    return rows.select(*keep, F.array(*items).alias("__items")).select(*keep, F.explode("__items").alias(name)).where(F.col(name).isNotNull())


def scopes(profiles: DataFrame) -> DataFrame:
    """node, bit, scope: what every node may share with a duplicate. A null attribute makes no scope."""
    name = P.whole_name()
    out = [(P.EMAIL, [F.col("email")]), (P.PHONE, [F.col("phone")]), (P.ADDR, [F.col("addr")]), (P.DOB, [F.col("dob")]), (P.ZIP, [F.col("zip")]), (P.CITY, [F.col("city"), name]), (P.NAMES, [name])]
    arr = [F.when(reduce(and_, [c.isNotNull() for c in scope]), F.struct(F.lit(bit).alias("bit"), F.xxhash64("source", F.lit(bit), *scope).alias("scope"))) for bit, scope in out]
    return _spread(profiles, ["node"], arr, "s").select("node", "s.*").distinct()


def strings(scoped: DataFrame) -> DataFrame:
    """node, bit, scope, kind, text, bound: the strings that must be near within each scope
    (rows node, bit, scope, n1, n2, dob); a null or very short token makes none."""
    text = lambda kind, c, bound: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.alias("text"), F.lit(bound).alias("bound")))
    token = lambda c: text(1, F.when(F.length(F.replace(F.col(c), F.lit("."), F.lit(""))) > 2, F.col(c)), 1)
    bit, contact = F.col("bit"), F.col("bit").isin(P.EMAIL, P.PHONE)
    scope = contact | bit.isin(P.ADDR, P.DOB)
    first = F.when(scope, token("n1")).when(bit == P.ZIP, text(0, P.whole_name(), 1)).otherwise(text(0, F.lit(""), 0))
    return _spread(scoped, ["node", "bit", "scope"], [first, F.when(scope, token("n2")), F.when(contact, text(2, F.col("dob"), 1))], "t").select("node", "bit", "scope", "t.*")


def _own(bound: int) -> list[tuple[int, int, int]]:
    """The bound + 1 segments a string is stored under, as :func:`_keyed` takes them."""
    return [(0, i, 0) for i in range(1, bound + 2)]


def _probes(bound: int) -> list[tuple[int, int, int]]:
    """The substrings that may be segments of strings up to ``bound`` shorter or longer."""
    out = []
    for delta in range(-bound, bound + 1):  # the stored string is delta shorter
        for i in range(1, bound + 2):
            lo, hi = max(-(i - 1), delta - (bound + 1 - i)), min(i - 1, delta + (bound + 1 - i))
            out += [(delta, i, off) for off in range(lo, hi + 1)]
    return out


def _keyed(s: DataFrame, of, bounds: tuple[int, ...]) -> DataFrame:
    """node, bit, k of each place (delta, i, off) that ``of`` gives for the bound of a string: the
    substring that is off from where segment i of a string delta shorter would start. A place is
    a row before it is a key, so the key is compiled once and not once for each place."""
    places = lambda b: F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("delta", "i", "off"), p, strict=True)]) for p in of(b)])
    by = places(bounds[-1])
    for b in bounds[:-1]:
        by = F.when(F.col("bound") == b, places(b)).otherwise(by)
    x = s.select("*", F.length("text").alias("n"), by.alias("__items"))
    x = x.select("node", "bit", "scope", "kind", "text", "bound", "n", F.explode("__items").alias("p")).select("*", "p.*").withColumn("length", F.expr("n - delta"))
    # the last segments are longer by one
    x = x.withColumn("base", F.expr("cast(length div (bound + 1) as int)")).withColumn("short", F.expr("bound + 1 - length % (bound + 1)"))
    x = x.withColumn("at", F.expr("1 + (i - 1) * base + greatest(0, i - 1 - short) + off")).withColumn("size", F.expr("base + if(i > short, 1, 0)"))
    x = x.where("(delta = 0 and off = 0) or (length > 0 and at >= 1 and at + size - 1 <= n)")
    # upper half the scope's, so that a hot scope shows in the key; lower half a hash of all
    h = F.xxhash64("scope", "kind", "bound", "length", "i", F.expr("substr(text, at, size)"))
    return x.select("node", "bit", F.shiftleft(F.shiftright("scope", 32), 32).bitwiseOR(h.bitwiseAND(0xFFFFFFFF)).alias("k"))


def stored(s: DataFrame, bounds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """node, bit, k: the segments of every string; ``bounds`` are those that occur."""
    return _keyed(s, _own, bounds)


def probes(s: DataFrame, bounds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """node, bit, k: the substrings to look up for every string."""
    return _keyed(s, _probes, bounds)


def verified(edges: DataFrame) -> DataFrame:
    """Pairs (with profiles) whose strings are within the bounded edit distance."""
    near = lambda x, y, t: f"coalesce(levenshtein({x}, {y}, {t}) between 0 and {t}, false)"
    tokens = " or ".join(near(f"a_{x}", f"b_{y}", 1) for x in ("n1", "n2") for y in ("n1", "n2"))
    whole = "concat_ws(' ', least({0}_n1, {0}_n2), greatest({0}_n1, {0}_n2))"
    scoped = P.EMAIL | P.PHONE | P.ADDR | P.DOB
    return edges.where(
        F.expr(f"(mask & {scoped}) <> 0 and ({tokens} or {near('a_dob', 'b_dob', 1)})")
        | F.expr(f"(mask & {P.ZIP | P.CITY | P.NAMES}) <> 0 and {near(whole.format('a'), whole.format('b'), 1)}")
    )


def _score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return cut(P.scored_edges(verified(P.with_profiles(edges, nodes))))


def meet(probing: DataFrame, index: DataFrame, hot: DataFrame) -> DataFrame:
    """a < b, mask: nodes that meet in a segment. Scopes of over PART nodes (``hot``: tag, n and
    a row for each o of 0 to n - 1) are cut into n parts, those that probe as well as those that
    are probed; every two parts meet in a group of their own. Only rows of hot scopes multiply."""
    def parts(rows: DataFrame, node: str, own: str, other: str) -> DataFrame:
        x = rows.withColumn("tag", F.shiftright("k", 32)).join(hot, "tag", "left")
        return x.select("k", F.col("node").alias(node), "bit", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("n"))).cast("int").alias(own), F.coalesce("o", F.lit(0)).alias(other))

    p, q = parts(probing, "x", "i", "j"), parts(index, "y", "j", "i").drop("bit")
    return p.join(q, ["k", "i", "j"]).where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.bit_or("bit").alias("mask"))


def _range(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(RANGES)).cast("int").alias("r")


WHO = "h1 long, h2 long, node long, r int"
NODES = "node long, n1 string, n2 string, dob string, entity long, r int"
SCOPES = "scope long, node long, r int"
SEGMENTS = "node long, bit int, k long, r int"
FIRSTS = "entity long, dated boolean, first_seen_at timestamp, first_row long, r int"
MOVES = "entity long, now long"
DATES = "feed string, first long, second long"


class Gate:
    """The index on shared storage, for batches that arrive one after the other.

    ``<table>/batch=<n>/r=<range>`` holds what batch n added: ``who`` (identity ->
    node), ``nodes`` (profile and the entity it came to), ``scopes``, ``segments``, ``firsts``
    (the first record of each entity the batch touched; the latest batch counts).
    ``moves/<n>`` says which entities have become part of another and ``dates/<n>``
    how the feeds write dates. ``commit/<n>`` ends a batch: what a run that died left
    without it is written again, and a gate opened on an existing folder goes on
    from the last commit. A batch reads only the ranges of the tables it hits."""

    def __init__(self, spark: SparkSession, home: str | None = None, fields: dict = P.FIELDS, stand_ins=P.STAND_INS):
        self.spark, self.home, self.fields, self.stand_ins = spark, home or new_path(spark, "gate"), fields, stand_ins
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())
        done = self._path(f"{self.home}/commit")
        self.batches = 1 + max((int(f.getPath().getName()) for f in self._fs.listStatus(done)), default=-1) if self._fs.exists(done) else 0

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, kind: str, schema: str, hit: DataFrame | None = None) -> DataFrame:
        """What the committed batches hold of a table, in the ranges of ``hit`` (a column r)."""
        paths = [p for n in range(self.batches) if self._exists(p := f"{self.home}/{kind}/batch={n}")]
        if not paths:
            return self._none(schema + ", batch int")
        df = self.spark.read.schema(schema + ", batch int").option("basePath", f"{self.home}/{kind}").parquet(*paths)
        if hit is None:
            return df
        ranges = [x.r for x in hit.select("r").distinct().collect()]  # RANGES numbers at most
        return df if len(ranges) == RANGES else df.where(F.col("r").isin(*ranges) if ranges else F.lit(False))

    def _latest(self, kind: str, schema: str) -> DataFrame:
        """A table that every batch writes anew, in full."""
        return self.spark.read.schema(schema).parquet(f"{self.home}/{kind}/{self.batches - 1}") if self.batches else self._none(schema)

    def _none(self, schema: str) -> DataFrame:
        """No rows, in a form the optimiser sees, so that joins with it cost nothing."""
        return self.spark.sql("select " + ", ".join(f"cast(null as {t}) as `{c}`" for c, t in (f.split() for f in schema.split(", "))) + " where false")

    def _write(self, kind: str, df: DataFrame) -> None:
        """A task keeps a file open for each range, so that nothing is sorted by range first."""
        with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": str(RANGES), "spark.sql.codegen.hugeMethodLimit": JIT_LIMIT}):
            df.write.mode("overwrite").partitionBy("r").parquet(f"{self.home}/{kind}/batch={self.batches}")

    def screen(self, batch: DataFrame) -> DataFrame:
        """row_id, source, first_seen_at, entity, late of the records to turn away.

        A record is turned away if its feed already holds an earlier record of the
        same person (first_seen_at, null last, then row_id), in history or in the
        batch itself. Where a record of the batch comes before what was first, or
        shows that two entities are one, the older record that is now a repeat
        comes out too, ``late``. Repeated rows count once; records of which nothing
        is known (null or empty payload) are never turned away."""
        return self.screen_profiles(*self.parse(batch))

    def parse(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        return P.profiles_and_dates(batch, "row_id", "source", "first_seen_at", fields=self.fields, stand_ins=self.stand_ins, before=self._latest("dates", DATES))

    def screen_profiles(self, rec: DataFrame, dates: DataFrame) -> DataFrame:
        """:meth:`screen` of a batch that is parsed already."""
        rec = rec.where(P.known()).select("*", *P.identity("source"))
        who = cut(rec.groupBy("h1", "h2").agg(F.min("row_id").alias("node"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.first("dob").alias("dob")).withColumn("r", _range("h1")))
        was = self.read("who", WHO, who).select("h1", "h2", F.col("node").alias("was"))
        who = cut(who.join(was, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("was", "node").alias("node"), "n1", "n2", "dob", "r", F.col("was").isNull().alias("fresh")), who)
        rec = cut(rec.join(who.select("h1", "h2", "node"), ["h1", "h2"]))
        marks = cut(scopes(rec))
        here = marks.select("scope", "node", _range("scope"))
        # only strings whose scope holds a second node, here or in history, can have a partner
        known = self.read("scopes", SCOPES, here).join(here.select("scope"), "scope", "left_semi").select("scope", "node")
        if self.batches:  # without history there is nothing to keep, nor to look up below
            known = cut(known)
        held = here.select("scope", "node").unionByName(known)
        shared = held.groupBy("scope").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("c")).where("x <> y")
        live = cut(marks.join(shared.select("scope", "c"), "scope").join(who.select("node", "n1", "n2", "dob"), "node"))
        hot = live.where(F.col("c") > PART).groupBy(F.shiftright("scope", 32).alias("tag")).agg(F.max(F.ceil(F.col("c") / PART)).cast("int").alias("n"))
        hot = cut(hot.select("tag", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")))
        texts = strings(live)
        asked = probes(texts).select("*", _range("k"))
        if self.batches:
            asked = cut(asked)
        index = stored(texts).unionByName(self.read("segments", SEGMENTS, asked).select("node", "bit", "k"))
        edges = cut(meet(asked.select("node", "bit", "k"), index, hot))
        # profiles and entities of the old nodes that were hit
        old = who.where("not fresh").select("node").unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")))
        old = cut(old.distinct().select("node", _range("node")))
        before = self.read("nodes", NODES, old).join(old.select("node"), "node", "left_semi").select("node", "n1", "n2", "dob", "entity")
        moves = self._latest("moves", MOVES)
        before = cut(before.join(moves, "entity", "left").select("node", "n1", "n2", "dob", F.coalesce("now", "entity").alias("entity")))
        fresh = who.where("fresh").select("node", "n1", "n2", "dob")
        # within one feed, what is shared says the same however many hold it
        scored = _score(edges.withColumn("crowd", F.lit(0.0)), fresh.unionByName(before.drop("entity")))
        met = before.select(F.col("entity"), _range("entity")).distinct()
        firsts = self.read("firsts", FIRSTS, met).join(met.select("entity"), "entity", "left_semi")
        firsts = cut(firsts.groupBy("entity").agg(F.max_by(F.struct("dated", "first_seen_at", "first_row"), "batch").alias("f")).select("entity", "f.*"))
        ent = L.clusters(self._as_entities(scored, before, firsts))
        step = self._none("vertex long, group long") if ent is None else cut(ent)
        label = before.select("node", F.col("entity").alias("vertex"), F.lit(False).alias("fresh")).unionByName(fresh.select("node", F.col("node").alias("vertex"), F.lit(True).alias("fresh")))
        label = cut(label.join(step, "vertex", "left").select("node", F.coalesce("group", "vertex").alias("entity"), "fresh"))
        # the first record of every entity, old ones under the name they have now
        rows = rec.join(label.select("node", "entity"), "node").select("row_id", "source", "first_seen_at", "entity", F.col("dob").isNotNull().alias("dated"), F.lit(False).alias("held"))
        held = firsts.join(step, firsts["entity"] == step["vertex"], "left").select(F.col("first_row").alias("row_id"), F.lit(None).cast("string").alias("source"), "first_seen_at", F.coalesce("group", "entity").alias("entity"), "dated", F.lit(True).alias("held"))
        every = cut(rows.unionByName(held))
        when = F.struct(F.col("first_seen_at").isNull().alias("n"), "first_seen_at", "row_id")
        first = cut(every.groupBy("entity").agg(F.min(when).alias("f"), F.max("dated").alias("dated"), F.max("source").alias("feed")).select("entity", "dated", "feed", F.col("f.first_seen_at").alias("first_seen_at"), F.col("f.row_id").alias("first_row")))
        # an entity is of one feed, that of the record which touched it
        away = every.join(first.select("entity", "feed", "first_row"), "entity").where("row_id <> first_row")
        away = cut(away.groupBy("row_id").agg(F.max("feed").alias("source"), F.first("first_seen_at").alias("first_seen_at"), F.first("entity").alias("entity"), F.min("held").alias("late")))
        gone = step.join(firsts.select(F.col("entity").alias("vertex")), "vertex", "left_semi").where("vertex <> group").select(F.col("vertex").alias("entity"), F.col("group").alias("now"))
        kept = moves.join(gone.select(F.col("entity").alias("now"), F.col("now").alias("n2")), "now", "left").select("entity", F.coalesce("n2", "now").alias("now"))
        self._write("who", who.where("fresh").select("h1", "h2", "node", "r"))
        self._write("nodes", fresh.join(label, "node").select("node", "n1", "n2", "dob", "entity", _range("node")))
        # a known node in a known scope has its segments already
        new = marks if not self.batches else marks.join(known, ["scope", "node"], "left_anti")
        self._write("scopes", new.select("scope", "node", _range("scope")))
        self._write("segments", stored(strings(new.join(who.select("node", "n1", "n2", "dob"), "node"))).select("*", _range("k")))
        self._write("firsts", first.select("entity", "dated", "first_seen_at", "first_row", _range("entity")))
        kept.unionByName(gone).write.mode("overwrite").parquet(f"{self.home}/moves/{self.batches}")
        dates.select("feed", "first", "second").write.mode("overwrite").parquet(f"{self.home}/dates/{self.batches}")
        self._fs.mkdirs(self._path(f"{self.home}/commit/{self.batches}"))
        self.batches += 1
        for t in (rec, who, marks, known, live, hot, asked, edges, scored, old, before, firsts, label, every, first):
            forget(t)
        return away

    @staticmethod
    def _as_entities(scored: DataFrame, before: DataFrame, firsts: DataFrame) -> DataFrame:
        """Edges between the entities of old nodes instead of the nodes themselves."""
        to = before.join(firsts.select("entity", "dated"), "entity", "left").select("node", "entity", (~F.coalesce("dated", F.lit(False))).alias("open"))
        for x in "ab":
            t = to.select(F.col("node").alias(x), F.col("entity").alias("__e"), F.col("open").alias("__o"))
            scored = scored.join(t, x, "left").withColumns({x: F.coalesce("__e", x), f"{x}_open": F.coalesce("__o", f"{x}_open")}).drop("__e", "__o")
        return scored.where("a <> b")


def turned_away(records: DataFrame, daily: int = 1, home: str | None = None, **params) -> DataFrame:
    """row_id, source, first_seen_at, entity of every record for which its source
    already held a record of the same person: what lies before the last ``daily`` days
    of first_seen_at is taken into the index as one backfill, then each of those days
    as a batch of its own. The answer does not depend on ``daily``."""
    gate = Gate(records.sparkSession, home, **params)
    rec, dates = gate.parse(records)
    day = F.to_date("first_seen_at")
    last = [r.d for r in rec.select(day.alias("d")).where("d is not null").distinct().orderBy(F.desc("d")).limit(daily).collect()] if daily else []
    out = gate.screen_profiles(rec.where(day.isNull() | (day < F.lit(min(last)))) if last else rec, dates)
    for d in sorted(last):
        out = out.unionByName(gate.screen_profiles(rec.where(day == F.lit(d)), dates))
    return out.groupBy("row_id").agg(F.max("source").alias("source"), F.first("first_seen_at").alias("first_seen_at"), F.max("entity").alias("entity"))
