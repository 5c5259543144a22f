"""Candidate pairs. Every strategy turns rows into (id, key) and pairs equal keys.

All of them give columns a < b, once per pair. :func:`block_sizes` shows what a
key would cost before it is paired; :func:`adaptive` splits large blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import sketches
from tessera.functions.transforms import apply
from tessera.session import cut

ID = "__row_id__"


def with_row_id(df: DataFrame, *stable_key: str, offset: int = 0) -> DataFrame:
    """Row numbers from 0 over a stable key (they do not depend on partitioning).

    Numbered by range: each range partition counts its rows, then adds the rows before it."""
    parts = df.repartitionByRange(*stable_key).sortWithinPartitions(*stable_key).withColumn("__p", F.spark_partition_id())
    parts = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*stable_key)))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))  # one row per partition
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return parts.join(F.broadcast(before), "__p").withColumn(ID, F.col("__b") + F.col("__i") - 1 + offset).drop("__p", "__i", "__b")


def static_key(fields: list[tuple[str, list[str]]]) -> Column:
    """Transformed fields joined by ``||``; null if any part is null or a null word."""
    parts = [chained(c, ts) for c, ts in fields]
    ok = reduce(lambda x, y: x & y, [p.isNotNull() & ~F.lower(F.trim(p)).isin("", "nan", "null", "none") for p in parts])
    return F.when(ok, F.concat_ws("||", *parts))


def chained(c: str, ts: list[str]) -> Column:
    return reduce(apply, ts, F.col(c).cast("string"))


#: Rows of a key that meet in one group; more are cut into parts of about this size.
PART = 2000


def parts_of(rows: DataFrame, key: list[str], by: str, part: int = PART) -> DataFrame:
    """``rows`` with __n, the number of parts their key is cut into, and __own, the part of the row.
    Only keys of more than ``part`` rows are cut; those (rows / part at most) are all that is joined."""
    hot = rows.groupBy(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(key)]).agg(F.count("*").alias("__c")).where(F.col("__c") > part)
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(key)])
    x = rows.join(hot, cond, "left").select(*rows.columns, F.coalesce(F.ceil(F.col("__c") / part), F.lit(1)).cast("int").alias("__n"))
    return x.withColumn("__own", F.pmod(F.xxhash64(by), F.col("__n")).cast("int"))


def meetings(rows: DataFrame, key: list[str], by: str, part: int = PART) -> DataFrame:
    """Ordered pairs of rows of equal key as structs x, y, ``x.by < y.by``.

    A hot key is cut into parts and every two parts meet in a group of their own,
    so no group holds more than ``part`` rows a side, and no pair is lost."""
    s = parts_of(rows, key, by, part)
    other = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    cols = F.struct(*rows.columns)
    x = s.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], cols.alias("x"), F.col("__own").alias("__i"), other.alias("__j"))
    y = s.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], cols.alias("y"), F.col("__own").alias("__j"), other.alias("__i"))
    on = [*[f"__k{i}" for i in range(len(key))], "__i", "__j"]
    return x.join(y, on).where(F.col(f"x.{by}") < F.col(f"y.{by}")).select("x", "y")


def pairs_of(keys: DataFrame, part: int = PART) -> DataFrame:
    """keys: id, k. Distinct pairs a < b of rows that share a key; null keys meet nothing."""
    m = meetings(keys.select("id", "k").where("k is not null"), ["k"], "id", part)
    return m.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def pairs_once(keys: DataFrame, part: int = PART) -> DataFrame:
    """The pairs of :func:`pairs_of`, without a shuffle of the pairs: a pair comes from the least of
    the keys its rows share, as every row of a key carries the lesser keys of its id. For ids of
    few keys; the rows of a hot key meet in parts, each two parts once."""
    one = keys.where("id is not null and k is not null").groupBy("id").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    rows = one.select("id", "ks", F.posexplode("ks").alias("__at", "k")).select("id", "k", F.slice("ks", F.lit(1), F.col("__at")).alias("less"))
    s = parts_of(rows, ["k"], "id", part)
    x = s.select("k", F.col("id").alias("a"), F.col("less").alias("la"), F.col("__own").alias("i"), F.explode(F.sequence("__own", F.col("__n") - 1)).alias("j"))
    y = s.select("k", F.col("id").alias("b"), F.col("less").alias("lb"), F.explode(F.sequence(F.lit(0), "__own")).alias("i"), F.col("__own").alias("j"))
    first = (F.size("la") == 0) | (F.size("lb") == 0) | ~F.arrays_overlap("la", "lb")
    return x.join(y, ["k", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def block_sizes(keys: DataFrame) -> DataFrame:
    """blocks, largest, p50, p95, p99, pairs of blocks of two or more rows."""
    g = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return g.agg(F.count("*").alias("blocks"), F.max("n").alias("largest"), q.alias("q"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs")).select("blocks", "largest", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def static(df: DataFrame, id: str, fields: list[tuple[str, list[str]]]) -> DataFrame:
    return pairs_once(df.select(F.col(id).alias("id"), static_key(fields).alias("k")))


def multi_pass(df: DataFrame, id: str, passes: list[list[tuple[str, list[str]]]]) -> DataFrame:
    """Union of the passes; a pair found by several counts once."""
    keys = [df.select(F.col(id).alias("id"), F.concat(F.lit(f"{i}|"), static_key(p)).alias("k")) for i, p in enumerate(passes)]
    return pairs_once(reduce(DataFrame.unionByName, keys))


def adaptive(df: DataFrame, id: str, fields, sub_fields: list, max_block: int = 1000) -> DataFrame:
    """Blocks above ``max_block`` are split by the next sub-key, up to three levels."""
    key = static_key(fields)
    rows = df.select(F.col(id).alias("id"), key.alias("k"), *[F.coalesce(static_key([s]), F.lit("")).alias(f"s{i}") for i, s in enumerate(sub_fields)]).where("k is not null")
    for i in range(min(3, len(sub_fields))):
        n = rows.groupBy("k").agg(F.count("*").alias("n"))
        rows = rows.join(n, "k").withColumn("k", F.when(F.col("n") > max_block, F.concat_ws("||", "k", f"s{i}")).otherwise(F.col("k"))).drop("n")
    return pairs_of(rows.select("id", "k"))


def sorted_neighbourhood(df: DataFrame, id: str, key: Column, window: int = 5) -> DataFrame:
    """Rows at most ``window - 1`` apart in order of the key (then id). Null keys are left out.

    Positions come from range partitions; pairs meet by an equi-join on position + offset."""
    x = with_row_id(df.select(F.col(id).alias("id"), key.alias("k")).where("k is not null"), "k", "id").select("id", F.col(ID).alias("p"))
    y = x.select(F.col("id").alias("id2"), "p", F.explode(F.sequence(F.lit(1), F.lit(window - 1))).alias("o")).select("id2", (F.col("p") - F.col("o")).alias("p"))
    return x.join(y, "p").select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def token_keys(df: DataFrame, id: str, column: str, min_length: int = 3, max_df: int | None = None, ratio: float = 0.01, exact: bool = False) -> DataFrame:
    """id, k: distinct lower-case tokens; tokens of one row, or of more than max_df
    (default: 1 % of the rows, within 10 and 1000) rows, do not block. With ``exact``
    frequent tokens block too (their rows meet in parts), and no pair is lost."""
    t = df.select(F.col(id).alias("id"), F.explode(F.array_distinct(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= min_length))).alias("k"))
    if exact:
        return t
    freq = t.groupBy("k").agg(F.count("*").alias("df"))
    if max_df is None:
        cap = df.agg(F.least(F.greatest(F.floor(F.count("*") * ratio), F.lit(10)), F.lit(1000)).alias("cap"))
        freq = freq.crossJoin(F.broadcast(cap)).where("df between 2 and cap")
    else:
        freq = freq.where(f"df between 2 and {max_df}")
    return t.join(freq.select("k"), "k").select("id", "k")


def token(df: DataFrame, id: str, column: str, **kw) -> DataFrame:
    return pairs_of(token_keys(df, id, column, **kw))


def similar_texts(df: DataFrame, id: str, column: str, k: int = 5, num_perms: int = 64, threshold: float = 0.8, mode: str = "word") -> tuple[DataFrame, DataFrame]:
    """(copies, pairs): every id with the least id of its text as ``rep``, and the pairs a < b of
    such ids with the Jaccard similarity of their shingle sets, if it is at least the threshold.

    Texts are compared by their lower-case words; null texts and texts without a word are
    left out. Bands are chosen for recall at the threshold; what they bring together is then
    compared exactly, by the 64-bit hashes of all shingles. A band many texts share meets in parts."""
    words = F.array_join(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    x = df.select(F.col(id).alias("id"), (F.lower(column) if mode == "char" else words).alias("t")).where("t <> ''").withColumn("s", F.unhex(F.md5("t")))
    first = x.groupBy("s").agg(F.min("id").alias("rep"), F.first("t").alias("t"))
    b, _ = sketches.recall_bands(num_perms, threshold)
    kind = dict(x.dtypes)["id"]
    copies = cut(x.select("id", "s").join(x.groupBy("s").agg(F.min("id").alias("rep")), "s").select("id", "rep"))
    one = cut(first.select("rep", "t").mapInArrow(sketches.minhash_batches(k, mode, num_perms, b), f"rep {kind}, n int, hashes array<bigint>, keys array<bigint>"))
    keys = one.select("rep", "n", F.posexplode("keys").alias("i", "k"))
    # no pair is more similar than its sizes
    near = meetings(keys, ["i", "k"], "rep").where(F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= threshold).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    p, q = (one.select(F.col("rep").alias(y), F.col("hashes").alias(f"h{y}"), F.col("n").alias(f"n{y}")) for y in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    pairs = near.join(p, "a").join(q, "b").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))
    return copies, pairs.where(F.col("jaccard") >= threshold)


def minhash(df: DataFrame, id: str, column: str, k: int = 5, num_perms: int = 64, threshold: float = 0.8, mode: str = "word") -> DataFrame:
    """Pairs whose shingle sets have a Jaccard similarity of at least the threshold; texts
    without a shingle do not block. Copies of one text give all their pairs: :func:`minhash_links` stays linear."""
    copies, pairs = similar_texts(df, id, column, k, num_perms, threshold, mode)
    c, e = copies.select(F.col("id").alias("y"), F.col("rep").alias("b")), copies.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    across = pairs.join(e, "a").join(c, "b").select("x", "y")
    within = meetings(copies, ["rep"], "id").select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def minhash_links(df: DataFrame, id: str, column: str, k: int = 5, num_perms: int = 64, threshold: float = 0.8, mode: str = "word") -> DataFrame:
    """Pairs with the components of :func:`minhash`: copies of one text are joined to its least id only."""
    copies, pairs = similar_texts(df, id, column, k, num_perms, threshold, mode)
    return pairs.select("a", "b").unionByName(copies.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))


def simhash(df: DataFrame, id: str, column: str, dim: int, planes: int = 32, bands: int = 8) -> DataFrame:
    """Pairs that share a band of bits of their SimHash; zero vectors do not block."""
    nonzero = F.exists(column, lambda x: x != 0)
    h = df.where(nonzero).select(F.col(id).alias("id"), sketches.simhash_bits(F.col(column), planes, dim).alias("h"))
    r = planes // bands
    keys = F.array(*[F.struct(F.lit(i).alias("b"), F.shiftright("h", i * r).bitwiseAND(2**r - 1).alias("v")) for i in range(bands)])
    return pairs_of(h.select("id", F.explode(keys).alias("k")))


def perceptual(df: DataFrame, id: str, hex_column: str, bits: int = 64, bands: int = 8) -> DataFrame:
    """Pairs whose hex hashes share a band."""
    w = bits // bands // 4
    keys = F.array(*[F.concat(F.lit(f"{i}:"), F.substring(F.lower(hex_column), i * w + 1, w)) for i in range(bands)])
    return pairs_of(df.where(F.length(hex_column) == bits // 4).select(F.col(id).alias("id"), F.explode(keys).alias("k")))


def extrapolate_pairs(sample_pairs: float, sample_rows: int, rows: int) -> float:
    """Pairs of the whole from those of a sample, at most all there are."""
    return min(sample_pairs * (rows / sample_rows) ** 2, rows * (rows - 1) / 2) if sample_rows else 0.0
