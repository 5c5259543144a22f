"""Comparators: two columns in, a similarity in [0, 1] out.

A null on either side scores 0.0, never equal to another null. Most are built-in
expressions; Jaro-Winkler, token sort and Damerau have no built-in, so they are
Arrow-batched functions that score each distinct pair of a batch once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.transforms import soundex

SCORERS: dict[str, Callable[..., Column]] = {}


def scorer(f):
    SCORERS[f.__name__] = f
    return f


def _both(a: Column, b: Column, s: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), s.cast("double")).otherwise(F.lit(0.0))


@scorer
def exact(a, b):
    return _both(a, b, F.when(a == b, 1.0).otherwise(0.0))


@scorer
def levenshtein(a, b):
    n = F.greatest(F.length(a), F.length(b))
    return _both(a, b, F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n))


def tokens(c):
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def _overlap(x, y, dice_: bool):
    n = F.size(F.array_intersect(x, y))
    m = F.size(x) + F.size(y)
    return F.when(m == 0, 1.0).otherwise(2 * n / m if dice_ else n / (m - n))


@scorer
def jaccard(a, b):
    return _both(a, b, _overlap(tokens(a), tokens(b), False))


@scorer
def dice(a, b):
    return _both(a, b, _overlap(tokens(a), tokens(b), True))


def qgrams(c, q: int = 3):
    s = F.lower(c)
    return F.array_distinct(F.when(F.length(s) < q, F.filter(F.array(s), lambda x: x != "")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - q + 1), lambda i: s.substr(i, F.lit(q)))))


@scorer
def qgram(a, b, q: int = 3):
    return _both(a, b, _overlap(qgrams(a, q), qgrams(b, q), False))


@scorer
def array_intersect(a, b, sep: str = r"[|;,]"):
    t = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.lower(c), sep), lambda x: F.trim(x)), lambda x: x != ""))
    return _both(a, b, _overlap(t(a), t(b), False))


@scorer
def soundex_match(a, b):
    return _both(a, b, F.when((soundex(a) == soundex(b)) & (soundex(a) != ""), 1.0).otherwise(0.0))


@scorer
def numeric_diff(a, b, mode: str = "abs", band: float = 1.0):
    """1 at equality, falling linearly to 0 at ``band`` (absolute, or a share of the larger value)."""
    x, y = a.try_cast("double"), b.try_cast("double")
    d = F.abs(x - y)
    if mode == "pct":
        d = F.coalesce(F.try_divide(d, F.greatest(F.abs(x), F.abs(y))), F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - d / band), F.lit(0.0))


@scorer
def date_diff(a, b):
    """Bands of days: 0 -> 1, 1 -> .92, 31 -> .8, 366 -> .6, 1827 -> .3; day and month swapped at least .8."""
    x, y = a.try_cast("date"), b.try_cast("date")
    d = F.abs(F.datediff(x, y))
    s = F.when(d == 0, 1.0).when(d <= 1, 0.92).when(d <= 31, 0.8).when(d <= 366, 0.6).when(d <= 1827, 0.3).otherwise(0.0)
    swapped = (F.year(x) == F.year(y)) & (F.month(x) == F.dayofmonth(y)) & (F.dayofmonth(x) == F.month(y))
    return F.coalesce(F.when(swapped, F.greatest(s, F.lit(0.8))).otherwise(s), F.lit(0.0))


@scorer
def geo_haversine(a, b):
    """"lat,lng" strings; within .1 km -> 1, 1 -> .85, 10 -> .5, 100 -> .2."""
    part = lambda c, i: F.radians(F.trim(F.element_at(F.split(c, ","), i)).try_cast("double"))
    la, oa, lb, ob = part(a, 1), part(a, 2), part(b, 1), part(b, 2)
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((ob - oa) / 2), 2)
    km = 2 * 6371.0088 * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
    return F.coalesce(F.when(km <= 0.1, 1.0).when(km <= 1, 0.85).when(km <= 10, 0.5).when(km <= 100, 0.2).when(km.isNotNull(), 0.0), F.lit(0.0))


@scorer
def cosine(a, b):
    """Numeric arrays; a zero vector scores 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


@scorer
def hamming(a, b, bits: int = 64):
    """Share of equal bits of two 64-bit hashes."""
    return _both(a, b, 1 - F.bit_count(a.bitwiseXOR(b)) / bits)


def jaro_winkler_py(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(len(a), len(b)) // 2 - 1
    taken, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                first.append(ch)
                break
    if not first:
        return 0.0
    m = len(first)
    second = [ch for ch, t in zip(b, taken) if t]
    t = sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u | s - u) & full
    return bin(~s & full).count("1") if a else 0


def indel_py(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 1.0 if n == 0 else 2 * _lcs(a, b) / n


def token_sort_py(a: str, b: str) -> float:
    return indel_py(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def damerau_py(a: str, b: str) -> float:
    """Optimal string alignment (adjacent transpositions) as a similarity."""
    if not a and not b:
        return 1.0
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return 1 - one[-1] / max(len(a), len(b))


def _vectorised(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(0.0)
                continue
            s = known.get((x, y))
            if s is None:
                s = known[x, y] = f(x, y)
            out.append(s)
        return pd.Series(out, dtype="float64")

    return run


def _arrow(f):
    made = []

    def build(a, b):
        if not made:
            made.append(F.pandas_udf(_vectorised(f), DoubleType()))
        return made[0](a, b)

    return build


SCORERS["jaro_winkler"] = jaro_winkler = _arrow(jaro_winkler_py)
SCORERS["token_sort"] = token_sort = _arrow(token_sort_py)
SCORERS["damerau"] = damerau = _arrow(damerau_py)
SCORERS["indel"] = indel = _arrow(indel_py)


@scorer
def ensemble(a, b):
    """The best of Jaro-Winkler, token sort and 0.8 x equal Soundex."""
    return F.greatest(jaro_winkler(a, b), token_sort(a, b), 0.8 * soundex_match(a, b))


@scorer
def given_name_aliased_jw(a, b):
    from tessera.functions.transforms import nickname_standardize

    same = F.lower(nickname_standardize(a)) == F.lower(nickname_standardize(b))
    return F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(jaro_winkler(a, b))


@scorer
def initialism_match(a, b):
    from tessera.functions.transforms import derive_initialism

    up = lambda c: F.upper(F.regexp_replace(c, r"[.\s]", ""))
    return _both(a, b, F.when((up(a) == derive_initialism(b)) | (up(b) == derive_initialism(a)), 1.0).otherwise(0.0))


def score(name: str, a: Column, b: Column) -> Column:
    """By name; ``numeric_diff:pct:0.1`` and ``qgram:2`` take arguments."""
    head, *args = name.split(":")
    if head not in SCORERS:
        raise NotImplementedError(f"unknown scorer {head!r}")
    conv = {"qgram": [int], "numeric_diff": [str, float], "hamming": [int]}.get(head, [])
    return SCORERS[head](a, b, *[f(x) for f, x in zip(conv, args)])


def weighted(fields: list[tuple[str, str, float]], left: str = "a", right: str = "b") -> Column:
    """Matchkey score: sum of weight x score over the weights of the fields that
    are known on both sides. fields: (column, scorer, weight)."""
    num = den = F.lit(0.0)
    for col, name, w in fields:
        x, y = F.col(f"{left}.{col}"), F.col(f"{right}.{col}")
        seen = x.isNotNull() & y.isNotNull()
        num = num + F.when(seen, w * score(name, x, y)).otherwise(0.0)
        den = den + F.when(seen, F.lit(w)).otherwise(0.0)
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))
