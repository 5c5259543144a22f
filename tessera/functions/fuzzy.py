"""Ratios on a scale of 0 to 100, encoded keys for private linkage, phonetic keys."""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType

from tessera.functions.scorers import indel_py


def ratio(a: str, b: str) -> float:
    return 100 * indel_py(a, b)


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of its length in the longer."""
    s, t = sorted((a, b), key=len)
    if not s:
        return 100.0 if not t else 0.0
    n = len(s)
    spans = [t[max(0, i) : i + n] for i in range(1 - n, len(t))]
    return max(ratio(s, x) for x in spans if x)


def _words(s: str) -> list[str]:
    return sorted(s.split())


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(_words(a)), " ".join(_words(b)))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(d))])) for d in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 100.0
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_token_sort_ratio(a: str, b: str) -> float:
    return partial_ratio(" ".join(_words(a)), " ".join(_words(b)))


def partial_token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return 100.0 if x & y else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))) if x and y else 0.0


def q_ratio(a: str, b: str) -> float:
    clean = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    a, b = clean(a), clean(b)
    return ratio(a, b) if a and b else 0.0


def w_ratio(a: str, b: str) -> float:
    """The best of several ratios, weighted by how different the lengths are."""
    if not a or not b:
        return 0.0
    r = max(len(a), len(b)) / min(len(a), len(b))
    if r < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    k = 0.9 if r < 8 else 0.6
    return max(ratio(a, b), k * partial_ratio(a, b), 0.95 * k * max(partial_token_sort_ratio(a, b), partial_token_set_ratio(a, b)))


RATIOS = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, token_ratio, partial_token_sort_ratio, partial_token_set_ratio, q_ratio, w_ratio)}


def fuzz(name: str, a: Column, b: Column) -> Column:
    """A ratio by name; null where either side is null."""
    f = RATIOS[name]

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, DoubleType())(a, b)


#: n-gram, hashes, bits, keyed, balanced.
CLK_PRESETS = {"default": (2, 20, 1024, False, False), "standard": (2, 20, 512, False, False), "high": (2, 30, 1024, True, False), "paranoid": (3, 40, 2048, True, True)}


def clk_py(values: list[str | None], preset: str = "default", key: bytes = b"") -> bytes | None:
    """Bloom filter of the n-grams of the values (double hashing of a digest)."""
    n, hashes, bits, keyed, balanced = CLK_PRESETS[preset]
    if keyed and not key:
        raise ValueError(f"preset {preset!r} needs a key")
    half = bits // 2 if balanced else bits
    grams = {f"{i}:{s[j : j + n]}" for i, v in enumerate(values) if v for s in ["_" * (n - 1) + v.lower().strip() + "_" * (n - 1)] for j in range(len(s) - n + 1)}
    if not grams:
        return None
    out = 0
    for g in grams:
        d = hmac.new(key, g.encode(), hashlib.sha256).digest() if keyed else hashlib.sha256(g.encode()).digest()
        a, b = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:16], "big") | 1
        for k in range(hashes):
            out |= 1 << ((a + k * b) % half)
    if balanced:
        out |= (~out & ((1 << half) - 1)) << half
    return out.to_bytes(bits // 8, "little")


def clk(columns: list[str], preset: str = "default", key: bytes = b"") -> Column:
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([clk_py(list(v), preset, key) for v in zip(*cols)], dtype=object)

    return F.pandas_udf(run, BinaryType())(*[F.col(c).cast("string") for c in columns])


def clk_dice(a: Column, b: Column) -> Column:
    """Dice similarity of two filters, in the JVM: bits counted over 8-byte words."""
    words = lambda c: F.transform(F.sequence(F.lit(0), (F.length(F.hex(c)) / 16 - 1).cast("int")), lambda i: F.conv(F.substr(F.hex(c), i * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    ones = lambda w: F.aggregate(w, F.lit(0), lambda s, x: s + F.bit_count(x))
    both = F.aggregate(F.zip_with(words(a), words(b), lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(2.0 * both, ones(words(a)) + ones(words(b))), F.lit(0.0))


def nysiis_py(s: str) -> str:
    """New York State phonetic key (at most 6 letters)."""
    w = re.sub("[^A-Z]", "", s.upper())
    if not w:
        return ""
    for a, b in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(a):
            w = b + w[len(a) :]
            break
    for ends, b in ((("EE", "IE"), "Y"), (("DT", "RT", "RD", "NT", "ND"), "D")):
        if w.endswith(ends):
            w = w[:-2] + b
            break
    key, body, i = w[0], w, 1
    while i < len(body):
        rest = body[i:]
        if rest.startswith("EV"):
            new = "AF"
        elif rest[0] in "AEIOU":
            new = "A"
        elif rest.startswith("SCH"):
            new = "SSS"
        elif rest.startswith("PH"):
            new = "FF"
        elif rest.startswith("KN"):
            new = "NN"
        else:
            new = {"Q": "G", "Z": "S", "M": "N", "K": "C"}.get(rest[0], rest[0])
        if new == "H" and (body[i - 1] not in "AEIOU" or (len(rest) > 1 and rest[1] not in "AEIOU")):
            new = body[i - 1]
        if new == "W" and body[i - 1] in "AEIOU":
            new = body[i - 1]
        body = body[:i] + new + body[i + len(new) :]
        if key[-1] != body[i]:
            key += body[i]
        i += 1
    if len(key) > 1 and key.endswith("S"):
        key = key[:-1]
    if key.endswith("AY"):
        key = key[:-2] + "Y"
    if len(key) > 1 and key.endswith("A"):
        key = key[:-1]
    return key[:6]


def nysiis(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        known = {v: nysiis_py(v) for v in s.dropna().unique()}
        return pd.Series([known.get(v) for v in s], dtype=object)

    return F.pandas_udf(run, StringType())(c)
