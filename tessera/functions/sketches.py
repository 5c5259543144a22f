"""Sketches: MinHash and SimHash signatures, band keys, Bloom keys.

Shingles are hashed in the JVM; a permutation is one more 64-bit hash of the
shingle's hash with the permutation's number as seed, so a signature is a
projection of built-in expressions."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def shingles(c: Column, k: int = 5, mode: str = "word") -> Column:
    """Distinct shingles of k words (or characters); a shorter text is one shingle, an empty one has none."""
    if mode == "char":
        s = F.lower(c)
        return F.array_distinct(F.when(F.length(s) < k, F.filter(F.array(s), lambda x: x != "")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: s.substr(i, F.lit(k)))))

    def of(w):
        n = F.size(w)
        return F.array_distinct(F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))

    return F.transform(F.array(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")), of)[0]


def minhash(sh: Column, num_perms: int = 64) -> Column:
    """array<bigint> of the least hash per permutation; null for an empty set."""
    # the one-element array binds the hashes to a name: they are computed once, not once a permutation
    sig = F.transform(F.array(F.transform(sh, lambda x: F.xxhash64(x))), lambda h: F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.lit(num_perms - 1)), lambda i: F.array_min(F.transform(h, lambda x: F.xxhash64(x, i))))))
    return sig[0]


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, k: int, mode: str, words: dict[str, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text of words parted by blanks (or of
    characters); a shorter text is one shingle. ``words`` keeps the hashes of words."""
    if mode == "char":
        u = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    else:
        found = []
        for w in text.split(" "):
            h = words.get(w)
            if h is None:
                h = words[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            found.append(h)
        u = np.array(found, np.uint64)
    n = max(1, len(u) - k + 1)
    h = np.full(n, np.uint64(min(len(u), k)), np.uint64)
    for i in range(min(k, len(u))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + u[i : i + n])
    return np.unique(h)


def minhash_batches(k: int, mode: str, num_perms: int, num_bands: int, seed: int = 7, chunk: int = 8192, remember: int = 200_000):
    """Arrow batches (rep, t) to (rep, n, hashes, keys): the distinct shingle hashes and the
    band keys of their MinHash signature, whole columns of numbers at a time."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, num_perms, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, num_perms, dtype=np.int64).astype(np.uint64)
    rows = num_perms // num_bands

    def run(batches):
        import pyarrow as pa

        words: dict[str, int] = {}
        for batch in batches:
            hashes, keys = [], []
            with np.errstate(over="ignore"):
                for t in batch.column(1).to_pylist():
                    if len(words) > remember:
                        words.clear()
                    h = shingle_hashes(t, k, mode, words)
                    sig = np.full(num_perms, _MASK)
                    for i in range(0, len(h), chunk):
                        sig = np.minimum(sig, (h[i : i + chunk, None] * a + b).min(axis=0))
                    key = np.arange(num_bands, dtype=np.uint64)
                    for r in range(rows):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[r::rows])
                    hashes.append(h.view(np.int64))
                    keys.append(key.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
            flat = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
            kflat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            kends = (np.arange(len(keys) + 1) * num_bands).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(h) for h in hashes], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(kends), pa.array(kflat))], ["rep", "n", "hashes", "keys"]
            )

    return run


def bands(signature: Column, num_bands: int, num_perms: int) -> Column:
    r = num_perms // num_bands
    return F.array(*[F.xxhash64(F.lit(b), F.slice(signature, b * r + 1, r)) for b in range(num_bands)])


def optimal_bands(num_perms: int, threshold: float, steps: int = 1000) -> tuple[int, int]:
    """(bands, rows): the divisor of num_perms with the least mean of false positive
    and false negative area under the S-curve; ties keep fewer bands."""
    t = (np.arange(steps) + 0.5) / steps
    best = None
    for b in (b for b in range(1, num_perms + 1) if num_perms % b == 0):
        p = 1 - (1 - t ** (num_perms // b)) ** b
        cost = 0.5 * p[t < threshold].sum() + 0.5 * (1 - p[t >= threshold]).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, b)
    return best[1], num_perms // best[1]


def recall_bands(num_perms: int, threshold: float, recall: float = 0.99) -> tuple[int, int]:
    """(bands, rows): the fewest bands under which a pair at the threshold meets with the given probability."""
    for b in (b for b in range(1, num_perms + 1) if num_perms % b == 0):
        if 1 - (1 - threshold ** (num_perms // b)) ** b >= recall:
            return b, num_perms // b
    return num_perms, 1


def estimate_jaccard(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def simhash_bits(v: Column, planes: int = 32, dim: int = 64, seed: int = 42) -> Column:
    """bigint whose bit i is the sign of the vector's product with seeded plane i."""
    m = np.random.default_rng(seed).standard_normal((planes, dim))
    bit = lambda row: (F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in row]), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, x: s + x) >= 0).cast("long")
    out = F.lit(0).cast("long")
    for i in range(planes):
        out = out.bitwiseOR(F.shiftleft(bit(m[i]), i))
    return out
