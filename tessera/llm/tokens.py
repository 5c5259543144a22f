"""Encoding of a whole corpus with a byte-level BPE vocabulary.

Method: corpus-level merge replay. Texts are cut into words by the vocabulary's
pattern, once; a text becomes a list of references to the words of its slice (a
bounded run of texts). The *distinct* words of the whole corpus are then merged,
each once: they are laid out in one symbol array with an inverted index from token
pair to positions, merges are applied in rank order, each to all its positions at
once, and only the touched neighbours are entered again. Words do not touch each
other, so the words are replayed in ranges of WORDS each. The ids of a word go
back to the slices that hold it, where a text's references become its ids.

Words are few next to the text (one row a slice that holds them, however often they
occur there), and texts travel as references only.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The published word pattern of the byte_bpe vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in a slice (one longer text is a slice of its own), and distinct words in a replay.
SLICE, WORDS = 4_000_000, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


class Replay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}  # known pairs, -1 if they don't merge

    def rank(self, a: int, b: int) -> int:
        r = self.pair.get((a, b))
        if r is None:
            r = self.pair[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def encode(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        sym: list[int] = []
        starts = [0]
        byte, rank = self.byte, self.rank
        for w in words:
            sym += [byte[b] for b in w.encode("utf-8", "replace")]
            starts.append(len(sym))
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            if s < n:
                prv[s] = -1
            if s:
                nxt[s - 1] = -1
        index: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            j = nxt[i]
            if j >= 0:
                index.setdefault((sym[i], sym[j]), []).append(i)
        heap = [(r, p) for p in index if (r := rank(*p)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, pair = heapq.heappop(heap)
            at = index.pop(pair, None)
            if at is None:
                continue
            at.sort()  # overlapping occurrences merge from the left
            a, b = pair
            for i in at:
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                sym[i], k, h = r, nxt[j], prv[i]
                sym[j], nxt[i] = -1, k
                if k >= 0:
                    prv[k] = i
                    self._enter(index, heap, (r, sym[k]), i)
                if h >= 0:
                    self._enter(index, heap, (sym[h], r), h)
        out = []
        for s, e in zip(starts, starts[1:]):
            ids, i = [], s if s < e else -1
            while i >= 0:
                ids.append(sym[i])
                i = nxt[i]
            out.append(ids)
        return out

    def _enter(self, index, heap, pair, at):
        known = index.get(pair)
        if known is not None:
            known.append(at)
            return
        if (r := self.rank(*pair)) >= 0:
            index[pair] = [at]
            heapq.heappush(heap, (r, pair))


def _slices(pattern: str, kept: int, size: int):
    """Texts to references: rows with refs (a text) and rows with word, at (a word of the slice)."""
    words_of = regex.compile(pattern)

    def flush(slice_, head, refs, words, schema):
        n, w = len(refs), len(words)
        flat = np.concatenate(refs) if n else np.empty(0, np.int32)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in refs]), np.full(w, len(flat))]).astype(np.int32)
        text = pa.array([True] * n + [False] * w)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array([False] * n + [True] * w))
        cols = [pa.array([slice_] * (n + w), pa.string()), lists, pa.array([None] * n + list(words), pa.string()), pa.array([None] * n + list(range(w)), pa.int32())]
        for i in range(kept):
            cols.append(pa.concat_arrays([*(h[i] for h in head), pa.nulls(w, head[0][i].type)]))
        return pa.RecordBatch.from_arrays([text, *cols], names=schema)

    def run(batches):
        names = ["text", "slice", "refs", "word", "at", *(f"k{i}" for i in range(kept))]
        head, refs, words, held = [], [], {}, 0
        for b in batches:
            texts, lo = b.column(0).to_pylist(), 0
            for i, t in enumerate(texts):
                refs.append(np.array([words.setdefault(w, len(words)) for w in words_of.findall(t)], np.int32) if t else np.empty(0, np.int32))
                held += len(t) if t else 0
                if held >= size or i == len(texts) - 1:
                    head.append([b.column(1 + k).slice(lo, i + 1 - lo) for k in range(kept)])
                    lo = i + 1
                if held >= size:
                    yield flush(uuid.uuid4().hex, head, refs, words, names)
                    head, refs, words, held = [], [], {}, 0
        if refs:
            yield flush(uuid.uuid4().hex, head, refs, words, names)

    return run


def _replayed(ranks):
    """One replay over all words of the partition."""

    def run(batches):
        words = [w for b in batches for w in b.column(0).to_pylist()]
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(Replay(ranks.value).encode(words), pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _restored(kept: int, lengths_only: bool):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        docs, words = docs.combine_chunks(), words.combine_chunks()
        refs = docs.column("refs").combine_chunks()
        flat, ends = refs.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(refs.value_lengths().to_numpy())])
        at = words.column("at").to_numpy()
        n = np.zeros(len(at), np.int64)
        n[at] = words.column("n").to_numpy()
        sizes = n[flat] if len(flat) else np.empty(0, np.int64)
        run_ = np.concatenate([[0], np.cumsum(sizes)])
        cut_ = run_[ends]
        if lengths_only:
            out = pa.array(np.diff(cut_), pa.int64())
        else:
            ids = words.column("ids").combine_chunks()
            first = np.zeros(len(at), np.int64)
            first[at] = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])[:-1]
            where = np.repeat(first[flat] - run_[:-1], sizes) + np.arange(run_[-1]) if len(flat) else np.empty(0, np.int64)
            tokens = ids.flatten().to_numpy()[where] if len(where) else np.empty(0, np.int32)
            out = pa.ListArray.from_arrays(pa.array(cut_.astype(np.int32)), pa.array(tokens, pa.int32()))
        return pa.table([*(docs.column(f"k{i}") for i in range(kept)), out], names=[*(f"k{i}" for i in range(kept)), "out"])

    return run


def _apply(docs: DataFrame, id: str, text: str, keep: list[str], path: str, pattern: str, lengths: bool, name: str) -> DataFrame:
    spark, kept = docs.sparkSession, 1 + len(keep)
    ranks = spark.sparkContext.broadcast(read_ranks(path))  # the vocabulary: fixed, under 1 MB of file
    src = docs.select(F.col(text).cast("string").alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate([id, *keep])])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "t")
    rows = cut(src.mapInArrow(_slices(pattern, kept, SLICE), "text boolean, slice string, refs array<int>, word string, at int, " + fields))
    here = rows.where("not text").select(F.col("slice").alias("held_by"), "at", "word")
    words = cut(here.select("word").distinct())
    n = max(1, math.ceil(words.count() / WORDS))
    ids = cut(words.repartition(n, "word").mapInArrow(_replayed(ranks), "word string, ids array<int>"), words)
    back = here.join(ids, "word").select("held_by", "at", F.size("ids").cast("long").alias("n"), *([] if lengths else ["ids"]))
    texts = rows.where("text").select("slice", "refs", *[f"k{i}" for i in range(kept)])
    out = texts.groupBy("slice").cogroup(back.groupBy("held_by")).applyInArrow(_restored(kept, lengths), fields + ", out " + ("long" if lengths else "array<int>"))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate([id, *keep])], F.col("out").alias(name))


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """id and ``ids``, the token ids of the whole text. Null and empty texts give
    an empty list; blank texts are encoded as they are; strings that look like
    special tokens are ordinary text. Extra columns are dropped."""
    return _apply(docs, id, text, [], vocabulary or VOCABULARY, pattern, False, "ids")


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """id, the columns in ``keep`` and ``tokens``, the number of tokens (0 for null and empty texts)."""
    return _apply(docs, id, text, list(keep), vocabulary or VOCABULARY, pattern, True, "tokens")
