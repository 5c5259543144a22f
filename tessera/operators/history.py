"""Attribute history from snapshots by tree-reduction coalescing.

Every snapshot is a unit interval. Rows are range-partitioned by (entity, time,
id), so a hot entity spreads over several partitions; each partition merges its
neighbouring intervals of equal content (the leaves of the tree), and the
boundary runs of neighbouring partitions then merge pairwise over a logarithmic
number of rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, parallelism

RUNS = "block long, seq long, entity long, content string, id_from long, t_from timestamp, id_to long, t_to timestamp, edge string"


def json_content(col):
    """Digest of a flat JSON object: same keys and values give the same digest,
    whatever the order, spacing or escapes; a null value equals an absent key.
    Text that is not an object counts as itself, null as null."""
    m = F.map_filter(F.from_json(col, "map<string,string>"), lambda _, v: v.isNotNull())
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"), e["value"].alias("v"))))))
    ok = F.try_parse_json(col).isNotNull() & col.rlike(r"^\s*\{")
    return F.when(col.isNull(), F.lit("null")).when(ok, F.md5(F.concat_ws(",", entries))).otherwise(F.md5(F.concat(F.lit("raw:"), col)))


def leaf_runs(batches):
    """Coalesce one range partition (sorted by entity, time, id) into runs.

    Interior runs leave finished; the first and last run stay open at that side
    (edge 'h', 't' or 'ht') because a neighbouring partition may continue them."""
    block, seq, held = TaskContext.get().partitionId(), 0, None
    for pdf in batches:
        if not len(pdf):
            continue
        rows = pdf[["entity", "content", "id", "t"]]
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True)
        runs = rows[(rows.entity != rows.entity.shift()) | (rows.content != rows.content.shift())]
        if len(runs) > 1:
            yield _runs(runs, block, seq)
            seq += len(runs) - 1
        held = runs.iloc[-1:]
    if held is not None:
        yield _runs(pd.concat([held, held]), block, seq, last=True)


def _runs(runs: pd.DataFrame, block: int, seq: int, last: bool = False) -> pd.DataFrame:
    """All runs but the last, each ended by the next one; run 0 of a block is open at its head, the ``last`` at its tail."""
    a, b = runs.iloc[:-1], runs.iloc[1:]
    ends = (a.entity.to_numpy() == b.entity.to_numpy()) & (not last)
    n = np.arange(seq, seq + len(a))
    edge = np.where(n == 0, "h", "").astype(object) + ("t" if last else "")
    return pd.DataFrame(
        {"block": block, "seq": n, "entity": a.entity.to_numpy(), "content": a.content.to_numpy(), "id_from": a.id.to_numpy(), "t_from": a.t.to_numpy(), "id_to": np.where(ends, b.id.to_numpy(), -1), "t_to": b.t.where(ends).to_numpy(), "edge": edge}
    )


def _frame(rows):
    f = pd.DataFrame(rows, columns=["block", "seq", "entity", "content", "id_from", "t_from", "id_to", "t_to", "edge"])
    f["t_to"] = pd.to_datetime(f.t_to)
    return f


def join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge the boundary runs of two neighbouring blocks into those of one."""
    blocks = [list(b.sort_values("seq").to_dict("records")) for _, b in pdf[pdf.edge != ""].groupby("block", sort=True)]
    done = pdf[pdf.edge == ""].to_dict("records")
    block = int(pdf.block.iloc[0]) // 2
    if len(blocks) == 2:
        left, right = blocks
        a, b = left[-1], right[0]
        if (a["entity"], a["content"]) == (b["entity"], b["content"]):
            a = a | {"id_to": b["id_to"], "t_to": b["t_to"], "edge": ("h" if "h" in a["edge"] else "") + ("t" if "t" in b["edge"] else "")}
            rows = [*left[:-1], a, *right[1:]]
        else:
            if a["entity"] == b["entity"]:
                a = a | {"id_to": b["id_from"], "t_to": b["t_from"]}
            rows = [*left[:-1], a | {"edge": a["edge"].replace("t", "")}, b | {"edge": b["edge"].replace("h", "")}, *right[1:]]
    else:
        rows = blocks[0] if blocks else []
    out = [*done, *(r | {"seq": i} for i, r in enumerate(rows))]
    return _frame([r | {"block": block, "t_to": None if pd.isna(r["t_to"]) else r["t_to"]} for r in out])


def coalesce_history(snapshots: DataFrame, partitions: int | None = None) -> DataFrame:
    """Periods of constant content: entity, content, id_from, t_from, id_to, t_to.

    snapshots: entity long, t timestamp, id long, content string. Rows are taken
    in order of t, then id; rows with a null entity or t are left out and a
    repeated id counts once. ``id_to`` is -1 and ``t_to`` null for the open
    period. A content that returns opens a new period. Extra columns are ignored."""
    spark = snapshots.sparkSession
    n = partitions or parallelism(spark)
    rows = snapshots.select("entity", "t", "id", F.coalesce("content", F.lit("null")).alias("content")).where("entity is not null and t is not null").dropDuplicates(["id"])
    ordered = rows.repartitionByRange(n, "entity", "t", "id").sortWithinPartitions("entity", "t", "id")
    # range bounds are sampled: cut here, so that a recomputed task sees the same blocks
    runs = cut(ordered.mapInPandas(leaf_runs, RUNS))
    inner, edge = runs.where("edge = ''"), runs.where("edge <> ''")
    for _ in range(math.ceil(math.log2(max(n, 2)))):
        edge = edge.groupBy(F.floor(F.col("block") / 2).alias("pair")).applyInPandas(join_blocks, RUNS)
    return inner.unionByName(edge).select("entity", "content", "id_from", "t_from", "id_to", "t_to")
