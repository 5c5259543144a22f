"""Queries of the general training-data operators (problems 3, 5 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import history, references
from tessera.session import table
from tessera.streaming.changefeed import ChangeFeed, parse_position


def _broken(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "identity_nodes")
    refs = (
        references.references(table(spark, d, "source_records"), "source_records", "entity_id", "record_id", "first_seen_at")
        .unionByName(references.references(table(spark, d, "evidence_edges"), "evidence_edges", "entity_id", "edge_id", "recorded_at"))
        .unionByName(references.references(nodes, "identity_nodes", "merged_into", "entity_id", "updated_at"))
    )
    return references.broken_references(refs, references.parent_index(nodes, "entity_id", "status", "created_at"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("table_name", "row_key", "state").distinct()


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    return references.misses_by_period(_broken(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "source_records").select("source", "row_id", "last_seen_at")
    return ChangeFeed(spark).run(table(spark, d, "gm_state"), log).select("row_id").distinct()


def p5_offsets(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.changefeed import offsets

    return offsets(table(spark, d, "gm_state"))


def _periods(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gm_golden_records")
    return history.coalesce_history(g.select(F.col("cluster_id").alias("entity"), F.col("merged_at").alias("t"), "id", history.json_content(F.col("record_data")).alias("content")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d).select(F.col("entity").alias("cluster_id"), "id_from", "id_to")


def p6_history(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d).select(F.col("entity").alias("cluster_id"), F.col("t_from").alias("valid_from"), F.col("t_to").alias("valid_to"), "id_from", (F.col("id_to") == -1).alias("is_current"))


QUERIES = {"p3_found": p3_found, "p3_periods": p3_periods, "p5_found": p5_found, "p5_offsets": p5_offsets, "p6_found": p6_found, "p6_history": p6_history}

_REFS = """with nodes as (select lower(trim(entity_id, E' \\t\\n\\r')) k, bool_and(coalesce(lower(trim(status)) = 'retired', false)) gone, min(created_at) born from identity_nodes group by 1),
refs as (
  select distinct 'source_records' table_name, record_id row_key, lower(trim(entity_id, E' \\t\\n\\r')) k, first_seen_at t from source_records
  union all select distinct 'evidence_edges', edge_id::varchar, lower(trim(entity_id, E' \\t\\n\\r')), recorded_at from evidence_edges
  union all select distinct 'identity_nodes', entity_id, lower(trim(merged_into, E' \\t\\n\\r')), updated_at from identity_nodes),
broken as (
  select table_name, row_key, t, case when n.k is null then 'missing' when gone then 'deleted' when born > t then 'late' end state
  from refs r left join nodes n on r.k = n.k where r.k is not null and r.k <> '')
"""
_OFFSETS = """with pos as (
  select *, case when regexp_matches(trim(last_incremental_value), '^[0-9]{9,16}$') then
      make_timestamp(cast(case when length(trim(last_incremental_value)) <= 11 then trim(last_incremental_value)::bigint * 1000000 when length(trim(last_incremental_value)) <= 14 then trim(last_incremental_value)::bigint * 1000 else trim(last_incremental_value)::bigint end as bigint))
    when regexp_matches(trim(last_incremental_value), '(Z|z|[+-][0-9]{2}:?[0-9]{2})$') and length(trim(last_incremental_value)) > 10 then timezone('UTC', cast(trim(last_incremental_value) as timestamptz))
    else cast(trim(last_incremental_value) as timestamp) end tp
  from gm_state where last_processed_at is not null),
offs as (select source_table part, arg_max(last_row_id, (last_processed_at, id)) filter (where last_row_id is not null) row_pos, arg_max(tp, (last_processed_at, id)) filter (where tp is not null) time_pos from pos group by 1)
"""
_RUNS = """with g as (select distinct id, cluster_id, merged_at, record_data from gm_golden_records where merged_at is not null and cluster_id is not null),
c as (select id, cluster_id, merged_at, (select list_sort(list(k || '=' || json_extract_string(record_data, '$."' || k || '"')) filter (where json_extract_string(record_data, '$."' || k || '"') is not null)) from (select unnest(json_keys(record_data)) k)) content from g),
o as (select *, row_number() over w rn, lag(content) over w prev from c window w as (partition by cluster_id order by merged_at, id)),
runs as (select cluster_id, id, merged_at from o where rn = 1 or content is distinct from prev),
per as (select cluster_id, id id_from, merged_at valid_from, coalesce(lead(id) over w, -1) id_to, lead(merged_at) over w valid_to from runs window w as (partition by cluster_id order by merged_at, id))
"""
SQL = {
    "p3_found": _REFS + "select distinct table_name, row_key, state from broken where state is not null",
    "p3_periods": _REFS + "select table_name, date_trunc('month', t) as period, state, count(*) misses from broken where state is not null group by 1, 2, 3",
    "p5_found": _OFFSETS + "select distinct row_id from source_records r left join offs o on r.source = o.part where (row_pos is null and time_pos is null) or row_id > row_pos or timezone('UTC', last_seen_at) > time_pos",
    "p5_offsets": _OFFSETS + "select part, row_pos, timezone('UTC', time_pos) time_pos from offs",
    "p6_found": _RUNS + "select cluster_id, id_from, id_to from per",
    "p6_history": _RUNS + "select cluster_id, valid_from, valid_to, id_from, id_to = -1 as is_current from per",
}
