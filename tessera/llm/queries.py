"""Queries of the operators in this package, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import batches, groups, linkage, lookalikes, mixture, survivors, tokens
from tessera.session import table


def _intake(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_records").where("dataset = 'party_intake'")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.matched_pairs(_intake(spark, d))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return linkage.matched_pairs(_intake(spark, d), confidence=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return batches.turned_away(_intake(spark, d)).select("row_id")


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    away = batches.turned_away(_intake(spark, d))
    return away.groupBy("source", F.to_date("first_seen_at").alias("batch")).agg(F.count("*").alias("turned_away"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    links = groups.record_links(table(spark, d, "source_records"), table(spark, d, "evidence_edges"), table(spark, d, "gm_match_log"))
    return groups.connected_groups(links).select(F.col("vertex").alias("row_id"), F.col("group").alias("group_row_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    best, _ = survivors.resolve(table(spark, d, "gm_golden_records"), table(spark, d, "source_records"))
    return best.select("cluster_id", "row_id")


def p7_fused(spark: SparkSession, d: str) -> DataFrame:
    _, fused = survivors.resolve(table(spark, d, "gm_golden_records"), table(spark, d, "source_records"))
    return fused


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_pairs(table(spark, d, "documents"))


def p10_common(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", lookalikes.common_form_of("text").alias("common"))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_batches": p2_batches, "p4_found": p4_found, "p7_found": p7_found, "p7_fused": p7_fused, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_common": p10_common}
SQL = {
    "p4_found": """with recursive r as (select distinct row_id, record_id from source_records),
l0 as (select a.row_id u, b.row_id v from evidence_edges e join r a on e.record_a_id = a.record_id join r b on e.record_b_id = b.record_id where lower(trim(kind)) = 'same_as'
  union select a.row_id, b.row_id from gm_match_log g join r a on g.record_id_a = a.row_id join r b on g.record_id_b = b.row_id where lower(trim(action)) = 'merged'),
l as (select u, v from l0 where u <> v union select v, u from l0 where u <> v),
reach(x, y) as (select u, u from l union select reach.x, l.v from reach join l on reach.y = l.u)
select x row_id, min(y) group_row_id from reach group by x""",
    "p7_found": """with g as (select cluster_id, arg_max(source_ids, (merged_at, id)) ids from gm_golden_records where merged_at is not null group by 1),
m as (select distinct cluster_id, unnest(ids) row_id from g),
r as (select distinct row_id, last_seen_at, payload from source_records where row_id in (select row_id from m)),
f as (select row_id, any_value(last_seen_at) seen, coalesce((select count(*) from json_tree(case when json_valid(payload) then payload end) t where t.type not in ('OBJECT', 'ARRAY', 'NULL')
  and lower(trim(regexp_replace(t.atom::json->>'$', '\\s+', ' ', 'g'))) not in (""" + ", ".join(f"'{v}'" for v in sorted(survivors.STAND_INS)) + """)), 0) filled from r group by row_id, payload)
select cluster_id, arg_max(row_id, (filled, seen, -row_id)) row_id from m join f using (row_id) group by 1""",
}
