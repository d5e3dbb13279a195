"""Queries of the general training-data operators: repeated delivery (p2) and orphan references (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import find_orphans, orphan_report, parents_table, refs_table
from ..session import table
from ..streaming.delivery import repeated_deliveries


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(spark, f"{sf_dir}/judge_pp_b.parquet")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, staging = table(spark, sf_dir, "graph_edges"), table(spark, sf_dir, "concept_staging")
    refs = (
        refs_table(edges, "graph_edges", "edge_no", "src", "observed_at")
        .unionByName(refs_table(edges, "graph_edges", "edge_no", "dst", "observed_at"))
        .unionByName(refs_table(staging, "concept_staging", "id", "target_ref", "created_at"))
    )
    return find_orphans(refs, parents_table(table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "shared_nodes")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).drop("at")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_report": p4_report}

_NORM = r"trim(replace({}, '\', '/'), chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))"
_REFS = f"""
with n as (
  select {_NORM.format("id")} as id, created_at, deleted_at
  from (select id, created_at, deleted_at from graph_nodes union all select id, created_at, deleted_at from shared_nodes) where id is not null),
r as (
  select 'graph_edges' as table_name, edge_no as record_id, 'src' as field_name, {_NORM.format("src")} as k, observed_at as t from graph_edges where src is not null
  union all select 'graph_edges', edge_no, 'dst', {_NORM.format("dst")}, observed_at from graph_edges where dst is not null
  union all select 'concept_staging', id, 'target_ref', {_NORM.format("target_ref")}, created_at from concept_staging where target_ref is not null),
o as (
  select table_name, record_id, field_name, any_value(t) as t,
         case when count(n.id) = 0 then 'missing' when min(n.created_at) > any_value(t) then 'late' else 'deleted' end as kind
  from r left join n on n.id = r.k group by table_name, record_id, field_name
  having coalesce(max(case when n.created_at <= t and (n.deleted_at is null or t < n.deleted_at) then 1 else 0 end), 0) = 0)
"""

ORACLE = {
    "p2_found": """select row_no from (select row_no, row_number() over (partition by id, "group" order by ts nulls last, row_no) as n
                   from judge_pp_b where id is not null and "group" is not null) where n > 1""",
    "p4_found": _REFS + "select table_name, record_id, field_name, kind from o",
    "p4_report": _REFS + "select table_name, field_name, strftime(t, '%Y-%m') as month, kind, count(*) as n from o group by all",
}
