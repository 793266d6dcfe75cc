"""Registered queries on broken references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import references as R
from palimpsest.runtime import table


def _broken(spark: SparkSession, root: str) -> DataFrame:
    t = lambda n: table(spark, root, n)
    children = R.edge_references(t("memory_edge")).unionByName(R.derived_references(t("memory_add")))
    return R.broken_references(children, R.parents(t("memory_document"), t("memory_version"), t("memory_chunk"), t("memory_entity")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _broken(spark, root).select("src_table", "src_id", "src_field", "ref")


def p2_counts(spark: SparkSession, root: str) -> DataFrame:
    return R.broken_reference_counts(_broken(spark, root))


_BROKEN = r"""
with raw as (
  select 'memory_edge' as src_table, id as src_id, 'from_ref' as src_field, from_type as ptype, from_ref as r, tenant_id, created_at as t_at from memory_edge
  union all select 'memory_edge', id, 'to_ref', to_type, to_ref, tenant_id, created_at from memory_edge
  union all select 'memory_add', request_id, 'derived_from', 'version', unnest(derived_from), tenant_id, received_at from memory_add),
child as (select src_table, src_id, src_field, ptype, trim(r, ' ' || chr(9) || chr(10) || chr(13)) as ref, tenant_id, t_at from raw where r is not null),
parent as (
  select distinct 'document' as ptype, id as ref, tenant_id as pt, created_at as pat, false as dead from memory_document
  union select distinct 'version', id, tenant_id, ingested_at, coalesce(status = 'tombstoned', false) from memory_version
  union select distinct 'chunk', id, tenant_id, created_at, false from memory_chunk
  union select distinct 'entity', id, tenant_id, created_at, false from memory_entity),
j as (
  select src_table, src_id, src_field, child.ref as ref, t_at, parent.ref is null as missing,
    parent.ref is not null and pt is distinct from tenant_id as "foreign", coalesce(dead, false) as deleted, coalesce(pat > t_at, false) as late
  from child left join parent on child.ptype = parent.ptype and child.ref = parent.ref where child.ref <> ''),
broken as (select distinct * from j where missing or "foreign" or deleted or late)
"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
SQL = {
    "p2_found": _BROKEN + "select src_table, src_id, src_field, ref from broken",
    "p2_counts": _BROKEN
    + """select src_table, src_field, strftime(t_at, '%Y-%m') as month, count(*) as n_refs, count(*) filter (where missing) as n_missing,
    count(*) filter (where "foreign") as n_foreign, count(*) filter (where deleted) as n_deleted, count(*) filter (where late) as n_late from broken group by 1, 2, 3""",
}
