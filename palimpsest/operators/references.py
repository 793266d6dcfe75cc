"""References to records that do not exist: dangling, foreign, deleted and late ones.

Parents and children are put into one long table keyed by (parent table, key). One aggregation, with map-side partial
aggregates, gives each key its parent's facts and the extremes of its children; keys whose parent exists and whose
extremes are all in order drop out there, before any child is looked at singly. What is left is joined back to the
children, which are read once more for that. A key with very many children (a hub may hold a third of all rows) is
salted: its children are dealt by a hash into groups of about `HOT`, and its facts are repeated for each group. Which
keys are salted is sent to all tasks, `HOT_KEYS` of them at most, whatever the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import durable

#: Characters that never count around a reference: blanks, tabs, line ends.
BLANKS = " \t\r\n"
#: A suspicious key is hot with so many children and more, or with this share of those of all suspicious keys if that is
#: more; so at most HOT_KEYS keys are hot, and no other has more children than a task can take.
HOT, HOT_KEYS = 1_000, 20_000


def _ref(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def edge_references(edge: DataFrame) -> DataFrame:
    """Both ends of each edge in long form. A null or blank ref is no reference. An end without a type has the parent
    table `unknown`, which holds nothing."""
    end = lambda f: F.struct(
        F.lit(f"{f}_ref").alias("src_field"),
        F.coalesce(F.col(f"{f}_type"), F.lit("unknown")).alias("parent_table"),
        _ref(F.col(f"{f}_ref")).alias("ref"),
    )
    return (
        edge.select(F.lit("memory_edge").alias("src_table"), F.col("id").alias("src_id"), "tenant_id", F.col("created_at").alias("at"), F.explode(F.array(end("from"), end("to"))).alias("e"))
        .select("src_table", "src_id", "tenant_id", "at", "e.*")
        .where("ref <> ''")
    )


def derived_references(add: DataFrame) -> DataFrame:
    """The elements of `derived_from`, which name versions. Null and empty lists, null and blank elements are none."""
    return add.select(
        F.lit("memory_add").alias("src_table"),
        F.col("request_id").alias("src_id"),
        "tenant_id",
        F.col("received_at").alias("at"),
        F.lit("derived_from").alias("src_field"),
        F.lit("version").alias("parent_table"),
        F.explode("derived_from").alias("raw"),
    ).select("src_table", "src_id", "tenant_id", "at", "src_field", "parent_table", _ref(F.col("raw")).alias("ref")).where("ref <> ''")


def parents(document: DataFrame, version: DataFrame, chunk: DataFrame, entity: DataFrame) -> DataFrame:
    """The keys that may be referred to: (parent_table, ref, tenant_id, at, deleted)."""

    def of(df: DataFrame, name: str, at: str, deleted: Column) -> DataFrame:
        return df.select(F.lit(name).alias("parent_table"), F.col("id").alias("ref"), "tenant_id", F.col(at).alias("at"), deleted.alias("deleted"))

    alive = F.lit(False)
    return (
        of(document, "document", "created_at", alive)
        .unionByName(of(version, "version", "ingested_at", F.coalesce(F.col("status") == "tombstoned", alive)))
        .unionByName(of(chunk, "chunk", "created_at", alive))
        .unionByName(of(entity, "entity", "created_at", alive))
        .where(F.col("ref").isNotNull())
    )


def suspicious_keys(children: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """One row for each referred key that lacks a parent or may have a child at odds with it.

    Columns: parent_table, ref, has_parent, p_tenant, p_at, p_deleted, n_children. Should several rows with one id
    disagree, the largest tenant and the earliest time count, and one deletion is enough.
    """
    no = lambda t: F.lit(None).cast(t)
    c = children.select("parent_table", "ref", F.col("tenant_id").alias("c_tenant"), F.col("at").alias("c_at"), no("string").alias("p_tenant"), no("timestamp_ntz").alias("p_at"), no("boolean").alias("p_deleted"))
    p = parent_rows.select("parent_table", "ref", no("string").alias("c_tenant"), no("timestamp_ntz").alias("c_at"), F.col("tenant_id").alias("p_tenant"), F.col("at").alias("p_at"), F.col("deleted").alias("p_deleted"))
    is_child = F.col("p_deleted").isNull()
    keys = (
        c.unionByName(p)
        .groupBy("parent_table", "ref")
        .agg(
            F.bool_or(~is_child).alias("has_parent"),
            F.max("p_tenant").alias("p_tenant"),
            F.min("p_at").alias("p_at"),
            F.max("p_deleted").alias("p_deleted"),
            F.count(F.when(is_child, 1)).alias("n_children"),
            F.min("c_tenant").alias("c_low"),
            F.max("c_tenant").alias("c_high"),
            F.count(F.when(is_child & F.col("c_tenant").isNull(), 1)).alias("c_untenanted"),
            F.min("c_at").alias("c_first"),
        )
    )
    odd = (
        ~F.col("has_parent")
        | F.col("p_deleted")
        | ~F.col("c_low").eqNullSafe(F.col("p_tenant"))
        | ~F.col("c_high").eqNullSafe(F.col("p_tenant"))
        | (F.col("c_untenanted") > 0)
        | F.coalesce(F.col("p_at") > F.col("c_first"), F.lit(False))
    )
    return keys.where((F.col("n_children") > 0) & odd).drop("c_low", "c_high", "c_untenanted", "c_first")


def broken_references(children: DataFrame, parent_rows: DataFrame, hot: int = HOT, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Each distinct reference that is broken, with its reasons.

    children: src_table, src_id, src_field, parent_table, ref, tenant_id, at. parent_rows: see `parents`.
    Result: src_table, src_id, src_field, ref, at, missing, foreign, deleted, late. Rows delivered twice count once;
    should they disagree, the earliest time and every reason count.
    Tenants are compared null-safely; a missing time is never late. Empty inputs give an empty result, and without
    any parents every reference is missing.
    """
    bad = durable(suspicious_keys(children, parent_rows))
    on = ["parent_table", "ref"]
    least = max(hot, (bad.agg(F.sum("n_children")).first()[0] or 0) // hot_keys)
    groups = F.when(F.col("n_children") >= least, F.ceil(F.col("n_children") / hot)).otherwise(1).cast("int")
    salted = F.broadcast(bad.where(F.col("n_children") >= least).select(*on, groups.alias("groups")))  # at most hot_keys rows
    dealt = children.join(salted, on, "left").withColumn("salt", F.when(F.col("groups").isNull(), 0).otherwise(F.pmod(F.xxhash64("src_id", "src_field"), F.col("groups"))).cast("int"))
    joined = dealt.drop("groups").join(bad.withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1))), [*on, "salt"])
    has = F.col("has_parent")
    return (
        joined.select(
            "src_table",
            "src_id",
            "src_field",
            "ref",
            "at",
            (~has).alias("missing"),
            (has & ~F.col("tenant_id").eqNullSafe(F.col("p_tenant"))).alias("foreign"),
            (has & F.coalesce("p_deleted", F.lit(False))).alias("deleted"),
            (has & F.coalesce(F.col("p_at") > F.col("at"), F.lit(False))).alias("late"),
        )
        .where("missing or foreign or deleted or late")
        .groupBy("src_table", "src_id", "src_field", "ref")
        .agg(F.min("at").alias("at"), *[F.max(c).alias(c) for c in ("missing", "foreign", "deleted", "late")])
    )


def broken_reference_counts(broken: DataFrame) -> DataFrame:
    """Broken references by referring table, field and month, in all and by reason (one may have several)."""
    n = lambda c: F.count(F.when(F.col(c), 1)).alias(f"n_{c}")
    return broken.groupBy("src_table", "src_field", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_refs"), n("missing"), n("foreign"), n("deleted"), n("late"))
