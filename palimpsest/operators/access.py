"""Access by grant tags: building tags, deciding, filtering, sharing and widening audiences.

A grant allows or denies an action on a resource pattern, in which `*` stands for any characters. Of the grants that
match a tag the one with the longest literal prefix decides; a denial wins ties. A document is visible to its creator
and to whoever a grant allows at least one of its tags. Grants with a condition count only if it is registered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import record_id
from palimpsest.functions.text import trimmed


def owner_tag(principal: Column) -> Column:
    return F.concat(F.lit("memory.owner:"), principal)


def tenant_tag(tenant: Column) -> Column:
    return F.concat(F.lit("memory.tenant:"), tenant)


def document_tag(document_id: Column) -> Column:
    return F.concat(F.lit("memory.doc:"), document_id)


def access_tags(owner: Column, explicit: Column, tenant: Column, peers: Column, tags: Column) -> Column:
    """Tags of a new document: its owner's, explicit ones, the tenant's (where given), peers' and more; trimmed, without
    blanks, each once, in that order. Null arrays count as empty."""
    none = F.array().cast("array<string>")
    listed = F.concat(
        F.array(owner_tag(trimmed(owner))),
        F.coalesce(explicit, none),
        F.when(tenant.isNotNull(), F.array(tenant_tag(tenant))).otherwise(none),
        F.transform(F.filter(F.coalesce(peers, none), lambda p: trimmed(p) != ""), lambda p: owner_tag(trimmed(p))),
        F.coalesce(tags, none),
    )
    return F.array_distinct(F.filter(F.transform(listed, trimmed), lambda t: t.isNotNull() & (t != "")))


def effective_grants(grants: DataFrame, now: Column, conditions: dict[str, Callable[[], bool]] | None = None) -> DataFrame:
    """Grants in force: the latest of each id, not expired, without a condition or with one that holds."""
    met = sorted(k for k, f in (conditions or {}).items() if f())
    return grants.where((F.col("expires_at").isNull() | (F.col("expires_at") > now)) & (F.col("conditions").isNull() | F.col("conditions").isin(*met) if met else F.col("conditions").isNull()))


def _pattern(resource: Column) -> Column:
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(resource, r"([.\\+?()\[\]{}^$|])", r"\\$1"), r"\*", ".*"), F.lit("$"))


def tag_decisions(tags: DataFrame, grants: DataFrame, action: str = "search") -> DataFrame:
    """(principal_id, tag, allowed) for each distinct tag that any grant on the action matches.

    tags: column tag. Exact grants are joined on the tag; only patterns are compared with every tag, and of tags each
    distinct one once, however many documents carry it. Grants are few and Spark sends them along by their measured size.
    """
    g = grants.where(F.col("action") == action).select("principal_id", "resource", "effect")
    literal = F.length(F.substring_index("resource", "*", 1))
    distinct = tags.select("tag").distinct()
    exact = distinct.join(g.where(~F.contains("resource", F.lit("*"))), F.col("tag") == F.col("resource"))
    wild = distinct.join(g.where(F.contains("resource", F.lit("*"))).withColumn("prefix", F.substring_index("resource", "*", 1)), F.startswith("tag", F.col("prefix")) & F.regexp_like(F.col("tag"), _pattern(F.col("resource")))).drop("prefix")
    matched = exact.unionByName(wild).withColumn("literal", literal)
    return matched.groupBy("principal_id", "tag").agg((F.max_by("effect", F.struct("literal", F.col("effect") != "allow")) == "allow").alias("allowed"))


def own_documents(documents: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal_id, document_id) that each of `principals` created: all that anyone may see where no grants are known."""
    return documents.select(F.col("creator").alias("principal_id"), "document_id").join(principals, "principal_id", "left_semi").distinct()


def visible_documents(documents: DataFrame, grants: DataFrame, principals: DataFrame, action: str = "search") -> DataFrame:
    """(principal_id, document_id) that each of `principals` may see.

    documents: document_id, access_tags, creator (null: nobody's). A document without tags is its creator's only.
    """
    tagged = documents.select("document_id", F.explode(F.array_distinct("access_tags")).alias("tag"))
    allowed = tag_decisions(tagged, grants.join(principals, "principal_id", "left_semi"), action).where("allowed")
    by_grant = tagged.join(allowed, "tag").select("principal_id", "document_id")
    return by_grant.unionByName(own_documents(documents, principals)).distinct()


def creators(documents: DataFrame, version: DataFrame, generation: str = "live") -> DataFrame:
    """Documents with the principal who created their active version of a generation, null without one."""
    v = version.where((F.col("status") == "active") & (F.col("generation") == generation)).select("tenant_id", F.col("document_id").alias("id"), F.col("created_by_principal_id").alias("creator"))
    return documents.join(v, ["tenant_id", "id"], "left")


def split_audience(proposed: Column, source: Column) -> Column:
    """Which proposed tags the source already has, and which need approval; order and repetitions of `proposed` stay."""
    src = F.coalesce(source, F.array().cast("array<string>"))
    return F.struct(F.filter(proposed, lambda t: F.array_contains(src, t)).alias("allowed"), F.filter(proposed, lambda t: ~F.array_contains(src, t)).alias("needs_approval"))


def share_grants(shares: DataFrame) -> DataFrame:
    """One grant to search a document for each peer it is shared with. shares: document_id, sharer, principals.
    Peers are trimmed; blanks, the sharer and repetitions are left out."""
    peers = shares.select("document_id", "sharer", F.explode("principals").alias("p")).select("document_id", "sharer", trimmed(F.col("p")).alias("principal_id"))
    kept = peers.where((F.col("principal_id") != "") & (F.col("principal_id") != F.col("sharer"))).select("document_id", "principal_id").distinct()
    return kept.select(
        record_id("mgrt", F.col("document_id"), F.col("principal_id")).alias("id"), "principal_id", document_tag(F.col("document_id")).alias("resource"), F.lit("search").alias("action"), F.lit("allow").alias("effect"), F.lit("memory_share").alias("origin")
    )


def put_grants(grants: DataFrame, new: DataFrame) -> DataFrame:
    """`grants` with those of `new` put in; one with the same id is replaced."""
    return grants.join(new.select("id"), "id", "left_anti").unionByName(new.dropDuplicates(["id"]))
