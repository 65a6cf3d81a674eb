"""Entity graph tables: building, deltas, statistics and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import rules

# ---- fixed values: relation types ---------------------------------------------------------
RELATION_TYPES = ["treats", "causes", "associated_with", "contraindicated", "diagnoses", "prevents",
                  "symptom_of", "interacts_with", "related_to"]
# -------------------------------------------------------------------------------------------


def build_nodes(entities: DataFrame) -> DataFrame:
    """``entities(name, count, create_time, chunk_ids)`` to nodes with their group."""
    return entities.select(F.col("name").alias("id"), F.col("name").alias("label"),
                           rules.entity_group("name").alias("grp"),
                           F.coalesce("count", F.lit(1)).cast("bigint").alias("weight"),
                           F.coalesce("create_time", F.lit(0)).cast("bigint").alias("create_time"), "chunk_ids")


def build_edges(relations: DataFrame) -> DataFrame:
    """``relations(source, target, count, create_time)`` to edges."""
    kind = F.col("relation_type") if "relation_type" in relations.columns else F.lit(None).cast("string")
    return relations.select("source", "target", F.coalesce("count", F.lit(1)).cast("bigint").alias("weight"),
                            F.coalesce("create_time", F.lit(0)).cast("bigint").alias("create_time"),
                            kind.alias("relation_type"))


def graph_snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the latest creation time over nodes and edges, 0 for an empty graph."""
    return (nodes.select("create_time").unionByName(edges.select("create_time"))
            .agg(F.coalesce(F.max("create_time"), F.lit(0)).cast("bigint").alias("since")))


def graph_delta(table: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows created strictly after the snapshot; a zero snapshot has no delta."""
    since = snapshot.select("since").scalar()
    return table.where((since > 0) & (F.col("create_time") > since))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct undirected edges per node, self loops left out, zero included.

    Counts are partial before the shuffle, so a hub does not gather its edges anywhere.
    """
    pairs = (edges.where(F.col("source") != F.col("target"))
             .select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    d = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def graph_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations per check; all zero for a sound graph."""
    ids = nodes.select("id").distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")

    def named(row: DataFrame) -> DataFrame:
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in row.columns])))

    lost = lambda end: edges.join(ids, edges[end] == ids["id"], "left_anti")
    per_id = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("grp").isin(rules.ENTITY_GROUPS)).alias("g"))
    of_nodes = per_id.agg(F.count_if(F.col("n") > 1).alias("unique_ids"), F.coalesce(F.sum("g"), F.lit(0)).alias("known_group"))
    of_edges = edges.agg(F.count_if(F.col("source") == F.col("target")).alias("no_self_loops"),
                         F.count_if(F.col("weight") <= 0).alias("positive_weight"))
    return (named(of_nodes).unionByName(named(of_edges)).unionByName(count(lost("source"), "source_exists"))
            .unionByName(count(lost("target"), "target_exists")))


def graph_stats(nodes: DataFrame, edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Totals and the histograms of node groups and edge types as ``(kind, name, n)`` rows."""
    node_types = nodes.groupBy(F.col("grp").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("node_type").alias("kind"), "name", "n")
    edge_types = edges.groupBy(F.coalesce("relation_type", F.lit("related_to")).alias("name")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("edge_type").alias("kind"), "name", "n")
    totals = [(nodes.agg(F.count(F.lit(1)).alias("n")), "nodes"), (edges.agg(F.count(F.lit(1)).alias("n")), "edges"),
              (nodes.agg(F.count_distinct("grp").alias("n")), "entity_types")]
    if docs is not None:
        totals.append((docs.agg(F.count_distinct(F.coalesce("file_path", "doc_key")).alias("n")), "docs"))
    out = node_types.unionByName(edge_types)
    for df, name in totals:
        out = out.unionByName(df.select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n"))
    return out


def list_top_nodes(nodes: DataFrame, group: str | None = None, search: str | None = None,
                   limit: int = 20) -> DataFrame:
    """Heaviest nodes of a group whose label contains the search text."""
    out = nodes
    if group:
        out = out.where(F.col("grp") == group)
    if search:
        out = out.where(F.contains(F.lower("label"), F.lit(search.lower())))
    return out.orderBy(F.col("weight").desc(), "id").limit(limit)


def entity_index(chunk_entities: DataFrame) -> DataFrame:
    """Entity to chunk count and first-seen time; ``chunk_entities(entity, chunk_id, seen_at)``.

    Repeats fold first; the ids themselves stay rows (``entity_chunks``), because a common
    entity occurs in a large share of all chunks.
    """
    return entity_chunks(chunk_entities).groupBy("entity").agg(
        F.count(F.lit(1)).alias("count"), F.min("seen_at").alias("create_time"))


def entity_chunks(chunk_entities: DataFrame) -> DataFrame:
    return chunk_entities.groupBy("entity", "chunk_id").agg(F.min("seen_at").alias("seen_at"))


def relation_index(triples: DataFrame) -> DataFrame:
    """Pair of entities to the number of chunks that state it; ``triples(source, target, chunk_id)``."""
    return triples.distinct().groupBy("source", "target").agg(F.count(F.lit(1)).alias("count"))


def add_relations(relations: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append typed relations with the usual defaults; unknown types become ``related_to``."""
    level = F.coalesce("evidence_level", F.lit(7)) if "evidence_level" in fresh.columns else F.lit(7)
    confidence = F.coalesce("confidence", F.lit(0.5)) if "confidence" in fresh.columns else F.lit(0.5)
    doc = F.coalesce("source_doc", F.lit("")) if "source_doc" in fresh.columns else F.lit("")
    rows = fresh.select("source", "target",
                        F.when(F.col("relation_type").isin(RELATION_TYPES), F.col("relation_type"))
                        .otherwise("related_to").alias("relation_type"),
                        level.alias("evidence_level"), confidence.alias("confidence"), doc.alias("source_doc"))
    return relations.unionByName(rows)
