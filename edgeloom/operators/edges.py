"""Lineage events -> directed edges (one row per edge and latest event time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.columns import (
    entity_node_id,
    entity_url,
    normalize_type,
    object_name,
    window_start,
)
from edgeloom.functions.constants import INFO_SCHEMA, SYSTEM_CATALOG

EDGE_COLUMNS = ("source_object", "source_type", "target_object", "target_type", "entity_path",
                "last_event_time", "workspace_id", "lineage_source_table")


def filter_events(raw: DataFrame, workspace: str, as_of, days: int) -> DataFrame:
    """Keep events of one workspace inside the window, dropping operational ones.

    Only the first non-NULL catalog (and schema) of source and target is looked at,
    so a system target with a user source stays. The date bound is inclusive and
    reaches the parquet scan as a pushed filter (partition filter when the log is
    partitioned by ``event_date``).
    """
    return raw.filter(
        F.col("entity_type").isNotNull()
        & (F.col("workspace_id").cast("string") == F.lit(str(workspace)))
        & (F.coalesce("source_table_catalog", "target_table_catalog", F.lit("unknown")) != SYSTEM_CATALOG)
        & (F.coalesce("source_table_schema", "target_table_schema", F.lit("unknown")) != INFO_SCHEMA)
        & (F.col("event_date") >= window_start(as_of, days))
    )


def edge_events_max(filtered: DataFrame, host: str, *per: str) -> DataFrame:
    """Latest event time per (entity, source, target, URL, workspace, tag), and per columns ``per``.

    Partial aggregation runs before the shuffle, so a hot entity costs one
    partial row per task, not all its events in one task.
    """
    keyed = filtered.select(
        normalize_type("entity_type").alias("source_entity_type"),
        F.col("entity_id").alias("source_entity_id"),
        object_name("source_table_full_name", "source_path").alias("source_table_full_name"),
        normalize_type("source_type").alias("source_type"),
        object_name("target_table_full_name", "target_path").alias("target_table_full_name"),
        normalize_type("target_type").alias("target_type"),
        entity_url("entity_type", "entity_id", host).alias("entity_path"),
        "event_time", "workspace_id", "lineage_source_table", *per,
    )
    keys = [c for c in keyed.columns if c != "event_time"]
    return keyed.groupBy(*keys).agg(F.max("event_time").alias("last_event_time"))


def edges_union(grouped: DataFrame, drop_null: bool = True) -> DataFrame:
    """Each grouped event gives entity->target and source->entity; distinct non-NULL edges.

    One pass with ``inline(array(struct, struct))`` replaces the two scans of a
    UNION; the NULL filter runs before the distinct so it shrinks the shuffle.
    """
    ent = entity_node_id("source_entity_type", "source_entity_id")
    common = [F.col("entity_path"), F.col("last_event_time"), F.col("workspace_id"),
              F.col("lineage_source_table")]
    names = list(EDGE_COLUMNS)

    def edge(src, stype, tgt, ttype):
        cols = [src, stype, tgt, ttype, *common]
        return F.struct(*[c.alias(n) for c, n in zip(cols, names)])

    both = F.array(
        edge(ent, F.col("source_entity_type"), F.col("target_table_full_name"), F.col("target_type")),
        edge(F.col("source_table_full_name"), F.col("source_type"), ent, F.col("source_entity_type")),
    )
    flat = grouped.select(F.inline(both))
    return (edge_not_null(flat) if drop_null else flat).distinct()


def edge_not_null(edges: DataFrame) -> DataFrame:
    return edges.dropna(subset=["source_object", "target_object", "source_type", "target_type"])


def build_edges(raw: DataFrame, workspace: str, host: str, as_of, days: int) -> DataFrame:
    """Raw lineage log -> edges view."""
    return edges_union(edge_events_max(filter_events(raw, workspace, as_of, days), host))
