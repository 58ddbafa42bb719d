"""Edges -> objects: every endpoint with its URL and latest event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.columns import table_url
from edgeloom.functions.constants import TABLE_NODE_TYPE


def endpoints(edges: DataFrame, host: str) -> DataFrame:
    """UNION ALL of source and target endpoints (the four legs, in one pass).

    Table-typed endpoints get their explorer link; others keep the edge's
    entity link. Rows with a NULL object or type are dropped, like the legs'
    ``type = ...`` / ``type != ...`` filters do.
    """

    def leg(obj, typ):
        o, t = F.col(obj), F.col(typ)
        url = F.when(t == TABLE_NODE_TYPE, table_url(o, host)).otherwise(F.col("entity_path"))
        return F.struct(o.alias("node"), t.alias("node_type"), url.alias("entity_path"),
                        F.col("last_event_time").alias("last_event_time"),
                        F.col("lineage_source_table").alias("lineage_source_table"))

    legs = F.array(leg("source_object", "source_type"), leg("target_object", "target_type"))
    return (edges.select(F.inline(legs))
            .filter(F.col("node").isNotNull() & F.col("node_type").isNotNull()))


def objects_union(edges: DataFrame, host: str) -> DataFrame:
    """Latest event time per (node, type, URL, tag)."""
    return (endpoints(edges, host)
            .groupBy("node", "node_type", "entity_path", "lineage_source_table")
            .agg(F.max("last_event_time").alias("last_event_time"))
            .select("node", "node_type", "entity_path", "last_event_time", "lineage_source_table"))
