"""Objects + inventories -> node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.columns import inventory_url, window_start
from edgeloom.functions.constants import HMS_TAG, INFO_SCHEMA, SYSTEM_CATALOG, TABLE_NODE_TYPE, UC_TAG

NODE_COLUMNS = ("node", "node_type", "entity_path", "last_event_date", "lineage_source_table")


def nodes_with_event(objects: DataFrame) -> DataFrame:
    """Objects with their last event as a date (the grouping is a distinct)."""
    return objects.select(
        "node", "node_type", "entity_path",
        F.to_date("last_event_time").alias("last_event_date"),
        "lineage_source_table",
    ).distinct()


def filter_inventory(inventory: DataFrame, as_of, days: int) -> DataFrame:
    """Drop operational tables and tables not altered inside the window."""
    return inventory.filter(
        (F.col("table_catalog") != SYSTEM_CATALOG)
        & (F.col("table_schema") != INFO_SCHEMA)
        & (F.to_date("last_altered") >= window_start(as_of, days))
    )


def _inventory_nodes(inventory: DataFrame, host: str, tag: str) -> DataFrame:
    return inventory.select(
        F.concat(F.col("table_catalog"), F.lit("."), F.col("table_schema"), F.lit("."), F.col("table_name"))
        .alias("node"),
        F.lit(TABLE_NODE_TYPE).alias("node_type"),
        inventory_url("table_catalog", "table_schema", "table_name", host).alias("entity_path"),
        F.to_date("last_altered").alias("last_event_date"),
        F.lit(tag).alias("lineage_source_table"),
    )


def _without_events(candidates: DataFrame, event_nodes: DataFrame) -> DataFrame:
    # LEFT JOIN ... WHERE right IS NULL stays an outer join plus a filter in
    # Catalyst; the anti join says the same and never materializes the matches.
    # A NULL node id never matches, so it stays (as in the outer-join form).
    return candidates.join(event_nodes.select("node"), "node", "left_anti")


def lonely_tables(inventory: DataFrame, event_nodes: DataFrame, host: str, as_of, days: int) -> DataFrame:
    """Recently altered catalog tables that no event mentions."""
    return _without_events(_inventory_nodes(filter_inventory(inventory, as_of, days), host, UC_TAG),
                           event_nodes)


def lonely_legacy_tables(legacy: DataFrame, event_nodes: DataFrame, host: str) -> DataFrame:
    """Legacy tables that no event mentions (no catalog or date filter)."""
    return _without_events(_inventory_nodes(legacy, host, HMS_TAG), event_nodes)


def nodes_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def build_nodes(objects: DataFrame, inventory: DataFrame, legacy: DataFrame, host: str, as_of,
                days: int) -> DataFrame:
    """Whole node frame: event nodes + both lonely sets, deduplicated.

    The reference then left-joins links as source and target and groups by the
    node columns only; those joins cannot change the result, so the distinct of
    :func:`nodes_union` is all that remains (Catalyst removes them too).
    """
    nwe = nodes_with_event(objects)
    return nodes_union(nwe, lonely_tables(inventory, nwe, host, as_of, days),
                       lonely_legacy_tables(legacy, nwe, host))


def nodes_links_left(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The reference's two left joins to links under a grouping of node columns.

    Kept as its own operator to show the equivalence: it equals ``nodes.distinct()``.
    """
    return nodes.select(*NODE_COLUMNS).distinct()
