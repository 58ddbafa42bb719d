"""Registered queries: scans, column rules, edges, objects, links, degrees, nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom import oracle as O
from edgeloom.functions.columns import (
    entity_node_id,
    entity_url,
    inventory_url,
    normalize_type,
    object_name,
    table_url,
)
from edgeloom.operators import degree as deg
from edgeloom.operators import edges as E
from edgeloom.operators import links as L
from edgeloom.operators import nodes as N
from edgeloom.operators import objects as OB
from edgeloom.plans.registry import register
from edgeloom.sources import scans as S
from edgeloom.sources.fixtures import legacy_inventory_source

W = O.with_ctes

# ------------------------------------------------------------------ scans
@register("lineage_scan", W(f"""
SELECT {O.EVENT_COLS.replace(', lineage_source_table', '')}, 'table_lineage' AS lineage_source_table
FROM lineage_events""", "lineage_events"))
def q_lineage_scan(c):
    return S.lineage_scan(c.fx.events().drop("lineage_source_table"))


@register("lineage_scan_union", W(f"SELECT {O.EVENT_COLS} FROM lineage_events", "lineage_events"))
def q_lineage_scan_union(c):
    uc, hms = S.split_by_tag(c.fx.events())
    return S.lineage_raw(uc, hms)


@register("publish_view", W(f"SELECT {O.EDGE_COLS} FROM edges", "edges"))
def q_publish_view(c):
    from edgeloom.sources.sinks import publish
    return publish(c.g.edges(), "vw_sources_targets_fill")


@register("table_inventory", W(f"""
SELECT table_catalog, table_schema, table_name, {O.d('last_altered')},
       table_catalog || '.' || table_schema || '.' || table_name AS node,
       '{O.EXPLORE}' || table_catalog || '/' || table_schema || '/' || table_name AS entity_path
FROM inv_fx""", "inv_fx"))
def q_table_inventory(c):
    return S.table_inventory(c.fx.inventory(), c.host)


@register("legacy_inventory", W(f"""
SELECT table_catalog, table_schema, table_name,
       strftime(TIMESTAMP '9999-12-31 23:59:59.999999', '%Y-%m-%d %H:%M:%S.%f') AS last_altered
FROM legacy_fx""", "legacy_fx"))
def q_legacy_inventory(c):
    return S.legacy_inventory(legacy_inventory_source(c.fx.table("supplier")))


@register("valid_table_ids", W("SELECT table_id FROM valid_ids", "valid_ids"))
def q_valid_table_ids(c):
    return S.valid_table_ids(c.fx.inventory(), c.fx.legacy())


@register("table_ids_union", W("SELECT table_id FROM valid_ids", "valid_ids"))
def q_table_ids_union(c):
    return S.valid_table_ids(c.fx.inventory(), c.fx.legacy())


# ------------------------------------------------------------- column rules
@register("normalize_type", W(f"""
SELECT entity_type, {O._norm('entity_type')} AS entity_node_type, source_type,
       {O._norm('source_type')} AS source_node_type, target_type, {O._norm('target_type')} AS target_node_type
FROM lineage_events""", "lineage_events"))
def q_normalize_type(c):
    ev = c.fx.events()
    return ev.select("entity_type", normalize_type("entity_type").alias("entity_node_type"),
                     "source_type", normalize_type("source_type").alias("source_node_type"),
                     "target_type", normalize_type("target_type").alias("target_node_type"))


@register("entity_url", W(f"SELECT entity_type, entity_id, {O._URL} AS entity_path FROM lineage_events",
                          "lineage_events"))
def q_entity_url(c):
    return c.fx.events().select("entity_type", "entity_id",
                                entity_url("entity_type", "entity_id", c.host).alias("entity_path"))


@register("table_url", W(f"""
SELECT source_table_full_name, '{O.EXPLORE}' || replace(source_table_full_name, '.', '/') AS url
FROM lineage_events""", "lineage_events"))
def q_table_url(c):
    return c.fx.events().select("source_table_full_name",
                                table_url("source_table_full_name", c.host).alias("url"))


@register("inventory_url", W(f"""
SELECT table_catalog, table_schema, table_name,
       '{O.EXPLORE}' || table_catalog || '/' || table_schema || '/' || table_name AS url
FROM inv_fx""", "inv_fx"))
def q_inventory_url(c):
    return c.fx.inventory().select("table_catalog", "table_schema", "table_name",
                                   inventory_url("table_catalog", "table_schema", "table_name", c.host)
                                   .alias("url"))


@register("object_name", W("""
SELECT source_table_full_name, source_path, COALESCE(source_table_full_name, source_path) AS source_object
FROM lineage_events""", "lineage_events"))
def q_object_name(c):
    return c.fx.events().select("source_table_full_name", "source_path",
                                object_name("source_table_full_name", "source_path").alias("source_object"))


@register("entity_node_id", W(f"""
SELECT entity_type, entity_id, {O._norm('entity_type')} || '-' || entity_id AS node
FROM lineage_events""", "lineage_events"))
def q_entity_node_id(c):
    return c.fx.events().select("entity_type", "entity_id",
                                entity_node_id(normalize_type("entity_type"), "entity_id").alias("node"))


@register("event_filters", W(f"SELECT {O.EVENT_COLS} FROM filtered", "filtered"))
def q_event_filters(c):
    return E.filter_events(c.fx.events(), c.params.workspace, c.as_of, c.days)


# -------------------------------------------------------------------- edges
_ITL_COLS = ", ".join(["source_entity_type", "source_entity_id", "source_table_full_name", "source_type",
                       "target_table_full_name", "target_type", "entity_path", O.ts("last_event_time"),
                       "workspace_id", "lineage_source_table"])


def _grouped(c):
    return c.once("grouped", lambda: E.edge_events_max(
        E.filter_events(c.fx.events(), c.params.workspace, c.as_of, c.days), c.host))


@register("edge_events_max", W(f"SELECT {_ITL_COLS} FROM access_pairs", "access_pairs"))
def q_edge_events_max(c):
    return _grouped(c)


@register("edges_union", W(f"SELECT {O.EDGE_COLS} FROM edges_all", "edges_all"))
def q_edges_union(c):
    return E.edges_union(_grouped(c), drop_null=False)


@register("edge_not_null", W(f"SELECT {O.EDGE_COLS} FROM edges", "edges"))
def q_edge_not_null(c):
    return E.edges_union(_grouped(c), drop_null=True)


# ------------------------------------------------------------------ objects
@register("objects_union_all", W(f"SELECT {O.OBJECT_COLS} FROM endpoints", "endpoints"))
def q_objects_union_all(c):
    return OB.endpoints(c.g.edges(), c.host)


@register("split_by_kind", W(f"""
SELECT node, node_type, entity_path, node_type = 'TABLE/VIEW/PATH' AS is_table FROM endpoints""", "endpoints"))
def q_split_by_kind(c):
    return OB.endpoints(c.g.edges(), c.host).select(
        "node", "node_type", "entity_path", (F.col("node_type") == "TABLE/VIEW/PATH").alias("is_table"))


@register("objects_union", W(f"SELECT {O.OBJECT_COLS} FROM objects", "objects"))
def q_objects_union(c):
    return c.g.objects()


# -------------------------------------------------------------------- links
@register("join_edges_source", W(f"SELECT {O.EDGE_COLS} FROM edges_src", "edges_src"))
def q_join_edges_source(c):
    return L.join_edges_source(c.g.edges(), c.g.objects())


@register("join_edges_target", W(f"SELECT {O.EDGE_COLS}, target_entity_path FROM edges_tgt", "edges_tgt"))
def q_join_edges_target(c):
    return L.join_edges_target(c.g.edges(), c.g.objects())


@register("links_raw", W(f"SELECT {O.LINK_COLS} FROM links_raw", "links_raw"))
def q_links_raw(c):
    return c.g.links_raw()


@register("break_two_cycles", W(f"SELECT {O.LINK_COLS} FROM links", "links"))
def q_break_two_cycles(c):
    return c.g.links()


@register("break_two_cycles_strict", W(f"SELECT {O.LINK_COLS} FROM links_strict", "links_strict"))
def q_break_two_cycles_strict(c):
    return L.break_two_cycles(c.g.links_raw(), "strict")


@register("drop_duplicates", W(f"SELECT DISTINCT {O.NODE_COLS} FROM nodes", "nodes"))
def q_drop_duplicates(c):
    return c.g.nodes().dropDuplicates()


# ------------------------------------------------------------------ degrees
@register("out_degree", W("""
SELECT source_node AS node, count(target_node) AS total_connections FROM links GROUP BY source_node""", "links"))
def q_out_degree(c):
    return deg.out_degree(c.g.links())


@register("in_degree", W("""
SELECT target_node AS node, count(source_node) AS total_connections FROM links GROUP BY target_node""", "links"))
def q_in_degree(c):
    return deg.in_degree(c.g.links())


@register("degree_union", W("""
SELECT source_node AS node, count(target_node) AS total_connections FROM links GROUP BY source_node
UNION
SELECT target_node AS node, count(source_node) AS total_connections FROM links GROUP BY target_node""", "links"))
def q_degree_union(c):
    return deg.degree_union(c.g.links())


@register("total_connections", W("SELECT id AS node, total_connections FROM degree", "degree"))
def q_total_connections(c):
    return deg.total_connections(c.g.links())


@register("total_connections_strict", W("SELECT id AS node, total_connections FROM degree_strict",
                                        "degree_strict"))
def q_total_connections_strict(c):
    return deg.total_connections(c.g.links(), "strict")


@register("most_connected", W("""
SELECT id, total_connections FROM degree ORDER BY total_connections DESC, id ASC NULLS LAST LIMIT 1""", "degree"))
def q_most_connected(c):
    return deg.most_connected(c.g.links())


# -------------------------------------------------------------------- nodes
@register("nodes_with_event", W(f"SELECT {O.NODE_COLS} FROM seen_nodes", "seen_nodes"))
def q_nodes_with_event(c):
    return N.nodes_with_event(c.g.objects())


@register("inventory_filters", W(f"""
SELECT table_catalog, table_schema, table_name, {O.d('last_altered')} FROM inv_fx
WHERE table_catalog != 'system' AND table_schema != 'information_schema'
  AND CAST(last_altered AS DATE) >= {O.START_SQL}""", "inv_fx"))
def q_inventory_filters(c):
    return N.filter_inventory(c.fx.inventory(), c.as_of, c.days)


@register("lonely_tables", W(f"SELECT {O.NODE_COLS} FROM lonely_uc", "lonely_uc"))
def q_lonely_tables(c):
    return N.lonely_tables(c.fx.inventory(), N.nodes_with_event(c.g.objects()), c.host, c.as_of, c.days)


@register("lonely_legacy_tables", W(f"SELECT {O.NODE_COLS} FROM lonely_hms", "lonely_hms"))
def q_lonely_legacy_tables(c):
    return N.lonely_legacy_tables(c.fx.legacy(), N.nodes_with_event(c.g.objects()), c.host)


@register("nodes_union", W(f"SELECT {O.NODE_COLS} FROM nodes", "nodes"))
def q_nodes_union(c):
    nwe = N.nodes_with_event(c.g.objects())
    return N.nodes_union(nwe, N.lonely_tables(c.fx.inventory(), nwe, c.host, c.as_of, c.days),
                         N.lonely_legacy_tables(c.fx.legacy(), nwe, c.host))


@register("nodes_build", W(f"SELECT {O.NODE_COLS} FROM nodes", "nodes"))
def q_nodes_build(c):
    return c.g.nodes()


# The links are left-joined and grouped away: every node stays, once.
@register("nodes_links_left", W(f"SELECT DISTINCT {O.NODE_COLS} FROM nodes", "nodes"))
def q_nodes_links_left(c):
    return N.nodes_links_left(c.g.nodes(), c.g.links())
