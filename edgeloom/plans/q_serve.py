"""Registered queries: what the graph API serves (projections, search helpers,
visibility, indicators)."""

from __future__ import annotations

from edgeloom import oracle as O
from edgeloom.operators import serve as SV
from edgeloom.operators import traverse as TR
from edgeloom.plans.registry import register

W = O.with_ctes

SUGGEST_TEXT = "s1.t1"
FIND_LABEL = "main.s0.t0 (TABLE/VIEW/PATH)"
HIDDEN_TYPES = ("DASHBOARD", "QUERY")


def nodes_api(c, source="all"):
    return c.once(f"api_nodes:{source}", lambda: SV.api_nodes(c.g.nodes(), c.g.links(), source, c.as_of),
                  stage=False)


def links_api(c, source="all"):
    return SV.api_links(c.g.links(), source)


@register("api_nodes", W(f"SELECT {O.API_NODE_COLS} FROM api_nodes", "api_nodes"))
def q_api_nodes(c):
    return nodes_api(c)


@register("node_degree_join", W(f"SELECT {O.API_NODE_COLS} FROM api_nodes", "api_nodes"))
def q_node_degree_join(c):
    return nodes_api(c)


@register("api_links", W(f"SELECT {O.API_LINK_COLS} FROM api_links", "api_links"))
def q_api_links(c):
    return links_api(c)


@register("lineage_source_filter", W(f"""
SELECT {O.API_LINK_COLS} FROM api_links WHERE lineage_source_table = 'hms_table_lineage'""", "api_links"))
def q_lineage_source_filter(c):
    return links_api(c, "hms_table_lineage")


@register("full_graph", W(f"""
SELECT {O.API_NODE_COLS} FROM api_nodes WHERE lineage_source_table = 'table_lineage'""", "api_nodes"))
def q_full_graph(c):
    return nodes_api(c, "table_lineage")


@register("full_graph_links", W(f"""
SELECT {O.API_LINK_COLS} FROM api_links WHERE lineage_source_table = 'table_lineage'""", "api_links"))
def q_full_graph_links(c):
    return links_api(c, "table_lineage")


@register("node_index", W("SELECT name, type FROM api_nodes", "api_nodes"))
def q_node_index(c):
    return SV.node_index(nodes_api(c))


@register("suggest", W(f"""
SELECT name, type FROM api_nodes
WHERE contains(lower(name), '{SUGGEST_TEXT}') OR contains(lower(type), '{SUGGEST_TEXT}')
ORDER BY name ASC NULLS LAST, type ASC NULLS LAST LIMIT 5""", "api_nodes"))
def q_suggest(c):
    return SV.suggest(SV.node_index(nodes_api(c)), SUGGEST_TEXT)


@register("suggest_indexed", W(f"""
SELECT name, type FROM api_nodes
WHERE contains(lower(name), '{SUGGEST_TEXT}') OR contains(lower(type), '{SUGGEST_TEXT}')
ORDER BY name ASC NULLS LAST, type ASC NULLS LAST LIMIT 5""", "api_nodes"))
def q_suggest_indexed(c):
    """The same entries from the trigram index of the names."""
    if "names" not in c.memo:
        c.memo["names"] = SV.name_index(SV.node_index(nodes_api(c)))
    return SV.suggest_from(c.memo["names"], SUGGEST_TEXT)


@register("find_node", W(f"""
SELECT name, type FROM api_nodes WHERE name || ' (' || type || ')' = '{FIND_LABEL}'""", "api_nodes"))
def q_find_node(c):
    return SV.find_node(SV.node_index(nodes_api(c)), FIND_LABEL)


@register("node_types", W("SELECT DISTINCT type FROM api_nodes", "api_nodes"))
def q_node_types(c):
    return SV.node_types(nodes_api(c))


@register("graph_indicators", W("""
SELECT (SELECT count(*) FROM api_nodes) AS n_nodes, (SELECT count(*) FROM api_links) AS n_links,
       CAST(0.0 AS DOUBLE) AS pct_highlighted""", "api_nodes", "api_links"))
def q_graph_indicators(c):
    return SV.graph_indicators(nodes_api(c), links_api(c))


def _hidden_sql(col):
    return f"({col} NOT IN ({', '.join(repr(t) for t in HIDDEN_TYPES)}) OR {col} IS NULL)"


@register("visible_nodes", W(f"""
SELECT {O.API_NODE_COLS} FROM api_nodes n
WHERE {_hidden_sql('type')} AND EXISTS (SELECT 1 FROM connected c WHERE c.node = n.id)""",
                             "api_nodes", "connected"))
def q_visible_nodes(c):
    from edgeloom.plans.q_graph import connected
    return SV.visible_nodes(nodes_api(c), HIDDEN_TYPES, connected(c).select("node"), hide_unselected=True)


@register("visible_links", W(f"""
SELECT {O.API_LINK_COLS} FROM api_links l
WHERE {_hidden_sql('source_type')} AND {_hidden_sql('target_type')}
  AND EXISTS (SELECT 1 FROM connected c WHERE c.node = l.source)
  AND EXISTS (SELECT 1 FROM connected c WHERE c.node = l.target)""", "api_links", "connected"))
def q_visible_links(c):
    from edgeloom.plans.q_graph import connected
    return SV.visible_links(links_api(c), HIDDEN_TYPES, connected(c).select("node"), hide_unselected=True)


@register("visible_types_only", W(f"""
SELECT {O.API_NODE_COLS} FROM api_nodes WHERE {_hidden_sql('type')}""", "api_nodes"))
def q_visible_types_only(c):
    return SV.visible_nodes(nodes_api(c), HIDDEN_TYPES)


__all__ = ["nodes_api", "links_api", "TR"]


_HTTP = "strftime(last_event_date, '%a, %d %b %Y %H:%M:%S GMT')"


@register("graph_export", W(f"""
SELECT 'node' AS kind, to_json(struct_pack(id := id, name := name, type := type, entity_path := entity_path,
       days_last_interaction := CAST(days_last_interaction AS BIGINT), last_event_date := {_HTTP},
       total_connections := CAST(total_connections AS BIGINT), lineage_source_table := lineage_source_table)) AS record
FROM api_nodes
UNION ALL
SELECT 'link', to_json(struct_pack(source := source, target := target, entity_path := entity_path,
       source_type := source_type, target_type := target_type, last_event_date := {_HTTP},
       lineage_source_table := lineage_source_table))
FROM api_links""", "api_nodes", "api_links"))
def q_graph_export(c):
    from edgeloom.sources.sinks import graph_export
    return graph_export(nodes_api(c), links_api(c))
