"""Registered queries: traversal (search closures, levels, selections).

The seed is the most connected node over all links: the node the reference's
search opens with when no node is named.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom import oracle as O
from edgeloom.operators import degree as deg
from edgeloom.operators import traverse as TR
from edgeloom.plans.q_serve import links_api, nodes_api
from edgeloom.plans.registry import register
from edgeloom.plans.search import search_graph

W = O.with_ctes

BOUNDED_LEVEL = 3
UNKNOWN_NODE = "main.none.none"
# Level requests checked against each seed's maximum (NULL = not a number).
LEVEL_REQUESTS = (-1, 2, 99, None)


def seeds(c):
    return c.once("seeds", lambda: TR.seeds_of(deg.most_connected(c.g.links())))


def adj(c):
    """One staged adjacency per graph, shared by every traversal query."""
    if "adjacency" not in c.memo:
        c.memo["adjacency"] = TR.adjacency(links_api(c))
    return c.memo["adjacency"]


def reach(c):
    """The unbounded search from the seed, both ways: closures, levels and highlighted depths all read it."""
    if "reach" not in c.memo:
        c.memo["reach"] = TR.reach_both(links_api(c), seeds(c), adj=adj(c))
    return c.memo["reach"]


def up(c):
    return reach(c).rows(TR.UP)


def down(c):
    return reach(c).rows(TR.DOWN)


def levels(c):
    return c.once("maxlv", lambda: TR.max_levels(links_api(c), seeds(c), reach=reach(c)))


def selection(c):
    return TR.default_levels(levels(c), BOUNDED_LEVEL)


def connected(c):
    return c.once("connected", lambda: TR.connected_nodes(links_api(c), selection(c), adj=adj(c)))


@register("bfs_downstream", W("SELECT seed, node, CAST(depth AS BIGINT) AS depth FROM bfs_down", "bfs_down"))
def q_bfs_downstream(c):
    return down(c)


@register("bfs_upstream", W("SELECT seed, node, CAST(depth AS BIGINT) AS depth FROM bfs_up", "bfs_up"))
def q_bfs_upstream(c):
    return up(c)


@register("bfs_bounded", W("SELECT seed, node, CAST(depth AS BIGINT) AS depth FROM bfs_down3", "bfs_down3"))
def q_bfs_bounded(c):
    return TR.bfs(links_api(c), seeds(c), TR.DOWN, max_depth=BOUNDED_LEVEL, adj=adj(c))


@register("frontier_join", W("""
SELECT seed, node, CAST(depth AS BIGINT) AS depth FROM bfs_down WHERE depth = 1""", "bfs_down"))
def q_frontier_join(c):
    return TR.bfs(links_api(c), seeds(c), TR.DOWN, max_depth=1, adj=adj(c)).filter(F.col("depth") == 1)


@register("connected_union", W("SELECT seed, node FROM closure", "closure"))
def q_connected_union(c):
    return TR.closure(up(c), down(c))


@register("closure_semi", W(f"""
SELECT c.seed, {O.API_NODE_COLS} FROM api_nodes n JOIN closure c ON c.node = n.id""", "api_nodes", "closure"))
def q_closure_semi(c):
    return TR.closure_semi(nodes_api(c), TR.closure(up(c), down(c)))


@register("traversed_links", W(f"SELECT seed, {O.API_LINK_COLS} FROM traversed", "traversed"))
def q_traversed_links(c):
    return TR.traversed_links(links_api(c), up(c), down(c))


@register("search_graph", W(f"""
SELECT c.seed AS search_target, {O.API_NODE_COLS} FROM api_nodes n JOIN closure c ON c.node = n.id""",
                           "api_nodes", "closure"))
def q_search_graph(c):
    res = search_graph(c.g.nodes(), c.g.links(), "most_connected", "all", c.as_of, adj=adj(c))
    return res.nodes


@register("search_graph_links", W(f"SELECT seed AS search_target, {O.API_LINK_COLS} FROM traversed", "traversed"))
def q_search_graph_links(c):
    res = search_graph(c.g.nodes(), c.g.links(), "most_connected", "all", c.as_of, adj=adj(c))
    return res.links


@register("max_levels", W("SELECT seed, max_upstream, max_downstream FROM maxlv", "maxlv"))
def q_max_levels(c):
    return levels(c)


@register("default_levels", W("""
SELECT seed, CAST(up_level AS BIGINT) AS up_level, CAST(down_level AS BIGINT) AS down_level FROM sel""", "sel"))
def q_default_levels(c):
    return selection(c)


def _req_sql():
    vals = ", ".join("NULL" if v is None else str(v) for v in LEVEL_REQUESTS)
    return f"SELECT seed, unnest([{vals}]) AS r FROM maxlv"


def _clamp_sql(col, mx):
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN {col} > {mx} THEN {mx} WHEN {col} < 0 THEN 0 ELSE {col} END",
            f"CASE WHEN {col} IS NULL THEN NULL WHEN {col} > {mx} THEN 'Maximum level is ' || CAST({mx} AS VARCHAR) "
            f"WHEN {col} < 0 THEN 'Minimum level is 0' END")


_UL, _UM = _clamp_sql("q.r", "m.max_upstream")
_DL, _DM = _clamp_sql("q.r", "m.max_downstream")


@register("clamp_levels", W(f"""
SELECT q.seed, CAST(q.r AS VARCHAR) AS requested_up, CAST(q.r AS VARCHAR) AS requested_down,
       CAST({_UL} AS VARCHAR) AS up_level, {_UM} AS up_message,
       CAST({_DL} AS VARCHAR) AS down_level, {_DM} AS down_message
FROM ({_req_sql()}) q JOIN maxlv m ON m.seed = q.seed""", "maxlv"))
def q_clamp_levels(c):
    req = levels(c).select("seed", F.explode(F.array(*[F.lit(v).cast("long") for v in LEVEL_REQUESTS])).alias("r"))
    req = req.select("seed", F.col("r").alias("requested_up"), F.col("r").alias("requested_down"))
    out = TR.clamp_levels(req, levels(c))
    # Nullable integers leave as text so both engines hand the same values over.
    return out.select(*[F.col(x).cast("string").alias(x) if x in ("requested_up", "requested_down", "up_level",
                                                                   "down_level") else F.col(x)
                        for x in out.columns])


@register("connected_nodes", W("SELECT seed, node FROM connected", "connected"))
def q_connected_nodes(c):
    return connected(c)


@register("highlighted_links", W(f"SELECT seed, {O.API_LINK_COLS} FROM highlighted", "highlighted"))
def q_highlighted_links(c):
    return TR.highlighted_links(links_api(c), connected(c))


@register("induced_links", W(f"""
SELECT c1.seed, {O.API_LINK_COLS} FROM api_links l JOIN closure c1 ON c1.node = l.source
WHERE EXISTS (SELECT 1 FROM closure c2 WHERE c2.seed = c1.seed AND c2.node = l.target)""", "api_links", "closure"))
def q_induced_links(c):
    return TR.induced_links(links_api(c), TR.closure(up(c), down(c)))


@register("node_depth", W("""
SELECT p.seed, p.node, CAST(COALESCE(b.depth, 0) AS BIGINT) AS depth
FROM (SELECT seed, source AS node FROM traversed UNION SELECT seed, target FROM traversed) p
LEFT JOIN bfs_down b ON b.seed = p.seed AND b.node = p.node""", "traversed", "bfs_down"))
def q_node_depth(c):
    t = TR.traversed_links(links_api(c), up(c), down(c))
    pairs = t.select("seed", F.col("source").alias("node")).union(t.select("seed", F.col("target"))).distinct()
    return TR.node_depth(links_api(c), pairs, TR.DOWN, adj=adj(c))


@register("highlight_levels", W("""
SELECT s.seed, CAST(COALESCE(max(COALESCE(u.depth, 0)), 0) AS BIGINT) AS current_upstream,
       CAST(COALESCE(max(COALESCE(d.depth, 0)), 0) AS BIGINT) AS current_downstream
FROM seeds s LEFT JOIN highlighted h ON h.seed = s.seed
LEFT JOIN bfs_up u ON u.seed = h.seed AND u.node = h.source
LEFT JOIN bfs_down d ON d.seed = h.seed AND d.node = h.target
GROUP BY s.seed""", "seeds", "highlighted", "bfs_up", "bfs_down"))
def q_highlight_levels(c):
    return TR.highlight_levels(links_api(c), connected(c), seeds(c), reach=reach(c))


@register("selection_indicators", W("""
SELECT s.seed, CAST(s.n AS BIGINT) AS n_selected, CAST(COALESCE(h.n, 0) AS BIGINT) AS n_links,
       round(s.n * 100.0 / (SELECT count(*) FROM api_nodes), 2) AS pct_highlighted
FROM (SELECT seed, count(DISTINCT node) AS n FROM connected GROUP BY seed) s
LEFT JOIN (SELECT seed, count(*) AS n FROM highlighted GROUP BY seed) h ON h.seed = s.seed""",
                                   "connected", "highlighted", "api_nodes"))
def q_selection_indicators(c):
    return TR.selection_indicators(nodes_api(c), links_api(c), connected(c))


# ------------------------------------------------------------ named search
def _named(c):
    if "named" not in c.memo:
        seed = c.spark.range(1).select(F.lit(O.NAMED_NODE).alias("seed"))
        c.memo["named"] = TR.bfs_both(links_api(c), seed, adj=adj(c))
    return c.memo["named"]


@register("search_named_levels", W("""
SELECT u.seed, u.max_upstream, d.max_downstream, d.n_down, u.n_up FROM
 (SELECT seed, CAST(max(depth) AS BIGINT) AS max_upstream, count(*) AS n_up FROM nbfs_up GROUP BY seed) u
 JOIN (SELECT seed, CAST(max(depth) AS BIGINT) AS max_downstream, count(*) AS n_down FROM nbfs_down GROUP BY seed) d
 ON u.seed = d.seed""", "nbfs_up", "nbfs_down"))
def q_search_named_levels(c):
    up, down = _named(c)
    u = up.groupBy("seed").agg(F.max("depth").cast("long").alias("max_upstream"), F.count(F.lit(1)).alias("n_up"))
    d = down.groupBy("seed").agg(F.max("depth").cast("long").alias("max_downstream"),
                                 F.count(F.lit(1)).alias("n_down"))
    return u.join(d, "seed").select("seed", "max_upstream", "max_downstream", "n_down", "n_up")


@register("search_unknown", W(f"SELECT CAST(NULL AS VARCHAR) AS search_target, {O.API_NODE_COLS} FROM api_nodes WHERE id = '{UNKNOWN_NODE}'",
                              "api_nodes"))
def q_search_unknown(c):
    """A start node that the graph does not hold: empty lists, no error."""
    return search_graph(c.g.nodes(), c.g.links(), UNKNOWN_NODE, "all", c.as_of, adj=adj(c)).nodes


@register("search_named", W(f"""
SELECT c.seed AS search_target, {O.API_NODE_COLS} FROM api_nodes n
JOIN (SELECT seed, node FROM nbfs_up UNION SELECT seed, node FROM nbfs_down) c ON c.node = n.id""",
                           "api_nodes", "nbfs_up", "nbfs_down"))
def q_search_named(c):
    res = search_graph(c.g.nodes(), c.g.links(), O.NAMED_NODE, "all", c.as_of, adj=adj(c))
    return res.nodes


_HTTP = "strftime(last_event_date, '%a, %d %b %Y %H:%M:%S GMT')"


@register("search_export", W(f"""
SELECT 'node' AS kind, to_json(struct_pack(search_target := c.seed, id := id, name := name, type := type,
       entity_path := entity_path, days_last_interaction := CAST(days_last_interaction AS BIGINT),
       last_event_date := {_HTTP}, total_connections := CAST(total_connections AS BIGINT),
       lineage_source_table := lineage_source_table)) AS record
FROM api_nodes n JOIN closure c ON c.node = n.id
UNION ALL
SELECT 'link', to_json(struct_pack(search_target := seed, source := source, target := target,
       entity_path := entity_path, source_type := source_type, target_type := target_type,
       last_event_date := {_HTTP}, lineage_source_table := lineage_source_table))
FROM traversed
UNION ALL
SELECT 'index', to_json(struct_pack(name := name, type := type)) FROM api_nodes
UNION ALL
SELECT 'target', to_json(struct_pack(target := seed)) FROM seeds""", "api_nodes", "closure", "traversed", "seeds"))
def q_search_export(c):
    from edgeloom.sources.sinks import search_export
    res = search_graph(c.g.nodes(), c.g.links(), "most_connected", "all", c.as_of, adj=adj(c))
    return search_export(res.nodes, res.links, res.index, res.target)
