"""Registered queries on a graph that grows with the tables, from many seeds, and
searches under a source filter.

The links are the users of ``events``: each event is a step from its user to one
of the next users or, one event in three, to the hub, and one event in five is a
step from the hub back to its user. Users, links and seeds all grow with the
table. The hub holds a third of the links, and every search goes through it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom import oracle as O
from edgeloom.operators import degree as deg
from edgeloom.operators import traverse as TR
from edgeloom.operators.serve import by_source
from edgeloom.plans.registry import register
from edgeloom.plans.search import search_graph

W = O.with_ctes
TAG = "table_lineage"

O._cte("walk", """
SELECT DISTINCT 'n' || user_id AS source,
       CASE WHEN event_id % 3 = 0 THEN 'hub' ELSE 'n' || (user_id + 1 + event_id % 7) END AS target FROM events
UNION SELECT 'hub', 'n' || user_id FROM events WHERE event_id % 5 = 0
""")
O._cte("walk_down", "SELECT source AS a, target AS b FROM walk", "walk")
O._cte("walk_up", "SELECT target AS a, source AS b FROM walk", "walk")
O._cte("walk_seeds", "SELECT DISTINCT 'n' || user_id AS seed FROM events WHERE user_id % 20 = 0")
O._bfs_cte("walk_all_down", "walk_down", "walk_seeds")
O._bfs_cte("walk_all_up", "walk_up", "walk_seeds")

O._cte("tag_links", f"SELECT * FROM api_links WHERE lineage_source_table = '{TAG}'", "api_links")
O._cte("tag_down", "SELECT DISTINCT source AS a, target AS b FROM tag_links WHERE source IS NOT NULL AND target IS NOT NULL", "tag_links")
O._cte("tag_up", "SELECT b AS a, a AS b FROM tag_down", "tag_down")
O._cte("tag_degree", O._COUNTS.format(total="if(n_out = n_in, n_out, n_out + n_in)").replace(
    "FROM links)", f"FROM links WHERE lineage_source_table = '{TAG}')"), "links")
O._cte("tag_seeds", "SELECT id AS seed FROM tag_degree ORDER BY total_connections DESC, id ASC NULLS LAST LIMIT 1", "tag_degree")
O._bfs_cte("tag_bfs_down", "tag_down", "tag_seeds")
O._bfs_cte("tag_bfs_up", "tag_up", "tag_seeds")


def walk(c):
    user, eid = F.concat(F.lit("n"), F.col("user_id").cast("string")), F.col("event_id")
    to = F.when(eid % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("n"), (F.col("user_id") + 1 + eid % 7).cast("string")))
    steps = F.array_compact(F.array(F.struct(user.alias("source"), to.alias("target")),
                                    F.when(eid % 5 == 0, F.struct(F.lit("hub").alias("source"), user.alias("target")))))
    return c.once("walk", lambda: c.fx.table("events").select(F.inline(steps)).distinct())


def walk_adj(c):
    if "walk_adj" not in c.memo:
        c.memo["walk_adj"] = TR.adjacency(walk(c))
    return c.memo["walk_adj"]


def walk_seeds(c):
    return (c.fx.table("events").filter(F.col("user_id") % 20 == 0)
            .select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("seed")).distinct())


def walk_reach(c):
    if "walk_reach" not in c.memo:
        c.memo["walk_reach"] = TR.reach_both(walk(c), walk_seeds(c), adj=walk_adj(c))
    return c.memo["walk_reach"]


_ROWS = "SELECT seed, node, CAST(depth AS BIGINT) AS depth FROM {t} {where}"


@register("many_seeds_downstream", W(_ROWS.format(t="walk_all_down", where=""), "walk_all_down"))
def q_many_seeds_downstream(c):
    return walk_reach(c).rows(TR.DOWN)


@register("many_seeds_upstream", W(_ROWS.format(t="walk_all_up", where=""), "walk_all_up"))
def q_many_seeds_upstream(c):
    return walk_reach(c).rows(TR.UP)


@register("many_seeds_frontier", W(_ROWS.format(t="walk_all_down", where="WHERE depth = 1"), "walk_all_down"))
def q_many_seeds_frontier(c):
    return TR.bfs(walk(c), walk_seeds(c), TR.DOWN, max_depth=1, adj=walk_adj(c)).filter(F.col("depth") == 1)


@register("many_seeds_closure", W("SELECT seed, node FROM walk_all_up UNION SELECT seed, node FROM walk_all_down",
                                  "walk_all_up", "walk_all_down"))
def q_many_seeds_closure(c):
    return TR.closure(reach=walk_reach(c))


@register("many_seeds_levels", W("""
SELECT seed, CAST(max(u) AS BIGINT) AS max_upstream, CAST(max(d) AS BIGINT) AS max_downstream
FROM (SELECT seed, depth AS u, 0 AS d FROM walk_all_up UNION ALL SELECT seed, 0, depth FROM walk_all_down) GROUP BY seed""",
                                 "walk_all_up", "walk_all_down"))
def q_many_seeds_levels(c):
    return TR.max_levels(walk(c), walk_seeds(c), reach=walk_reach(c))


@register("many_pairs_depth", W("""
SELECT p.seed, 'hub' AS node, CAST(COALESCE(d.depth, 0) AS BIGINT) AS depth FROM walk_seeds p
LEFT JOIN walk_all_down d ON d.seed = p.seed AND d.node = 'hub'
UNION ALL
SELECT 'hub', p.seed, CAST(COALESCE(d.depth, 0) AS BIGINT) FROM walk_seeds p
LEFT JOIN walk_all_up d ON d.seed = p.seed AND d.node = 'hub'""", "walk_seeds", "walk_all_down", "walk_all_up"))
def q_many_pairs_depth(c):
    """Hops from every seed to the hub and from the hub to every seed, searched from both ends."""
    s, hub = walk_seeds(c), F.lit("hub")
    pairs = s.select("seed", hub.alias("node")).unionByName(s.select(hub.alias("seed"), F.col("seed").alias("node")))
    return TR.node_depth(walk(c), pairs, TR.DOWN, adj=walk_adj(c))


@register("most_connected_filtered", W("""
SELECT id, total_connections FROM tag_degree ORDER BY total_connections DESC, id ASC NULLS LAST LIMIT 1""", "tag_degree"))
def q_most_connected_filtered(c):
    return deg.most_connected(by_source(c.g.links(), TAG))


@register("search_graph_filtered", W(f"""
SELECT reached.seed AS search_target, {O.API_NODE_COLS}
FROM (SELECT seed, node AS id FROM tag_bfs_up UNION SELECT seed, node FROM tag_bfs_down) reached
JOIN (SELECT * FROM api_nodes WHERE lineage_source_table = '{TAG}') served USING (id)""",
                                     "api_nodes", "tag_bfs_up", "tag_bfs_down"))
def q_search_graph_filtered(c):
    return search_graph(c.g.nodes(), c.g.links(), "most_connected", TAG, c.as_of).nodes


O._bfs_cte("named_tag_down", "tag_down", "seeds_named")
O._bfs_cte("named_tag_up", "tag_up", "seeds_named")


@register("search_named_filtered", W(f"""
SELECT reached.seed AS search_target, {O.API_NODE_COLS}
FROM (SELECT seed, node AS id FROM named_tag_up UNION SELECT seed, node FROM named_tag_down) reached
JOIN (SELECT * FROM api_nodes WHERE lineage_source_table = '{TAG}') served USING (id)""",
                                    "api_nodes", "named_tag_up", "named_tag_down"))
def q_search_named_filtered(c):
    """The search opened with a node's name while one lineage source is selected."""
    return search_graph(c.g.nodes(), c.g.links(), O.NAMED_NODE, TAG, c.as_of).nodes
