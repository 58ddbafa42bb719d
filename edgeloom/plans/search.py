"""Search payload: the closure of one node (or of the most connected node).

The reference answers this by pulling all nodes and links into one web
process and scanning every link per visited node. Here it is one DataFrame
flow: the start node is a one-row DataFrame (never collected), both
breadth-first searches run on Spark, and the payload is four DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.constants import SUGGESTIONS
from edgeloom.operators import traverse as TR
from edgeloom.operators.degree import most_connected
from edgeloom.operators.serve import NameIndex, api_links, api_nodes, by_source, name_index, node_index, suggest_from

MOST_CONNECTED = "most_connected"


@dataclass
class SearchResult:
    nodes: DataFrame   # served node rows in the closure, with the ``search_target`` they belong to
    links: DataFrame   # traversed links, one per (search_target, source, target) triple
    index: DataFrame   # ``{name, type}`` of every served node
    target: DataFrame  # one row: the start node


def search_graph(nodes: DataFrame, links: DataFrame, node_id: str, source: str | None, as_of,
                 mode: str = "reference", adj: TR.Adjacency | None = None) -> SearchResult:
    """Payload for ``node_id`` (or the most connected node) under a source filter.

    An unknown start node, or an empty graph with ``most_connected``, gives
    empty node and link lists instead of an error. ``adj``: a prebuilt
    :func:`edgeloom.operators.traverse.adjacency` of the filtered links, shared
    by many searches of one graph.
    """
    na = api_nodes(nodes, links, source, as_of, mode)
    la = api_links(links, source)
    if node_id == MOST_CONNECTED:
        target = TR.seeds_of(most_connected(by_source(links, source), mode))
    else:
        target = links.sparkSession.range(1).select(F.lit(node_id).cast("string").alias("seed"))
    up, down = TR.bfs_both(la, target, adj=adj)
    cl = TR.closure(up, down)
    out_nodes = (na.join(cl.select(F.col("seed").alias("search_target"), F.col("node").alias("id")), "id")
                 .select("search_target", *na.columns))
    out_links = TR.traversed_links(la, up, down).withColumnRenamed("seed", "search_target")
    return SearchResult(out_nodes, out_links, node_index(na), target.withColumnRenamed("seed", "search_target"))


def full_graph(nodes: DataFrame, links: DataFrame, source: str | None, as_of,
               mode: str = "reference") -> tuple[DataFrame, DataFrame]:
    """All served nodes and links for one source filter."""
    return api_nodes(nodes, links, source, as_of, mode), api_links(links, source)


@dataclass
class GraphIndex:
    """One graph prepared for many questions, as the served app uses it.

    ``build`` stages the served node and link frames and the traversal
    adjacency once; every search, suggestion or selection afterwards reads
    them, so a question costs only its own BFS jobs and joins.
    """

    nodes: DataFrame   # served nodes (api_nodes) for the source filter
    links: DataFrame   # served links (api_links) for the source filter
    adj: TR.Adjacency
    source: str | None
    mode: str = "reference"
    names: NameIndex | None = None

    @classmethod
    def build(cls, nodes: DataFrame, links: DataFrame, source: str | None, as_of,
              mode: str = "reference") -> GraphIndex:
        from edgeloom.session import stage
        na = stage(api_nodes(nodes, links, source, as_of, mode))
        la = stage(api_links(links, source))
        return cls(na, la, TR.adjacency(la), source, mode)

    def most_connected(self) -> DataFrame:
        """The start node of a default search (degree over the filtered links)."""
        renamed = self.links.select(F.col("source").alias("source_node"), F.col("target").alias("target_node"))
        return TR.seeds_of(most_connected(renamed, self.mode))

    def search_many(self, seeds: DataFrame) -> SearchResult:
        """Search payloads for many start nodes at once (column ``seed``)."""
        up, down = TR.bfs_both(self.links, seeds, adj=self.adj)
        cl = TR.closure(up, down)
        out_nodes = (self.nodes.join(cl.select(F.col("seed").alias("search_target"), F.col("node").alias("id")),
                                     "id")
                     .select("search_target", *self.nodes.columns))
        out_links = TR.traversed_links(self.links, up, down).withColumnRenamed("seed", "search_target")
        return SearchResult(out_nodes, out_links, node_index(self.nodes), seeds.withColumnRenamed("seed",
                                                                                                  "search_target"))

    def search(self, node_id: str) -> SearchResult:
        """Payload for one node, or for the most connected node with ``most_connected``."""
        if node_id == MOST_CONNECTED:
            seeds = self.most_connected()
        else:
            seeds = self.links.sparkSession.range(1).select(F.lit(node_id).cast("string").alias("seed"))
        return self.search_many(seeds)

    def suggest(self, text: str, n: int = SUGGESTIONS) -> DataFrame:
        """Search-box entries; the index of names is staged with the first text."""
        if self.names is None:
            self.names = name_index(node_index(self.nodes))
        return suggest_from(self.names, text, n)

    def levels(self, seeds: DataFrame) -> DataFrame:
        return TR.max_levels(self.links, seeds, adj=self.adj)

    def depth(self, pairs: DataFrame, direction: str) -> DataFrame:
        """Hops from ``seed`` to ``node`` of each pair (0: unreachable), searched from both ends."""
        return TR.node_depth(self.links, pairs, direction, adj=self.adj)

    def selection(self, seeds: DataFrame, up_level=None, down_level=None) -> dict:
        """What selecting nodes shows: default (or given) levels, the connected
        set, its highlighted links and the indicators."""
        lv = TR.default_levels(self.levels(seeds))
        if up_level is not None or down_level is not None:
            req = seeds.select("seed", F.lit(up_level).cast("long").alias("requested_up"),
                               F.lit(down_level).cast("long").alias("requested_down"))
            lv = TR.clamp_levels(req, self.levels(seeds)).select("seed", "up_level", "down_level")
        connected = TR.connected_nodes(self.links, lv, adj=self.adj)
        return {
            "levels": lv,
            "connected": connected,
            "highlighted_links": TR.highlighted_links(self.links, connected),
            "indicators": TR.selection_indicators(self.nodes, self.links, connected),
        }
