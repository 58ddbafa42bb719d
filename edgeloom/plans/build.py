"""Graph build job: lineage log -> edges -> objects -> links, nodes.

Each stage is read more than once downstream (objects feed both link joins and
the nodes; links feed degrees, traversal and purges), so a job run stages them
into the checkpoint folder instead of letting every consumer recompute the
whole chain from the event log.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from edgeloom.operators.edges import build_edges
from edgeloom.operators.links import break_two_cycles, links_raw
from edgeloom.operators.nodes import build_nodes
from edgeloom.operators.objects import objects_union
from edgeloom.session import stage as _stage


@dataclass
class BuildParams:
    workspace: str
    host: str
    as_of: object
    days: int
    mode: str = "reference"


@dataclass
class GraphBuild:
    """Lazily built, optionally staged graph stages of one job run."""

    raw: DataFrame
    params: BuildParams
    inventory: DataFrame | None = None
    legacy: DataFrame | None = None
    materialize: bool = True
    _cache: dict = field(default_factory=dict)

    def _get(self, name, make):
        if name not in self._cache:
            df = make()
            self._cache[name] = _stage(df) if self.materialize else df
        return self._cache[name]

    def use_edges(self, edges: DataFrame) -> None:
        """Take the edges from elsewhere (the stored partial maxima) instead of the raw log."""
        self._cache["edges"] = _stage(edges) if self.materialize else edges

    def edges(self) -> DataFrame:
        p = self.params
        return self._get("edges", lambda: build_edges(self.raw, p.workspace, p.host, p.as_of, p.days))

    def objects(self) -> DataFrame:
        return self._get("objects", lambda: objects_union(self.edges(), self.params.host))

    def links_raw(self) -> DataFrame:
        return links_raw(self.edges(), self.objects(), sources_known=True)      # the objects are these edges' ends

    def links(self) -> DataFrame:
        return self._get("links", lambda: break_two_cycles(self.links_raw(), self.params.mode))

    def nodes(self) -> DataFrame:
        p = self.params
        return self._get("nodes", lambda: build_nodes(self.objects(), self.inventory, self.legacy, p.host,
                                                      p.as_of, p.days))
