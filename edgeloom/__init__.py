"""edgeloom: lineage-graph analytics as Spark DataFrame jobs.

Access events become typed node and link tables (``operators.edges``,
``operators.objects``, ``operators.links``, ``operators.nodes``), which are kept
current with guarded upserts, retention and deletion purges
(``operators.upsert``, ``operators.purge``) and queried as a graph
(``operators.degree``, ``operators.serve``, ``operators.traverse``).
Every function maps DataFrames to DataFrames; nothing is collected.
"""

__all__ = ["session", "functions", "sources", "operators", "plans"]
