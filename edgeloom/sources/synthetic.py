"""Synthetic DAG for UI and load tests (no platform tables needed).

``n`` nodes; every node ``i < n-1`` links to one node picked at random among
the later ones, so the graph is acyclic. Built on ``spark.range`` with hash-based
picks: deterministic for a seed and generated in parallel on executors.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type labels and constant attributes of the fake graph.
TYPES = ("Job", "Notebook", "Table", "Dashboard", "Dataset")
DAYS_LAST_INTERACTION = 252
ENTITY_PATH = "https://google.com"
LAST_EVENT_DATE = "Mon, 18 Mar 2024 00:00:00 GMT"
TOTAL_CONNECTIONS = 25
NAME_LENGTH = 5
LETTERS = string.ascii_letters


def _pick(seed: int, salt: str, i, mod) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), mod)


def synthetic_dag(spark: SparkSession, n: int = 1000, seed: int = 0,
                  id_prefix: str = "node_") -> tuple[DataFrame, DataFrame]:
    """``(nodes, links)`` of a random DAG with ``n`` nodes and ``n-1`` links."""
    i = F.col("id")
    letters = F.lit(LETTERS)
    name = F.concat(*[F.substring(letters, (_pick(seed, f"c{k}", i, len(LETTERS)) + 1).cast("int"), 1)
                      for k in range(NAME_LENGTH)])
    types = F.array(*[F.lit(t) for t in TYPES])
    nodes = spark.range(n).select(
        F.concat(F.lit(id_prefix), i.cast("string")).alias("id"),
        name.alias("name"),
        F.element_at(types, (_pick(seed, "type", i, len(TYPES)) + 1).cast("int")).alias("type"),
        F.lit(DAYS_LAST_INTERACTION).cast("long").alias("days_last_interaction"),
        F.lit(ENTITY_PATH).alias("entity_path"),
        F.lit(LAST_EVENT_DATE).alias("last_event_date"),
        F.lit(TOTAL_CONNECTIONS).cast("long").alias("total_connections"),
    )
    later = F.lit(n - 1) - i
    target = i + 1 + _pick(seed, "link", i, later)
    links = (spark.range(max(n - 1, 0))
             .select(F.concat(F.lit(id_prefix), i.cast("string")).alias("source"),
                     F.concat(F.lit(id_prefix), target.cast("string")).alias("target")))
    return nodes, links
