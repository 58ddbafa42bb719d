"""Edges + objects -> links, then two-cycle removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.columns import undirected_pair_key

LINK_COLUMNS = ("source_node", "source_node_type", "target_node", "target_node_type", "entity_path",
                "last_event_date", "lineage_source_table")


def join_edges_source(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges whose source is a known object.

    The reference joins the source object only to group its columns away again,
    so the join is an existence test: a semi join gives the same rows without
    fanning out over the object's URL and tag variants.
    """
    src = objects.select(F.col("node").alias("source_object"), F.col("node_type").alias("source_type"))
    return edges.join(src, ["source_object", "source_type"], "left_semi")


def join_edges_target(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges with every object row of their target (fans out over URL and tag)."""
    tgt = objects.select(F.col("node").alias("target_object"), F.col("node_type").alias("target_type"),
                         F.col("entity_path").alias("target_entity_path"))
    return edges.join(tgt, ["target_object", "target_type"], "inner")


def links_raw(edges: DataFrame, objects: DataFrame, sources_known: bool = False) -> DataFrame:
    """Date of the latest event per link; the link's URL is its target object's.

    Edges are first reduced to one row per (source, target, tag), which combines
    map-side; the join then meets each target's distinct URLs only and needs no
    aggregate after it. ``sources_known``: the objects come from these edges, so
    every source is one of them and the existence test is left out.
    """
    kept = edges if sources_known else join_edges_source(edges, objects)
    latest = (kept.groupBy(F.col("source_object").alias("source_node"), F.col("source_type").alias("source_node_type"),
                           F.col("target_object").alias("target_node"), F.col("target_type").alias("target_node_type"),
                           "lineage_source_table")
              .agg(F.to_date(F.max("last_event_time")).alias("last_event_date")))
    urls = objects.select(F.col("node").alias("target_node"), F.col("node_type").alias("target_node_type"), "entity_path").distinct()
    return latest.join(urls, ["target_node", "target_node_type"]).select(*LINK_COLUMNS)


# Total order that picks the surviving link of an unordered pair: the earliest
# date first, then names, tag, URL and types (NULLs first, as Spark sorts them).
_TIE_ORDER = ("last_event_date", "source_node", "target_node", "lineage_source_table", "entity_path",
              "source_node_type", "target_node_type")


def break_two_cycles(links: DataFrame, mode: str = "reference") -> DataFrame:
    """Keep one link per unordered node pair: the one with the earliest date.

    Written as ``min(struct(order columns))`` per pair instead of a
    ``row_number`` window: the aggregate combines map-side, so a pair key that
    holds a large share of the rows never lands in one task. The struct holds
    every link column, so its minimum is the first row under ``_TIE_ORDER``.
    The follow-up ``dropDuplicates`` of the reference is implied (one row per key).
    """
    key_cols = undirected_pair_key("source_node", "target_node", mode)
    keyed = links.select(*[c.alias(f"_k{i}") for i, c in enumerate(key_cols)],
                         F.struct(*_TIE_ORDER).alias("_row"))
    return (keyed.groupBy(*[f"_k{i}" for i in range(len(key_cols))])
            .agg(F.min("_row").alias("_row"))
            .select(*[F.col(f"_row.{c}").alias(c) for c in LINK_COLUMNS]))


def build_links(edges: DataFrame, objects: DataFrame, mode: str = "reference", sources_known: bool = False) -> DataFrame:
    return break_two_cycles(links_raw(edges, objects, sources_known), mode)
