"""The scheduled jobs, end to end over catalog tables.

``graph_job``: lineage logs -> links and nodes upserted into their tables ->
retention. ``purge_job``: legacy inventory and valid ids refreshed -> assets
deleted in the audit log removed from links, then nodes -> orphan rows removed.
``validate_job``: valid ids rebuilt, nodes without one counted. What a job
stages is removed when it ends.

Table names are arguments; ``as_of`` replaces the reference's CURRENT_DATE so
a run is reproducible. Every write goes through a staging table and replaces the
partitions that change, so no table is overwritten while a plan still reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.columns import as_date, window_start
from edgeloom.operators import purge as P
from edgeloom.operators.daily import edges_of_days, refresh_days
from edgeloom.operators.degree import degree_counts, degree_delta, merge_degrees
from edgeloom.operators.upsert import LINK_KEYS, NODE_KEYS, ORDER_COL
from edgeloom.plans.build import BuildParams, GraphBuild
from edgeloom.session import stage, staging_scope
from edgeloom.sources import scans as S
from edgeloom.sources.sinks import (
    in_partitions,
    overwrite_via_staging,
    partition_column,
    recover_swap,
    replace_partitions,
    save_or_upsert,
    set_table_property,
    table_property,
    version,
)


@dataclass
class GraphTables:
    links: str
    nodes: str
    legacy_inventory: str | None = None
    valid_ids: str | None = None
    degrees: str | None = None          # kept up to date from what each run changes (operators.degree)
    edge_days: str | None = None        # partial maxima per event date (operators.daily)


def graph_job(spark: SparkSession, uc_log: str, tables: GraphTables, params: BuildParams,
              inventory: DataFrame, legacy: DataFrame, hms_log: str | None = None,
              purge_days: int | None = None) -> dict:
    """Build links and nodes from the lineage logs and upsert them; retention drops whole partitions.

    With ``tables.edge_days`` only event dates that are new or have grown are read
    from the logs; the rest comes from the stored partial maxima.
    """
    raw = S.lineage_raw_from_catalog(spark, uc_log, hms_log)
    null_safe = params.mode == "strict"
    cutoff = None if purge_days is None else window_start(as_date(params.as_of), purge_days)
    with staging_scope(spark):
        g = GraphBuild(raw, params, inventory, legacy)
        days = None
        if tables.edge_days:
            days = refresh_days(spark, raw, tables.edge_days, params.workspace, params.host, params.as_of, params.days)
            g.use_edges(edges_of_days(spark, tables.edge_days, params.as_of, params.days))
        degrees = DegreeTable(spark, tables) if tables.degrees else None
        out = {
            "links": save_or_upsert(g.links(), tables.links, LINK_KEYS, ORDER_COL, null_safe, keep_from=cutoff,
                                    watch=degrees and degrees.watch),
            "nodes": save_or_upsert(g.nodes(), tables.nodes, NODE_KEYS, ORDER_COL, null_safe, keep_from=cutoff),
        }
        if days is not None:
            out["days_read"] = days
        if degrees:
            out["degrees"] = degrees.save()
        return out


class DegreeTable:
    """The degree table of a link table during one run: signed counts of what the run replaces, merged at its end.

    The table names the version of the links it counts. Where that is not the
    links' version when the run starts (a run died in between), it is counted anew.
    """

    OF = "edgeloom.degrees_of"

    def __init__(self, spark: SparkSession, tables: GraphTables):
        self.spark, self.links, self.table, self.deltas = spark, tables.links, tables.degrees, []
        recover_swap(spark, self.links)
        there = spark.catalog.tableExists(self.table) and spark.catalog.tableExists(self.links)
        self.current = there and table_property(spark, self.table, self.OF) == version(spark, self.links)

    def watch(self, before: DataFrame, after: DataFrame) -> None:
        """Called before rows are replaced."""
        if self.current:
            self.deltas.append(stage(degree_delta(before, after)))

    def save(self) -> str:
        """``kept`` (nothing changed), ``merged`` or ``counted`` (anew)."""
        how = "counted"
        if self.current:
            how = "merged" if self.deltas else "kept"
            if self.deltas:
                overwrite_via_staging(merge_degrees(self.spark.table(self.table), self.deltas), self.table)
        else:
            overwrite_via_staging(degree_counts(self.spark.table(self.links)), self.table)
        set_table_property(self.spark, self.table, self.OF, version(self.spark, self.links))
        return how


def validate_job(spark: SparkSession, tables: GraphTables, inventory: DataFrame, legacy_source: DataFrame) -> dict:
    """Rebuild the valid ids and count the nodes that have none."""
    with staging_scope(spark):
        ids = S.valid_table_ids(inventory, S.legacy_inventory(legacy_source))
        if tables.valid_ids:
            overwrite_via_staging(ids, tables.valid_ids)
            ids = spark.table(tables.valid_ids)
        else:
            ids = stage(ids)
        bad = P.non_compliant_nodes(spark.table(tables.nodes), ids)
        return {"valid_ids": ids.count(), "non_compliant": bad.count()}


def purge_job(spark: SparkSession, audit: DataFrame, tables: GraphTables, params: BuildParams,
              inventory: DataFrame, legacy_source: DataFrame) -> dict:
    """Remove deleted assets and orphans from the link and node tables.

    Links go first: the deletion hits are computed from the node table as it
    was before this job, and staged once so both merge-deletes use the same set.
    """
    with staging_scope(spark):
        return _purge(spark, audit, tables, params, inventory, legacy_source)


def _purge(spark, audit, tables, params, inventory, legacy_source) -> dict:
    legacy = S.legacy_inventory(legacy_source)
    if tables.legacy_inventory:
        overwrite_via_staging(legacy, tables.legacy_inventory)
        legacy = spark.table(tables.legacy_inventory)
    ids = S.valid_table_ids(inventory, legacy)
    if tables.valid_ids:
        overwrite_via_staging(ids, tables.valid_ids)
        ids = spark.table(tables.valid_ids)
    else:
        ids = stage(ids)
    recover_swap(spark, tables.links)
    recover_swap(spark, tables.nodes)
    nodes, links = spark.table(tables.nodes), spark.table(tables.links)
    facts = P.id_facts(ids)                              # once for links and nodes
    dels = P.deletions(S.audit_scan(audit), params.host, params.as_of, params.days, params.mode)
    hits = stage(P.deleted_entities(nodes, dels, params.mode, counted=True))
    degrees = DegreeTable(spark, tables) if tables.degrees else None
    out = {
        "links": _delete(spark, tables.links, lambda df: P.match_deleted_links(
            P.flag_orphans(df, ids, P.LINK_ENDS, params.mode, facts), hits), degrees and degrees.watch),
        "nodes": _delete(spark, tables.nodes, lambda df: P.merge_delete_nodes(
            P.flag_orphans(df, ids, P.NODE_ENDS, params.mode, facts), hits)),
    }
    if degrees:
        out["degrees"] = degrees.save()
    return out


def _delete(spark: SparkSession, table: str, flagged, watch=None) -> dict:
    """Delete rows of a table; only the partitions that lose some are written again.

    ``flagged``: rows that the merge-delete leaves, with ``_orphan``. It runs once
    over the table, for the counts by date (as many rows as there are partitions),
    and once over the partitions that change.
    """
    read, by = version(spark, table), partition_column(spark, table)
    before = spark.table(table)
    date = F.col(by).cast("string").alias("date")
    left = flagged(before).groupBy(date).agg(F.count(F.lit(1)).alias("left"), F.count(F.when(F.col("_orphan"), 1)).alias("orphan"))
    counts = (before.groupBy(date).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("date", "at")
              .join(left, F.col("at").eqNullSafe(F.col("date")), "left").fillna(0, ["left", "orphan"]).collect())
    changed = [r["at"] for r in counts if r["left"] - r["orphan"] < r["n"]]
    part = before.filter(in_partitions(by, changed))
    replace_partitions(spark, table, flagged(part).filter(~F.col("_orphan")).select(*before.columns), changed, read, watch)
    merge, orphan = sum(r["n"] - r["left"] for r in counts), sum(r["orphan"] for r in counts)
    return {"table": table.rpartition(".")[2], "merge_deleted": merge, "orphan_deleted": orphan, "total_deleted": merge + orphan,
            "partitions_written": len(changed)}
