"""Edges from partial maxima kept per event date.

The latest event time per edge key is a maximum, and a maximum of maxima: each
event date's own maxima are stored once, and a window of dates is a grouped
maximum over them. A run reads from the log only the dates that are new or have
grown since (events may arrive late for an old date; the log only ever grows),
and writes only those partitions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.columns import window_start
from edgeloom.operators.edges import edge_events_max, edges_union, filter_events
from edgeloom.sources.sinks import (
    create_table,
    in_partitions,
    recover_swap,
    replace_partitions,
    set_table_property,
    table_property,
    version,
)

DATE = "event_date"
_SEEN = "edgeloom.events_by_date"


def events_by_date(raw: DataFrame, as_of, days: int) -> dict:
    """Events of each date of the window: one row per date reaches the driver."""
    rows = (raw.filter(F.col(DATE) >= window_start(as_of, days)).groupBy(F.col(DATE).cast("string").alias("d"))
            .agg(F.count(F.lit(1)).alias("n")).collect())
    return {r["d"]: r["n"] for r in rows}


def refresh_days(spark: SparkSession, raw: DataFrame, table: str, workspace: str, host: str, as_of, days: int) -> list[str]:
    """Bring the table of day maxima up to date and return the dates that were read.

    A date is read when its number of events differs from the number it had when
    it was stored (none, for a new date). The numbers are kept with the table,
    and with the version they belong to: after a run that died between the two,
    every date is read again.
    """
    recover_swap(spark, table)
    now = events_by_date(raw, as_of, days)
    there = spark.catalog.tableExists(table)
    kept = json.loads(table_property(spark, table, _SEEN) or "{}") if there else {}
    known = kept.get("dates", {}) if there and kept.get("version") == version(spark, table) and kept.get("of") == [workspace, host] else {}
    changed = sorted(d for d, n in now.items() if known.get(d) != n)
    if changed or not there:
        events = filter_events(raw.filter(in_partitions(DATE, changed)), workspace, as_of, days)
        rows = edge_events_max(events, host, DATE)
        if there:
            replace_partitions(spark, table, rows, changed, version(spark, table))
        else:
            create_table(rows, table, DATE)
        state = {"dates": known | now, "version": version(spark, table), "of": [workspace, host]}
        set_table_property(spark, table, _SEEN, json.dumps(state))
    return changed


def edges_of_days(spark: SparkSession, table: str, as_of, days: int) -> DataFrame:
    """Edges of the window from the stored maxima: dates out of the window are not read (partition filter)."""
    part = spark.table(table).filter(F.col(DATE) >= window_start(as_of, days))
    keys = [c for c in part.columns if c not in (DATE, "last_event_time")]
    return edges_union(part.groupBy(*keys).agg(F.max("last_event_time").alias("last_event_time")))
