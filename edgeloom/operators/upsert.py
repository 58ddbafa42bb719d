"""Date-guarded upsert (the reference's MERGE) and retention.

MERGE semantics kept: keys compared with ``=`` (a NULL key never matches, so
such a row is inserted again on every run); a matched target row takes the
source row only if ``target.date <= source.date`` (a NULL date fails the test
and the target row stays); unmatched source rows are inserted; target rows
without a match stay.

Written as one full outer join on the keys; each output row carries the
action it came from, so the merged frame and its metrics come from the same
plan. Both inputs are unique on the keys in normal use, so the join has no
hot key however the data is distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.columns import as_date, window_start

LINK_KEYS = ["source_node", "source_node_type", "target_node", "target_node_type", "entity_path",
             "lineage_source_table"]
NODE_KEYS = ["node", "node_type", "entity_path", "lineage_source_table"]
ORDER_COL = "last_event_date"


def _eq(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def tagged_merge(target: DataFrame, source: DataFrame, keys: list[str], order_col: str = ORDER_COL,
                 null_safe: bool = False) -> DataFrame:
    """Merged rows plus ``action``: inserted, updated, unchanged (matched, guard
    false) or kept (target only)."""
    cols = target.columns
    t = target.select(*[F.col(k).alias(f"_tk{i}") for i, k in enumerate(keys)], F.struct(*cols).alias("_t"))
    s = source.select(*[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)],
                      F.struct(*[F.col(c) for c in cols]).alias("_s"))
    cond = None
    for i in range(len(keys)):
        c = _eq(F.col(f"_tk{i}"), F.col(f"_sk{i}"), null_safe)
        cond = c if cond is None else cond & c
    j = t.join(s, cond, "full_outer")
    has_t, has_s = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    newer = F.coalesce(F.col(f"_t.{order_col}") <= F.col(f"_s.{order_col}"), F.lit(False))
    action = (F.when(~has_t, F.lit("inserted")).when(~has_s, F.lit("kept"))
              .when(newer, F.lit("updated")).otherwise(F.lit("unchanged")))
    row = F.when(~has_t | (has_s & newer), F.col("_s")).otherwise(F.col("_t"))
    return j.select(row.alias("_r"), action.alias("action")).select(
        *[F.col(f"_r.{c}").alias(c) for c in cols], "action")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order_col: str = ORDER_COL,
           null_safe: bool = False) -> DataFrame:
    """The target after the merge (``null_safe=True`` is the strict mode)."""
    return tagged_merge(target, source, keys, order_col, null_safe).drop("action")


def changed_rows(target: DataFrame, source: DataFrame, keys: list[str], order_col: str = ORDER_COL,
                 null_safe: bool = False) -> DataFrame:
    """Source rows that the merge inserts or updates with: ``_action``, ``_old`` (date of the target row that an
    update replaces) and ``_moved`` (false where that row is the same in all columns). One row per matched target row.

    Only what the batch holds is joined: the target's own rows do not appear.
    """
    cols = target.columns
    t = target.select(*[F.col(k).alias(f"_tk{i}") for i, k in enumerate(keys)], F.struct(*cols).alias("_t"))
    s = source.select(*cols)
    cond = None
    for i, k in enumerate(keys):
        c = _eq(F.col(k), F.col(f"_tk{i}"), null_safe)
        cond = c if cond is None else cond & c
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_t.{c}"))
    fresh = F.col("_t").isNull()
    newer = F.coalesce(F.col(f"_t.{order_col}") <= F.col(order_col), F.lit(False))
    return (s.join(t, cond, "left").filter(fresh | newer)
            .select(*cols, F.when(fresh, "inserted").otherwise("updated").alias("_action"),
                    F.col(f"_t.{order_col}").alias("_old"), (fresh | ~same).alias("_moved")))


def upsert_metrics(target: DataFrame, source: DataFrame, keys: list[str], order_col: str = ORDER_COL,
                   null_safe: bool = False) -> DataFrame:
    """Rows inserted and updated by the merge: ``(action, rows)``."""
    return (tagged_merge(target, source, keys, order_col, null_safe)
            .filter(F.col("action").isin("inserted", "updated"))
            .groupBy("action").agg(F.count(F.lit(1)).alias("rows")))


def retain(df: DataFrame, as_of, days: int, col: str = ORDER_COL) -> DataFrame:
    """Drop rows older than ``as_of - days`` (strict ``<``); NULL dates stay.

    On a table partitioned by the date this is a partition filter.
    """
    cutoff = window_start(as_date(as_of), days)
    return df.filter(F.col(col).isNull() | (F.col(col) >= cutoff))
