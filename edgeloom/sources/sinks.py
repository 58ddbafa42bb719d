"""Sinks: views, tables (create or upsert), JSON export, schema bootstrap.

A table is partitioned by its date, and a write replaces only the partitions
whose rows change. The new rows of those partitions go to a staging table first,
which is marked ready (with the partitions it stands for) once it is complete;
then the partitions are overwritten from it. A driver that dies in between is
recovered by the next write. Partitions that are to be emptied are dropped from
the catalog without writing anything.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import stage

_STATE, _DATES, _OWNER, _VERSION = "edgeloom.swap", "edgeloom.dates", "edgeloom.owner", "edgeloom.version"
#: A staging table that is not ready belongs to a run that may still write it, up to this age.
ABANDONED_S = 24 * 3600
#: A ready staging table of another application is being swapped in by it, up to this age.
SWAPPING_S = 3600
_SWAPPING: set[str] = set()          # what this process is swapping in


class TableChanged(RuntimeError):
    """Another run has written the table, or is writing it, since this run read it. Run again."""


def _staging_name(table: str) -> str:
    return f"{table}__staging_{int(time.time())}_{uuid.uuid4().hex[:12]}"


def _age(staging: str) -> float:
    made = staging.rpartition("__staging")[2].strip("_").partition("_")[0]
    return time.time() - int(made) if made.isdigit() else float("inf")


def _staging_tables(spark: SparkSession, table: str) -> list[str]:
    """Staging tables of this and other runs for ``table``."""
    schema, _, name = table.rpartition(".")
    rows = spark.sql(f"SHOW TABLES {'IN ' + schema if schema else ''} LIKE '{name}__staging*'").collect()
    return sorted((f"{schema}." if schema else "") + r["tableName"] for r in rows)


def _properties(spark: SparkSession, table: str) -> dict:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def _set(spark: SparkSession, table: str, **props) -> None:
    pairs = ", ".join(f"'{k}' = '{v}'" for k, v in props.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def table_property(spark: SparkSession, table: str, name: str) -> str | None:
    return _properties(spark, table).get(name)


def set_table_property(spark: SparkSession, table: str, name: str, value: str) -> None:
    _set(spark, table, **{name: value})


def version(spark: SparkSession, table: str) -> str | None:
    """Changes with every write of this module to the table."""
    return _properties(spark, table).get(_VERSION)


def _check_version(spark: SparkSession, table: str, read: str | None) -> None:
    if spark.catalog.tableExists(table) and version(spark, table) != read:
        raise TableChanged(f"{table} was written by another run")


def partition_column(spark: SparkSession, table: str) -> str | None:
    cols = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    return cols[0] if len(cols) == 1 else None


def partitions(spark: SparkSession, table: str) -> list[str | None]:
    """Values of the partition column, as text (None: the partition of NULL)."""
    values = [r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    return sorted((None if v in ("__HIVE_DEFAULT_PARTITION__", "null") else v for v in values), key=str)


def in_partitions(col: str, values) -> Column:
    """Rows of the given partitions: a partition filter."""
    dates = [v for v in values if v is not None]
    hit = F.col(col).isin(*[F.lit(v).cast("date") for v in dates]) if dates else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | F.col(col).isNull() if None in values else hit


def _dates_of(df: DataFrame, col: str) -> list[str | None]:
    """Dates that occur: as many as the table has partitions, at most."""
    return sorted((r[0] for r in df.select(F.col(col).cast("string")).distinct().collect()), key=str)


def _write(df: DataFrame, table: str, partition_by: str | None) -> None:
    # rebalanced from the sizes seen at run time: small dates take one file, a large one as many as its size asks for
    w = (df.hint("rebalance", partition_by).write.partitionBy(partition_by) if partition_by else df.write)
    w.mode("overwrite").saveAsTable(table)


def create_table(df: DataFrame, table: str, partition_by: str | None = None) -> None:
    _write(df, table, partition_by)
    _set(df.sparkSession, table, **{_VERSION: uuid.uuid4().hex})


def _drop_partitions(spark: SparkSession, table: str, col: str, values) -> None:
    specs = ", ".join(f"PARTITION ({col} = " + ("null" if v is None else f"'{v}'") + ")" for v in values)
    if specs:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def _finish(spark: SparkSession, staging: str, table: str) -> None:
    """Put a ready staging table in place: all of the table, or the partitions it stands for. May be done again."""
    new, dates = spark.table(staging), _properties(spark, staging).get(_DATES)
    there = spark.catalog.tableExists(table)
    by = partition_column(spark, table) if there else None
    if dates is None or not by:
        _write(new, table, by)
    else:
        held = _dates_of(new, by)
        if held:
            before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            try:
                new.select(*spark.table(table).columns).hint("rebalance", by).write.mode("overwrite").insertInto(table)
            finally:
                spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        _drop_partitions(spark, table, by, [d for d in json.loads(dates) if d not in held])
    _set(spark, table, **{_VERSION: uuid.uuid4().hex})
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    spark.catalog.refreshTable(table)


def _swap_in(spark: SparkSession, staging: str, table: str, dates=None) -> None:
    """Replace ``table`` (or its partitions ``dates``) with the complete ``staging`` table, then drop that.

    The staging table is marked ready only after it is fully written. If the
    driver dies while the target is being overwritten, :func:`recover_swap`
    finds the ready staging table and finishes the swap on the next write.
    """
    props = {_STATE: "ready", _OWNER: spark.sparkContext.applicationId}
    if dates is not None:
        props[_DATES] = json.dumps(list(dates))
    _SWAPPING.add(staging)
    try:
        _set(spark, staging, **props)
        _finish(spark, staging, table)
    finally:
        _SWAPPING.discard(staging)


def recover_swap(spark: SparkSession, table: str, dead: tuple = ()) -> None:
    """Finish a swap that a dead driver left half done, and drop what dead runs left unfinished.

    A run is taken for dead when it is of this application and has ended, when
    its application is in ``dead``, or when its staging table is older than
    ``ABANDONED_S`` (not ready) or ``SWAPPING_S`` (ready). A live run's staging
    table is left alone; while one is being swapped in, :class:`TableChanged` is raised.
    """
    for staging in _staging_tables(spark, table):
        if staging in _SWAPPING:
            raise TableChanged(f"{table} is being written by this application")
        props, age = _properties(spark, staging), _age(staging)
        if props.get(_STATE) == "ready":
            owner = props.get(_OWNER)
            if owner != spark.sparkContext.applicationId and owner not in dead and age < SWAPPING_S:
                raise TableChanged(f"{table} is being written by {owner}")
            _finish(spark, staging, table)
        elif age > ABANDONED_S:
            spark.sql(f"DROP TABLE IF EXISTS {staging}")


def replace_partitions(spark: SparkSession, table: str, rows: DataFrame, dates, read: str | None, watch=None) -> None:
    """Make ``rows`` all that the table holds under the partitions ``dates``; other partitions keep their files.

    ``rows`` may read the table. ``read``: the table's :func:`version` when they were
    planned. ``watch(before, after)`` sees the replaced rows and the new ones.
    """
    if not dates:
        return
    staging = _staging_name(table)
    by = partition_column(spark, table)
    rows.write.mode("overwrite").saveAsTable(staging)
    try:
        _check_version(spark, table, read)
        if watch:
            watch(spark.table(table).filter(in_partitions(by, dates)), spark.table(staging))
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
        raise
    _swap_in(spark, staging, table, dates)


def _day(spark: SparkSession, value) -> str:
    return str(spark.range(1).select(F.lit(value).cast("date")).first()[0])


def retire_partitions(spark: SparkSession, table: str, keep_from, watch=None) -> int:
    """Drop the partitions of earlier dates (NULL stays) and return their rows. No row is written:
    the rows are counted from the files' footers and the partitions leave the catalog."""
    by, cut = partition_column(spark, table), _day(spark, keep_from)
    old = [d for d in partitions(spark, table) if d is not None and d < cut]
    if not old:
        return 0
    gone = spark.table(table).filter(in_partitions(by, old))
    n = gone.count()
    if watch:
        watch(gone, gone.limit(0))
    _drop_partitions(spark, table, by, old)
    _set(spark, table, **{_VERSION: uuid.uuid4().hex})
    spark.catalog.refreshTable(table)
    return n


def publish(df: DataFrame, name: str, global_view: bool = False, table: str | None = None) -> DataFrame:
    """Expose a stage by name and return the view.

    A temp view by default, or a global-temp view. With ``table`` the frame is
    written to that table and ``name`` becomes a persistent view of it, which
    later sessions and jobs read.
    """
    spark = df.sparkSession
    if table:
        overwrite_via_staging(df, table)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {table}")
        return spark.table(name)
    if global_view:
        df.createOrReplaceGlobalTempView(name)
        return spark.table(f"global_temp.{name}")
    df.createOrReplaceTempView(name)
    return spark.table(name)


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the target schema when it is missing (optionally at a storage location)."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{loc}")


def save_or_upsert(df: DataFrame, table: str, keys: list[str], order_col: str,
                   null_safe: bool = False, row_level: bool = False, keep_from=None, watch=None) -> dict:
    """First run writes the frame as the table, partitioned by ``order_col``; later runs upsert into it.

    A file table is merged by partition: the batch meets the table's keys once,
    which gives the action counts (observed while the changed rows are staged) and
    the dates that the changes leave and enter; only those partitions are merged
    and written again. Updates that change nothing touch no partition. ``keep_from``:
    rows of an earlier date are left out (NULL dates stay), and older partitions are
    dropped (retention; ``retired`` counts the rows that the merge has not moved to a
    later date). Tables that support row-level operations are merged in
    place with ``DataFrame.mergeInto``. ``watch(before, after)`` sees every set of
    rows that another one replaces. Returns the inserted, updated and retired counts.
    Rows of ``df`` are unique on the keys, as for MERGE.
    """
    from edgeloom.operators.upsert import changed_rows, tagged_merge, upsert_metrics

    spark = df.sparkSession
    recover_swap(spark, table)
    kept = F.lit(True) if keep_from is None else F.col(order_col).isNull() | (F.col(order_col) >= keep_from)
    if not spark.catalog.tableExists(table):
        create_table(df.filter(kept), table, order_col)
        if watch:
            watch(df.limit(0), spark.table(table))
        return {"inserted": None, "updated": None, "created": True, "retired": 0}
    target, read = spark.table(table), version(spark, table)
    if row_level:
        # Table formats with row-level operations (DSv2 MERGE support) merge in place.
        # Not exercised in this repo's tests: no such format is installed here.
        counts = {r["action"]: r["rows"] for r in upsert_metrics(target, df, keys, order_col, null_safe).collect()}
        eq = " AND ".join(f"{table}.{k} {'<=>' if null_safe else '='} s.{k}" for k in keys)
        (df.alias("s").mergeInto(table, F.expr(eq))
         .whenMatched(F.expr(f"{table}.{order_col} <= s.{order_col}")).updateAll()
         .whenNotMatched().insertAll()
         .merge())
        return {"inserted": counts.get("inserted", 0), "updated": counts.get("updated", 0), "created": False, "retired": 0}
    if partition_column(spark, table) != order_col:
        raise ValueError(f"{table} is not partitioned by {order_col}")
    seen = Observation(f"upsert_{uuid.uuid4().hex[:8]}")
    moved = stage(changed_rows(target, df, keys, order_col, null_safe).observe(
        seen, *[F.count(F.when(F.col("_action") == a, 1)).alias(a) for a in ("inserted", "updated")]).filter("_moved"))
    leave = moved.filter(F.col("_action") == "updated").select(F.col("_old").alias(order_col))
    dates = _dates_of(moved.select(order_col).unionByName(leave), order_col)
    retired = 0
    if keep_from is not None:                    # partitions about to be dropped are not written first
        cut = _day(spark, keep_from)
        dates = [d for d in dates if d is None or d >= cut]
        retired -= leave.filter(~kept).count()
    part = target.filter(in_partitions(order_col, dates))
    merged = tagged_merge(part, moved.select(*target.columns).distinct(), keys, order_col, null_safe).drop("action")
    replace_partitions(spark, table, merged.filter(kept), dates, read, watch)
    if keep_from is not None:
        retired += retire_partitions(spark, table, keep_from, watch)
    return {"inserted": seen.get["inserted"], "updated": seen.get["updated"], "created": False, "retired": retired}


def overwrite_via_staging(df: DataFrame, table: str, partition_by: str | None = None) -> None:
    """Replace a table with a frame that may read it. A table that is there keeps its partition column."""
    spark = df.sparkSession
    recover_swap(spark, table)
    if not spark.catalog.tableExists(table):
        create_table(df, table, partition_by)
        return
    read, staging = version(spark, table), _staging_name(table)
    df.write.mode("overwrite").saveAsTable(staging)
    _check_version(spark, table, read)
    _swap_in(spark, staging, table)


def _record(df: DataFrame) -> Column:
    from pyspark.sql import types as T

    from edgeloom.functions.columns import http_date

    fields = [http_date(f.name).alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name)
              for f in df.schema.fields]
    # NULLs are written as ``null`` (not dropped), like the served payload.
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def graph_export(nodes_api: DataFrame, links_api: DataFrame) -> DataFrame:
    """Nodes and links as JSON records, one row each: ``(kind, record)``.

    Field names and order follow the served API; dates are HTTP dates. Write
    it with :func:`write_graph_json` (one JSON-lines folder per kind).
    """
    n = nodes_api.select(F.lit("node").alias("kind"), _record(nodes_api).alias("record"))
    lk = links_api.select(F.lit("link").alias("kind"), _record(links_api).alias("record"))
    return n.unionByName(lk)


def search_export(nodes: DataFrame, links: DataFrame, index: DataFrame, target: DataFrame) -> DataFrame:
    """A search payload as JSON records ``(kind, record)``: the closure's nodes
    and links, the ``{name, type}`` index of all nodes, and the target.

    Pass the parts of :class:`edgeloom.plans.search.SearchResult`; the
    ``search_target`` column of nodes and links is kept, so one export can hold
    the payloads of many start nodes.
    """
    parts = [("node", nodes), ("link", links), ("index", index),
             ("target", target.select(F.col("search_target").alias("target")))]
    out = None
    for kind, df in parts:
        rec = df.select(F.lit(kind).alias("kind"), _record(df).alias("record"))
        out = rec if out is None else out.unionByName(rec)
    return out


def write_graph_json(nodes_api: DataFrame, links_api: DataFrame, path: str) -> None:
    """Export to ``path/kind=node`` and ``path/kind=link`` JSON-lines folders."""
    graph_export(nodes_api, links_api).write.mode("overwrite").partitionBy("kind").text(path)
