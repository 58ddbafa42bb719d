"""Test inputs derived from the driver tables (FIXTURES.md), as Spark jobs.

The reference reads platform system tables that do not exist here; these
functions derive the same shapes from ``events``, ``part``, ``supplier`` and
``orders`` so the work grows with those tables. The DuckDB oracle derives them
with SQL text; equal results check both.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture constants.
HOST = "ws"
WORKSPACE = "w1"
OFFSET_DAYS = 30
AS_OF = _dt.date(2024, 2, 10)
UPSERT_SPLIT = _dt.date(2024, 1, 21)
PURGE_DAYS = 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c):
    return c.cast("string")


def lineage_events(events: DataFrame) -> DataFrame:
    """One lineage event per ``events`` row (FIXTURES.md 3.1)."""
    eid = F.col("event_id")
    e0 = events.select(
        "event_id", "ts", "event_type",
        (eid % 400).cast("int").alias("s"),
        F.col("user_id").cast("int").alias("u"),
        F.replace(F.replace(F.col("props"), F.lit('{"k": '), F.lit("")), F.lit("}"), F.lit(""))
        .cast("int").alias("k"),
    )
    s, k = F.col("s"), F.col("k")
    e1 = e0.withColumn(
        "t",
        F.when(eid % 41 == 0, s)
        .otherwise(((F.floor(s / 50) + 1) * 50 + (s * 7 + k) % 50).cast("int")),
    )
    t, et = F.col("t"), F.col("event_type")
    entity_type = (
        F.when(eid % 97 == 0, F.lit(None).cast("string"))
        .when((eid % 43 == 0) & (s % 8 == 1), "JOB")
        .when(s % 8 == 0, "JOB").when(s % 8 == 1, "PIPELINE").when(s % 8 == 2, "NOTEBOOK")
        .when(s % 8 == 3, "DBSQL_QUERY").when(s % 8 == 4, "DASHBOARD_V3")
        .when(s % 8 == 5, "DBSQL_DASHBOARD").when(s % 8 == 6, "JOB").otherwise("GENIE")
    )
    return e1.select(
        entity_type.alias("entity_type"),
        _s(s).alias("entity_id"),
        F.when(eid % 53 == 0, "system").otherwise("main").alias("source_table_catalog"),
        F.when(eid % 59 == 0, "information_schema")
        .otherwise(F.concat(F.lit("s"), _s(s % 5))).alias("source_table_schema"),
        F.when(et == "signup", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("main.s"), _s(s % 5), F.lit(".t"), _s(s))).alias("source_table_full_name"),
        F.when((et == "signup") & (eid % 2 == 0), F.concat(F.lit("s3://lake/in/"), _s(s), F.lit(".d")))
        .alias("source_path"),
        F.when(et == "signup", F.when(eid % 2 == 0, "PATH"))
        .when(s % 3 == 0, "VIEW").otherwise("TABLE").alias("source_type"),
        F.lit("main").alias("target_table_catalog"),
        F.concat(F.lit("s"), _s(t % 5)).alias("target_table_schema"),
        F.when(et == "view", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("main.s"), _s(t % 5), F.lit(".t"), _s(t))).alias("target_table_full_name"),
        F.lit(None).cast("string").alias("target_path"),
        F.when(et == "view", F.lit(None).cast("string"))
        .when(t % 3 == 0, "VIEW").otherwise("STREAMING_TABLE").alias("target_type"),
        F.col("ts").alias("event_time"),
        F.when(F.col("u") % 20 == 0, "w2").otherwise("w1").alias("workspace_id"),
        F.col("ts").cast("date").alias("event_date"),
        F.when(et == "error", "hms_table_lineage").otherwise("table_lineage").alias("lineage_source_table"),
    )


def table_inventory_source(part: DataFrame) -> DataFrame:
    """Catalog table inventory (FIXTURES.md 3.2)."""
    k = F.col("p_partkey")
    return part.select(
        F.when(k % 31 == 0, "system").otherwise("main").alias("table_catalog"),
        F.when(k % 37 == 0, "information_schema")
        .otherwise(F.concat(F.lit("s"), _s(k % 5))).alias("table_schema"),
        F.concat(F.lit("t"), _s(k)).alias("table_name"),
        F.date_sub(F.lit("2024-02-05").cast("date"), F.col("p_size").cast("int")).alias("last_altered"),
    )


def legacy_inventory_source(supplier: DataFrame) -> DataFrame:
    """Legacy metastore inventory (FIXTURES.md 3.3), before stamping."""
    k = F.col("s_suppkey")
    return supplier.select(
        F.lit("hive_metastore").alias("table_catalog"),
        F.concat(F.lit("legacy"), _s(k % 3)).alias("table_schema"),
        F.concat(F.lit("h"), _s(k)).alias("table_name"),
    )


def legacy_inventory_fixture(supplier: DataFrame) -> DataFrame:
    """Legacy inventory as FIXTURES.md 3.3 states it (``last_altered`` a DATE)."""
    return legacy_inventory_source(supplier).withColumn("last_altered", F.lit("9999-12-31").cast("date"))


# Audit action per ``o_orderkey % 41`` bucket, and the map key it uses.
_AUDIT_ACTIONS = {
    0: ("deleteTable", "full_name_arg"),
    1: ("deleteSchema", "full_name_arg"),
    2: ("deleteJob", "job_id"),
    3: ("deletePipeline", "pipelineId"),
    4: ("deleteNotebook", "notebookId"),
    5: ("deleteDashboard", "dashboardId"),
    6: ("deleteQuery", "queryId"),
    7: ("deleteQueryDraft", "queryId"),
    8: ("delete", "job_id"),
    9: ("delete", "job_id"),
}


def audit_source(orders: DataFrame) -> DataFrame:
    """Audit log in the reference shape (FIXTURES.md 3.4, map form)."""
    a = orders.select(
        F.date_add(F.lit("2024-01-22").cast("date"), (F.col("o_orderkey") % 20).cast("int")).alias("d"),
        (F.col("o_orderkey") % 41).cast("int").alias("m"),
        (F.floor(F.col("o_orderkey") / 41) % 400).cast("int").alias("n"),
    )
    m, n = F.col("m"), F.col("n")
    action = key = None
    for code, (name, param) in _AUDIT_ACTIONS.items():
        action = F.when(m == code, name) if action is None else action.when(m == code, name)
        key = F.when(m == code, param) if key is None else key.when(m == code, param)
    action = action.otherwise("getTable")
    key = key.otherwise("full_name_arg")
    full_name_arg = (
        F.when(m == 0, F.concat(F.lit("main.s"), _s(n % 5), F.lit(".t"), _s(n)))
        .when((m == 1) & (n % 97 == 3), F.lit("main.s4"))
        .when(m == 1, F.concat(F.lit("main.x"), _s(n % 5)))
    )
    object_id = F.when(m > 1, _s(n))
    return a.select(
        F.col("d").cast("timestamp").alias("event_time"),
        action.alias("action_name"),
        F.when(m == 8, "jobs").when(m == 9, "clusters").otherwise("unityCatalog").alias("service_name"),
        F.create_map(key, F.coalesce(full_name_arg, object_id)).alias("request_params"),
    )


class Fixture:
    """All derived inputs of one scale factor, built lazily from its folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def events(self) -> DataFrame:
        return lineage_events(self.table("events"))

    def inventory(self) -> DataFrame:
        return table_inventory_source(self.table("part"))

    def legacy(self) -> DataFrame:
        return legacy_inventory_fixture(self.table("supplier"))

    def audit(self) -> DataFrame:
        return audit_source(self.table("orders"))
