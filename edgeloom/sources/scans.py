"""Input scans: lineage logs, table inventories, the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.columns import inventory_url
from edgeloom.functions.constants import HMS_TAG, LEGACY_LAST_ALTERED, UC_TAG

# The lineage log columns the graph reads (reference order).
LINEAGE_COLUMNS = (
    "entity_type",
    "entity_id",
    "source_table_catalog",
    "source_table_schema",
    "source_table_full_name",
    "source_path",
    "source_type",
    "target_table_catalog",
    "target_table_schema",
    "target_table_full_name",
    "target_path",
    "target_type",
    "event_time",
    "workspace_id",
    "event_date",
)


def lineage_scan(df: DataFrame, tag: str = UC_TAG) -> DataFrame:
    """Prune a lineage log to the 15 graph columns and tag its origin."""
    return df.select(*LINEAGE_COLUMNS, F.lit(tag).cast("string").alias("lineage_source_table"))


def lineage_raw(uc: DataFrame, hms: DataFrame | None = None) -> DataFrame:
    """UNION ALL of the catalog log and, when present, the legacy log."""
    raw = lineage_scan(uc, UC_TAG)
    if hms is not None:
        raw = raw.unionByName(lineage_scan(hms, HMS_TAG))
    return raw


def lineage_raw_from_catalog(spark: SparkSession, uc_table: str, hms_table: str | None = None) -> DataFrame:
    """Same as :func:`lineage_raw`, reading tables by name; the legacy one only if it exists."""
    hms = spark.table(hms_table) if hms_table and spark.catalog.tableExists(hms_table) else None
    return lineage_raw(spark.table(uc_table), hms)


def split_by_tag(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undo a tagged union into the two logs (fixtures carry both tags in one table)."""
    base = [c for c in LINEAGE_COLUMNS]
    uc = tagged.filter(F.col("lineage_source_table") == UC_TAG).select(*base)
    hms = tagged.filter(F.col("lineage_source_table") == HMS_TAG).select(*base)
    return uc, hms


def table_inventory(df: DataFrame, host: str) -> DataFrame:
    """Inventory rows with their node id ``catalog.schema.table`` and explorer link."""
    return df.select(
        "table_catalog", "table_schema", "table_name", "last_altered",
        F.concat(F.col("table_catalog"), F.lit("."), F.col("table_schema"), F.lit("."), F.col("table_name"))
        .alias("node"),
        inventory_url("table_catalog", "table_schema", "table_name", host).alias("entity_path"),
    )


def legacy_inventory(df: DataFrame) -> DataFrame:
    """Stamp legacy tables with the maximal ``last_altered`` so they are always kept."""
    return df.select(
        "table_catalog", "table_schema", "table_name",
        F.lit(LEGACY_LAST_ALTERED).cast("timestamp").alias("last_altered"),
    )


def table_id(df: DataFrame) -> DataFrame:
    """``TRIM(catalog.schema.table)``; a NULL part gives a NULL id (``||``)."""
    return df.select(
        F.trim(F.concat(F.col("table_catalog"), F.lit("."), F.col("table_schema"), F.lit("."),
                        F.col("table_name"))).alias("table_id"))


def valid_table_ids(inventory: DataFrame, legacy: DataFrame) -> DataFrame:
    """Ids of every table that still exists: UNION (distinct) of both inventories."""
    return table_id(inventory).union(table_id(legacy)).distinct()


# Request parameter read per kind of deletion.
AUDIT_PARAMS = ("full_name_arg", "job_id", "pipelineId", "notebookId", "dashboardId", "queryId")


def audit_scan(df: DataFrame) -> DataFrame:
    """Flatten the audit log's ``request_params`` map into the columns the purge reads."""
    rp = F.col("request_params")
    return df.select(
        "event_time", "action_name", "service_name",
        *[rp.getItem(k).alias(k) for k in AUDIT_PARAMS],
    )
