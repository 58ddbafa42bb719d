"""Session and lineage-cutting helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package expects.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",     # no call site per column: plans are built twice as fast
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(total_cores: int) -> dict:
    """Settings for a large cluster (hundreds of executors, tens of TB of events).

    * shuffle partitions: about three per core and at least 2000, so a shuffle
      of tens of TB stays near the advisory size per task; AQE coalesces the
      small shuffles (degrees, links) back down at run time;
    * 256 MB scan splits and advisory partitions: fewer, fuller tasks;
    * skew splitting from 512 MB (5x the median): hub tables and hot entities;
    * broadcast only below 64 MB, decided from runtime sizes by AQE;
    * bucketed reads on, so the staged BFS adjacency is never reshuffled.
    ``spark.checkpoint.dir`` must name a shared folder (staged stages live there).
    """
    return {
        "spark.sql.shuffle.partitions": str(max(2000, 3 * total_cores)),
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.sources.bucketing.enabled": "true",
    }


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app_name: str = "edgeloom", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only a local-mode session without one (tests, benches) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; it is required to cut lineage")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="edgeloom-ckpt-"))
    return sc.getCheckpointDir()


_SCOPES: list[tuple[list[str], list[str]]] = []     # paths and tables staged inside each open scope


@contextmanager
def staging_scope(spark: SparkSession):
    """Remove what is staged inside the block when it ends (the folders and the tables).

    For jobs whose results are written elsewhere before they end. Frames staged
    inside must not be read afterwards.
    """
    paths, tables = [], []
    _SCOPES.append((paths, tables))
    try:
        yield
    finally:
        _SCOPES.pop()
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")
        jvm = spark.sparkContext._jvm
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Materialize a shared intermediate under the checkpoint folder.

    The frame is written once as parquet into ``spark.checkpoint.dir`` (a
    shared folder on a cluster) and read back: the result no longer depends on
    its lineage, so a lost executor costs a re-read, not a recomputation of
    the chain; the read carries real file sizes, so AQE can broadcast small
    stages. (``Dataset.checkpoint`` would run the plan twice: once for the
    eager count and once more to write the files.) With ``outlive`` it stays when
    the innermost :func:`staging_scope` ends.
    """
    return stage_path(df, outlive)[0]


def stage_path(df: DataFrame, outlive: bool = False) -> tuple[DataFrame, str]:
    """Like :func:`stage`, with the folder that was written."""
    spark = df.sparkSession
    path = _stage_path(spark, outlive)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _stage_path(spark: SparkSession, outlive: bool = False) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/edgeloom-stages/{uuid.uuid4().hex}"
    if scopes := _SCOPES[:-1] if outlive else _SCOPES:
        scopes[-1][0].append(path)
    return path


def stage_bucketed(df: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    """Like :func:`stage`, but bucketed (hash-partitioned into files) by ``cols``.

    A frame joined on ``cols`` again and again (the BFS adjacency) is then
    never shuffled for those joins: only the other side moves. The rows are
    dealt to one task per bucket first, so a table of n buckets has n files, not
    n times the number of tasks. The table is external (its files live under
    the checkpoint folder) and registered under a generated name in the session
    catalog; :func:`staging_scope` drops it.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"edgeloom_stage_{uuid.uuid4().hex}"
    (df.repartition(n, *cols).write.mode("overwrite").format("parquet").option("path", _stage_path(spark))
     .bucketBy(n, *cols).saveAsTable(name))
    if _SCOPES:
        _SCOPES[-1][1].append(name)
    return spark.table(name)
