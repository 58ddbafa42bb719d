import datetime as dt

from pyspark.sql import functions as F

LINK_SCHEMA = ("source_node string, source_node_type string, target_node string, target_node_type string, "
               "entity_path string, last_event_date date, lineage_source_table string")
NODE_SCHEMA = "node string, node_type string, entity_path string, last_event_date date, lineage_source_table string"
T = "TABLE/VIEW/PATH"


def d(s):
    return None if s is None else dt.date.fromisoformat(s)


def links(spark, rows):
    """rows: (source, target[, date[, path[, tag[, stype, ttype]]]])"""
    out = []
    for r in rows:
        r = list(r) + [None] * (7 - len(r))
        s, t, date, path, tag, st, tt = r
        out.append((s, st or T, t, tt or T, path, d(date or "2024-01-01"), tag or "table_lineage"))
    return spark.createDataFrame(out, LINK_SCHEMA)


def api(spark, pairs):
    return links(spark, pairs).select(F.col("source_node").alias("source"), F.col("target_node").alias("target"),
                                      "entity_path", F.col("source_node_type").alias("source_type"),
                                      F.col("target_node_type").alias("target_type"), "last_event_date",
                                      "lineage_source_table")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
