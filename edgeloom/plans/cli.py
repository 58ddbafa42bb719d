"""Command line for the scheduled jobs.

    python -m edgeloom.plans.cli graph --uc-log lin.access --links g.links --nodes g.nodes \\
        --inventory cat.tables --legacy g.legacy_inventory --workspace 123 --host my.host --days 365 \\
        [--hms-log lin.legacy_access] [--purge-days 365] [--as-of 2024-02-10] [--mode strict] \\
        [--degrees g.degrees] [--edge-days g.edge_days]
    python -m edgeloom.plans.cli purge --audit sys.audit --links g.links --nodes g.nodes \\
        --inventory cat.tables --legacy-source g.legacy_tables --host my.host --days 365
    python -m edgeloom.plans.cli validate --nodes g.nodes --inventory cat.tables --legacy-source g.legacy_tables

``--total-cores`` applies the cluster settings of :func:`edgeloom.session.cluster_conf`.
Tables are read and written through the session catalog; ``--as-of``
defaults to today. Inventory tables have ``table_catalog, table_schema,
table_name, last_altered``; the legacy source has the first three.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from edgeloom.plans.build import BuildParams
from edgeloom.plans.jobs import GraphTables, graph_job, purge_job, validate_job
from edgeloom.session import DEFAULT_CONF, cluster_conf, ensure_checkpoint_dir


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="edgeloom")
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("graph", "purge"):
        p = sub.add_parser(name)
        p.add_argument("--links", required=True)
        p.add_argument("--nodes", required=True)
        p.add_argument("--inventory", required=True)
        p.add_argument("--host", required=True)
        p.add_argument("--days", type=int, default=365)
        p.add_argument("--as-of", default=None)
        p.add_argument("--mode", choices=("reference", "strict"), default="reference")
        p.add_argument("--workspace", default="")
        p.add_argument("--degrees", default=None, help="degree table to keep up to date from what the run changes")
        p.add_argument("--total-cores", type=int, default=None, help="size shuffles for a cluster of so many cores")
    g = sub.choices["graph"]
    g.add_argument("--uc-log", required=True)
    g.add_argument("--hms-log", default=None)
    g.add_argument("--legacy", required=True, help="legacy inventory table (last_altered stamped)")
    g.add_argument("--purge-days", type=int, default=None)
    g.add_argument("--edge-days", default=None, help="table of stored maxima per event date; only new or grown dates are read")
    p = sub.choices["purge"]
    p.add_argument("--audit", required=True)
    p.add_argument("--legacy-source", required=True)
    p.add_argument("--legacy-inventory", default=None, help="table to refresh with the stamped legacy inventory")
    p.add_argument("--valid-ids", default=None, help="table to refresh with the valid table ids")
    v = sub.add_parser("validate")
    v.add_argument("--nodes", required=True)
    v.add_argument("--inventory", required=True)
    v.add_argument("--legacy-source", required=True)
    v.add_argument("--valid-ids", default=None)
    v.add_argument("--total-cores", type=int, default=None)
    return ap


def main(argv=None, spark: SparkSession | None = None) -> dict:
    a = _parser().parse_args(argv)
    if spark is None:
        b = SparkSession.builder.appName(f"edgeloom-{a.job}")
        for k, v in (DEFAULT_CONF | (cluster_conf(a.total_cores) if a.total_cores else {})).items():
            b = b.config(k, v)
        spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    if a.job == "validate":
        out = validate_job(spark, GraphTables("", a.nodes, valid_ids=a.valid_ids), spark.table(a.inventory), spark.table(a.legacy_source))
        print(json.dumps(out))
        return out
    as_of = a.as_of or dt.date.today().isoformat()
    params = BuildParams(a.workspace, a.host, as_of, a.days, a.mode)
    inventory = spark.table(a.inventory)
    if a.job == "graph":
        out = graph_job(spark, a.uc_log, GraphTables(a.links, a.nodes, degrees=a.degrees, edge_days=a.edge_days), params, inventory,
                        spark.table(a.legacy), hms_log=a.hms_log, purge_days=a.purge_days)
    else:
        tables = GraphTables(a.links, a.nodes, a.legacy_inventory, a.valid_ids, a.degrees)
        out = purge_job(spark, spark.table(a.audit), tables, params, inventory, spark.table(a.legacy_source))
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
