"""The scheduled jobs end to end over catalog tables."""

import datetime as dt

from pyspark.sql import functions as F

from edgeloom.operators import purge as P
from edgeloom.plans.build import BuildParams, GraphBuild
from edgeloom.plans.jobs import GraphTables, graph_job, purge_job
from edgeloom.sources import scans as S
from edgeloom.sources.fixtures import AS_OF, HOST, OFFSET_DAYS, WORKSPACE, Fixture, legacy_inventory_source
from edgeloom.sources.sinks import ensure_schema
from tests.helpers import rows

SF = "/root/testdata/sf0.001"


def table(spark, name):
    spark.catalog.refreshTable(name)
    return spark.table(name)


def test_graph_then_purge_job(spark, tmp_path):
    fx = Fixture(spark, SF)
    params = BuildParams(WORKSPACE, HOST, AS_OF, OFFSET_DAYS)
    ensure_schema(spark, "jobs_t", str(tmp_path / "wh"))
    uc, hms = S.split_by_tag(fx.events())
    uc.write.saveAsTable("jobs_t.uc_log")
    hms.write.saveAsTable("jobs_t.hms_log")
    tables = GraphTables("jobs_t.links", "jobs_t.nodes", "jobs_t.legacy_inventory", "jobs_t.valid_ids")

    graph_job(spark, "jobs_t.uc_log", tables, params, fx.inventory(), fx.legacy(), hms_log="jobs_t.hms_log")
    g = GraphBuild(fx.events(), params, fx.inventory(), fx.legacy())
    assert rows(table(spark, "jobs_t.links"), *g.links().columns) == rows(g.links())
    assert rows(table(spark, "jobs_t.nodes"), *g.nodes().columns) == rows(g.nodes())

    # a second run over the same log re-inserts only the rows whose URL is NULL (NULL never matches in MERGE)
    again = graph_job(spark, "jobs_t.uc_log", tables, params, fx.inventory(), fx.legacy(),
                      hms_log="jobs_t.hms_log")
    null_url = g.links().filter(F.col("entity_path").isNull()).count()
    assert again["links"]["inserted"] == null_url
    assert table(spark, "jobs_t.links").count() == g.links().count() + null_url

    before_links, before_nodes = table(spark, "jobs_t.links"), table(spark, "jobs_t.nodes")
    ids = S.valid_table_ids(fx.inventory(), S.legacy_inventory(legacy_inventory_source(fx.table("supplier"))))
    dels = P.deletions(S.audit_scan(fx.audit()), HOST, AS_OF, OFFSET_DAYS)
    hits = P.deleted_entities(before_nodes, dels)
    named = lambda df: sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    want_links = named(P.drop_orphan_links(P.match_deleted_links(before_links, hits), ids))
    want_nodes = named(P.drop_orphan_nodes(P.merge_delete_nodes(before_nodes, hits), ids))
    n_links, n_nodes = before_links.count(), before_nodes.count()
    out = purge_job(spark, fx.audit(), tables, params, fx.inventory(), legacy_inventory_source(fx.table("supplier")))
    assert named(table(spark, "jobs_t.links")) == want_links
    assert named(table(spark, "jobs_t.nodes")) == want_nodes
    assert out["links"]["total_deleted"] == n_links - len(want_links)
    assert out["nodes"]["total_deleted"] == n_nodes - len(want_nodes)
    assert table(spark, "jobs_t.valid_ids").count() == ids.count()


def test_tables_stay_partitioned_and_degrees_are_kept(spark, tmp_path):
    """Graph, purge, graph with retention: partitions stay, and the degree table equals a recount after each run."""
    from edgeloom.operators import degree as D
    from edgeloom.sources import sinks
    fx = Fixture(spark, SF)
    params = BuildParams(WORKSPACE, HOST, AS_OF, OFFSET_DAYS)
    ensure_schema(spark, "deg_t", str(tmp_path / "wh"))
    ev = fx.events()
    uc, hms = S.split_by_tag(ev)
    early = F.col("event_date") < F.lit("2024-01-21").cast("date")
    uc.filter(early).write.saveAsTable("deg_t.uc_log")
    hms.write.saveAsTable("deg_t.hms_log")
    tables = GraphTables("deg_t.links", "deg_t.nodes", "deg_t.legacy_inventory", "deg_t.valid_ids", degrees="deg_t.degrees",
                         edge_days="deg_t.edge_days")

    def graph(purge_days=None):
        return graph_job(spark, "deg_t.uc_log", tables, params, fx.inventory(), fx.legacy(), hms_log="deg_t.hms_log", purge_days=purge_days)

    def same():
        kept, counted = table(spark, "deg_t.degrees"), D.degree_counts(table(spark, "deg_t.links"))
        assert rows(kept, *counted.columns) == rows(counted) and kept.count() > 0
        for mode in ("reference", "strict"):
            assert rows(D.connections_of(kept, mode)) == rows(D.total_connections(table(spark, "deg_t.links"), mode))
        assert sinks.partition_column(spark, "deg_t.links") == sinks.partition_column(spark, "deg_t.nodes") == "last_event_date"

    first = graph()
    assert first["degrees"] == "counted" and first["days_read"]
    same()
    uc.filter(~early).write.insertInto("deg_t.uc_log")
    second = graph()
    assert second["degrees"] == "merged" and set(second["days_read"]) < {str(r[0]) for r in ev.select("event_date").distinct().collect()}
    same()
    purged = purge_job(spark, fx.audit(), tables, params, fx.inventory(), legacy_inventory_source(fx.table("supplier")))
    assert purged["degrees"] == "merged" and purged["links"]["total_deleted"] > 0
    same()
    third = graph(purge_days=25)
    assert third["days_read"] == [] and third["degrees"] == "merged" and third["links"]["retired"] + third["nodes"]["retired"] > 0
    same()
    # the links changed behind the degree table's back: it is counted anew
    sinks.overwrite_via_staging(spark.table("deg_t.links").limit(50), "deg_t.links")
    assert graph()["degrees"] == "counted"
    same()


def test_day_maxima_equal_the_full_build(spark, tmp_path):
    """Runs over a growing log, with a late event for an old day, and a window that has moved on."""
    from edgeloom.operators.daily import edges_of_days, refresh_days
    from edgeloom.operators.edges import build_edges
    fx = Fixture(spark, SF)
    ensure_schema(spark, "day_t", str(tmp_path / "wh"))
    ev = fx.events()
    days = sorted(str(r[0]) for r in ev.select("event_date").distinct().collect())
    old = [d for d in days if d > str(AS_OF - dt.timedelta(days=OFFSET_DAYS))][1]
    cut = F.lit([d for d in days if d > old][3]).cast("date")
    late = (F.col("event_date") == F.lit(old).cast("date")) & (F.xxhash64("entity_id", "event_time") % 2 == 0)
    for i, (log, as_of) in enumerate(((ev.filter((F.col("event_date") < cut) & ~late), AS_OF), (ev.filter(~late), AS_OF), (ev, AS_OF), (ev, AS_OF))):
        read = refresh_days(spark, log, "day_t.days", WORKSPACE, HOST, as_of, OFFSET_DAYS)
        assert rows(edges_of_days(spark, "day_t.days", as_of, OFFSET_DAYS)) == rows(build_edges(log, WORKSPACE, HOST, as_of, OFFSET_DAYS))
        if i == 2:
            assert read == [old]
        if i == 3:
            assert read == []
    p = edges_of_days(spark, "day_t.days", AS_OF, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in p
    assert rows(edges_of_days(spark, "day_t.days", AS_OF, 20)) == rows(build_edges(ev, WORKSPACE, HOST, AS_OF, 20))


def test_cli_runs_both_jobs(spark, tmp_path):
    from edgeloom.plans.cli import main
    fx = Fixture(spark, SF)
    ensure_schema(spark, "cli_t", str(tmp_path / "wh"))
    uc, hms = S.split_by_tag(fx.events())
    uc.write.saveAsTable("cli_t.uc_log")
    hms.write.saveAsTable("cli_t.hms_log")
    fx.inventory().write.saveAsTable("cli_t.inventory")
    fx.legacy().write.saveAsTable("cli_t.legacy")
    legacy_inventory_source(fx.table("supplier")).write.saveAsTable("cli_t.legacy_source")
    fx.audit().write.saveAsTable("cli_t.audit")
    common = ["--links", "cli_t.links", "--nodes", "cli_t.nodes", "--inventory", "cli_t.inventory",
              "--host", HOST, "--days", str(OFFSET_DAYS), "--as-of", AS_OF.isoformat(), "--workspace", WORKSPACE]
    out = main(["graph", *common, "--uc-log", "cli_t.uc_log", "--hms-log", "cli_t.hms_log",
                "--legacy", "cli_t.legacy"], spark=spark)
    assert out["links"]["created"] and out["nodes"]["created"]
    g = GraphBuild(fx.events(), BuildParams(WORKSPACE, HOST, AS_OF, OFFSET_DAYS), fx.inventory(), fx.legacy())
    assert table(spark, "cli_t.links").count() == g.links().count()
    out = main(["purge", *common, "--audit", "cli_t.audit", "--legacy-source", "cli_t.legacy_source"], spark=spark)
    assert out["links"]["total_deleted"] > 0 and out["nodes"]["total_deleted"] > 0
    out = main(["validate", "--nodes", "cli_t.nodes", "--inventory", "cli_t.inventory", "--legacy-source", "cli_t.legacy_source",
                "--valid-ids", "cli_t.valid_ids"], spark=spark)
    assert out["valid_ids"] == table(spark, "cli_t.valid_ids").count() > 0
    assert out["non_compliant"] == P.non_compliant_nodes(table(spark, "cli_t.nodes"), table(spark, "cli_t.valid_ids")).count()


def test_lineage_raw_without_legacy_log(spark, tmp_path):
    fx = Fixture(spark, SF)
    ensure_schema(spark, "raw_t", str(tmp_path / "wh"))
    uc, _ = S.split_by_tag(fx.events())
    uc.write.saveAsTable("raw_t.uc_log")
    raw = S.lineage_raw_from_catalog(spark, "raw_t.uc_log", "raw_t.no_such_log")
    assert raw.count() == uc.count()
    assert {r.lineage_source_table for r in raw.select("lineage_source_table").distinct().collect()} == \
        {"table_lineage"}
