"""Hand-made unit fixtures, one per semantic quirk (FIXTURES.md section 5)."""

import datetime as dt

from pyspark.sql import functions as F

from edgeloom.operators import degree as deg
from edgeloom.operators import links as L
from edgeloom.operators import purge as P
from edgeloom.operators import serve as SV
from edgeloom.operators import traverse as TR
from edgeloom.operators import upsert as U
from edgeloom.operators.patterns import like_join
from tests.helpers import NODE_SCHEMA, T, api, d, links, rows, seeds

AS_OF = dt.date(2024, 2, 10)


def test_two_cycle_tie(spark):
    lk = links(spark, [
        ("a", "b", "2024-01-02"), ("b", "a", "2024-01-02"),   # tie on date: a->b wins (source order)
        ("x", "x", "2024-01-03"),                              # self-loop survives
        ("ab", "c", "2024-01-05"), ("a", "bc", "2024-01-04"),  # key clash in reference mode
        ("p", "q", "2024-01-09"), ("q", "p", "2024-01-01"),    # earliest date wins
    ])
    ref = rows(L.break_two_cycles(lk), "source_node", "target_node")
    assert ref == [("a", "b"), ("a", "bc"), ("q", "p"), ("x", "x")]
    strict = rows(L.break_two_cycles(lk, "strict"), "source_node", "target_node")
    assert strict == [("a", "b"), ("a", "bc"), ("ab", "c"), ("q", "p"), ("x", "x")]


def test_two_cycle_collapses_variants_of_one_direction(spark):
    lk = links(spark, [("a", "b", "2024-01-02", "u1", "table_lineage"),
                       ("a", "b", "2024-01-02", "u2", "hms_table_lineage")])
    out = L.break_two_cycles(lk).collect()
    assert len(out) == 1 and out[0]["lineage_source_table"] == "hms_table_lineage"


def test_null_url_upsert_inserts_again(spark):
    t = links(spark, [("a", "b", "2024-01-01", None)])
    s = links(spark, [("a", "b", "2024-01-05", None)])
    assert U.upsert(t, s, U.LINK_KEYS).count() == 2
    assert U.upsert(t, s, U.LINK_KEYS, null_safe=True).count() == 1


def test_older_source_row_keeps_target(spark):
    t = links(spark, [("a", "b", "2024-01-09", "u")])
    s = links(spark, [("a", "b", "2024-01-01", "u"), ("c", "d", "2024-01-01", "u")])
    got = {(r.source_node, r.last_event_date) for r in U.upsert(t, s, U.LINK_KEYS).collect()}
    assert got == {("a", d("2024-01-09")), ("c", d("2024-01-01"))}
    m = {r["action"]: r["rows"] for r in U.upsert_metrics(t, s, U.LINK_KEYS).collect()}
    assert m == {"inserted": 1}


def test_newer_or_equal_source_updates(spark):
    t = links(spark, [("a", "b", "2024-01-02", "u")])
    s = links(spark, [("a", "b", "2024-01-02", "u")])
    m = {r["action"]: r["rows"] for r in U.upsert_metrics(t, s, U.LINK_KEYS).collect()}
    assert m == {"updated": 1}


def test_equal_degree_union_rule(spark):
    lk = links(spark, [("a", "n"), ("b", "n"), ("n", "c"), ("n", "e"), ("n", "f"), ("g", "a")])
    ref = dict(rows(deg.total_connections(lk)))
    strict = dict(rows(deg.total_connections(lk, "strict")))
    assert ref["n"] == 5 and strict["n"] == 5      # 2 in / 3 out: unequal, summed in both
    lk2 = links(spark, [("a", "n"), ("b", "n"), ("n", "c"), ("n", "e")])
    assert dict(rows(deg.total_connections(lk2)))["n"] == 2
    assert dict(rows(deg.total_connections(lk2, "strict")))["n"] == 4


def test_most_connected_tie_break(spark):
    lk = links(spark, [("b", "x"), ("a", "y")])
    top = deg.most_connected(lk).collect()[0]
    assert top["total_connections"] == 1 and top["id"] == "a"


def test_like_wildcards(spark):
    nodes = spark.createDataFrame([("main.a_b.t", T, "https://ws/explore/data/main/a_b/t"),
                                   ("main.axb.t", T, "https://ws/explore/data/main/axb/t"),
                                   ("main.a_b_old.t", T, "https://ws/explore/data/main/a_b_old/t"),
                                   ("main.zz.t", T, "https://ws/explore/data/main/zz/t")],
                                  "node string, node_type string, entity_path string")
    pats = spark.createDataFrame([("https://ws/explore/data/main/a_b/%",)], "p string")
    hit = sorted(r.node for r in like_join(nodes, "entity_path", pats, "p").collect())
    assert hit == ["main.a_b.t", "main.axb.t"]
    pats2 = spark.createDataFrame([("main.a_b%",), ("%zz%",)], "p string")
    hit2 = sorted(r.node for r in like_join(nodes, "node", pats2, "p").collect())
    assert hit2 == ["main.a_b.t", "main.a_b_old.t", "main.axb.t", "main.zz.t"]


def test_like_join_equals_nested_loop(spark):
    vals = spark.createDataFrame([(f"https://ws/explore/data/c{i % 3}/s{i % 7}/t{i}",) for i in range(60)] + [(None,)],
                                 "v string")
    pats = spark.createDataFrame([("https://ws/explore/data/c1/s2/%",), ("%/t1%",), ("https://ws/explore/data/c_/s3%",),
                                  ("https://ws/explore/data/c2/s4/t4",), (None,), ("h%",),
                                  # suffix-selective patterns (bucketed by their literal end)
                                  ("%s3/t10",), ("https://ws/%/t17",), ("h%_/t2",), ("%c1/s1/t%2",),
                                  ("https://ws/explore/data/c1/s2/%",)], "p string")
    fast = rows(like_join(vals, "v", pats, "p"), "v", "p")
    slow = rows(vals.join(pats, F.expr("v LIKE p")), "v", "p")
    assert fast == slow and len(fast) > 60


def test_orphan_null_id_disables_delete(spark):
    lk = links(spark, [("main.s.t1", "main.s.t2"), ("s3://x", "main.s.t1")])
    nd = spark.createDataFrame([("main.s.t9", T, "u", d("2024-01-01"), "table_lineage")], NODE_SCHEMA)
    ids = spark.createDataFrame([("main.s.t1",), (None,)], "table_id string")
    assert P.drop_orphan_links(lk, ids).count() == 2
    assert P.drop_orphan_nodes(nd, ids).count() == 1
    ids2 = spark.createDataFrame([("main.s.t1",), ("main.s.t2",)], "table_id string")
    assert rows(P.drop_orphan_links(lk, ids2), "source_node") == [("main.s.t1",)]
    assert P.drop_orphan_nodes(nd, ids2).count() == 0
    assert P.non_compliant_nodes(nd, ids).count() == 1
    # strict mode keeps path endpoints
    assert P.drop_orphan_links(lk, ids2, "strict").count() == 2


def test_orphan_empty_ids_delete_all_table_typed(spark):
    lk = links(spark, [("a", "b"), ("j", "k", None, None, None, "JOB/PIPELINE", "JOB/PIPELINE")])
    ids = spark.createDataFrame([], "table_id string")
    assert rows(P.drop_orphan_links(lk, ids), "source_node") == [("j",)]


def test_same_day_delete_kept(spark):
    nd = spark.createDataFrame([("main.s.t", T, "https://ws/explore/data/main/s/t", d("2024-01-25"), "table_lineage"),
                                ("main.s.u", T, "https://ws/explore/data/main/s/u", d("2024-01-24"), "table_lineage"),
                                ("x", "NOTEBOOK", None, d("2024-01-01"), "table_lineage")], NODE_SCHEMA)
    audit = spark.createDataFrame([
        (dt.datetime(2024, 1, 25), "deleteTable", "catalog", "main.s.t", None, None, None, None, None),
        (dt.datetime(2024, 1, 25), "deleteTable", "catalog", "main.s.u", None, None, None, None, None),
    ], "event_time timestamp, action_name string, service_name string, full_name_arg string, job_id string, "
       "pipelineId string, notebookId string, dashboardId string, queryId string")
    dels = P.deletions(audit, "ws", AS_OF, 30)
    hit = rows(P.deleted_entities(nd, dels), "node")
    assert hit == [("main.s.u",)]


def test_retention_edge(spark):
    lk = links(spark, [("a", "b", "2024-01-20"), ("c", "d", "2024-01-21"), ("e", "f", "2024-01-22")])
    lk = lk.unionByName(links(spark, [("g", "h")]).withColumn("last_event_date", F.lit(None).cast("date")))
    kept = rows(U.retain(lk, AS_OF, 20), "source_node")
    assert kept == [("c",), ("e",), ("g",)]


def test_long_cycle_terminates(spark):
    la = api(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    got = rows(TR.bfs(la, seeds(spark, "a"), TR.DOWN), "node", "depth")
    assert got == [("a", 0), ("b", 1), ("c", 2)]
    got_up = rows(TR.bfs(la, seeds(spark, "a"), TR.UP), "node", "depth")
    assert got_up == [("a", 0), ("b", 2), ("c", 1)]


def test_level_bounds(spark):
    la = api(spark, [("n0", "n1"), ("n1", "n2"), ("n2", "n3"), ("n3", "n4")])
    s = seeds(spark, "n0")
    assert TR.bfs(la, s, TR.DOWN, max_depth=0).count() == 1
    assert TR.bfs(la, s, TR.DOWN, max_depth=3).count() == 4
    assert TR.bfs(la, s, TR.DOWN, max_depth=9).count() == 5
    assert TR.bfs(la, s, TR.DOWN, max_depth=-1).count() == 1
    assert TR.bfs(la, s, TR.DOWN, max_depth=None).count() == 5
    lv = TR.max_levels(la, s)
    assert rows(lv) == [("n0", 0, 4)]
    req = spark.createDataFrame([("n0", v, v) for v in (0, 3, 9, -1, None)],
                                "seed string, requested_up long, requested_down long")
    got = {(r.requested_down, r.down_level, r.down_message) for r in TR.clamp_levels(req, lv).collect()}
    assert got == {(0, 0, None), (3, 3, None), (9, 4, "Maximum level is 4"), (-1, 0, "Minimum level is 0"),
                   (None, None, None)}
    sel = spark.createDataFrame([("n0", 0, 2)], "seed string, up_level long, down_level long")
    assert rows(TR.connected_nodes(la, sel), "node") == [("n0",), ("n1",), ("n2",)]
    assert rows(TR.default_levels(lv)) == [("n0", 0, 3)]


def test_per_seed_bounds(spark):
    la = api(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    s = spark.createDataFrame([("a", 1), ("b", None)], "seed string, max_depth int")
    got = rows(TR.bfs(la, s, TR.DOWN), "seed", "node")
    assert got == [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), ("b", "d")]


def test_empty_graph(spark):
    lk = links(spark, [("a", "b")]).limit(0)
    nd = spark.createDataFrame([], NODE_SCHEMA)
    assert deg.most_connected(lk).count() == 0
    la = SV.api_links(lk, "all")
    assert TR.bfs(la, seeds(spark, "zz"), TR.DOWN).count() == 1
    from edgeloom.plans.search import search_graph
    res = search_graph(nd, lk, "most_connected", "all", AS_OF)
    assert res.nodes.count() == 0 and res.links.count() == 0
    res2 = search_graph(nd, lk, "unknown-node", "all", AS_OF)
    assert res2.nodes.count() == 0
    assert SV.graph_indicators(SV.api_nodes(nd, lk, "all", AS_OF), la).collect()[0]["n_nodes"] == 0


def test_suggest_and_visibility(spark):
    idx = spark.createDataFrame([("main.s1.t1", "TABLE/VIEW/PATH"), ("JOB/PIPELINE-1", "JOB/PIPELINE"),
                                 ("main.s1.t10", "TABLE/VIEW/PATH"), ("x_y", None)], "name string, type string")
    assert SV.suggest(idx, "   ").count() == 0
    assert rows(SV.suggest(idx, "S1.T1"), "name") == [("main.s1.t1",), ("main.s1.t10",)]
    assert rows(SV.suggest(idx, "job"), "name") == [("JOB/PIPELINE-1",)]
    assert SV.suggest(idx, "_").count() == 1  # literal, not a LIKE wildcard
    assert SV.find_node(idx, "main.s1.t1 (TABLE/VIEW/PATH)").count() == 1
    na = idx.select(F.col("name").alias("id"), "name", "type")
    assert SV.visible_nodes(na, [], None, hide_unselected=True).count() == 0
    assert rows(SV.visible_nodes(na, ["TABLE/VIEW/PATH"]), "id") == [("JOB/PIPELINE-1",), ("x_y",)]


def test_traversed_links_dedupe_pair(spark):
    la = api(spark, [("a", "b", "2024-01-01", "u1"), ("a", "b", "2024-01-02", "u2"), ("b", "c")])
    s = seeds(spark, "b")
    up, down = TR.bfs(la, s, TR.UP), TR.bfs(la, s, TR.DOWN)
    got = rows(TR.traversed_links(la, up, down), "source", "target", "entity_path")
    assert got == [("a", "b", "u2"), ("b", "c", None)]


def test_strict_schema_and_dashboard_deletes(spark):
    nd = spark.createDataFrame([
        ("main.a_b.t", T, "https://ws/explore/data/main/a_b/t", d("2024-01-01"), "table_lineage"),
        ("main.axb.t", T, "https://ws/explore/data/main/axb/t", d("2024-01-01"), "table_lineage"),
        ("main.a_b_old.t", T, "https://ws/explore/data/main/a_b_old/t", d("2024-01-01"), "table_lineage"),
        ("DASHBOARD-7", "DASHBOARD", "https://ws/sql/dashboardsv3/7", d("2024-01-01"), "table_lineage"),
        ("DASHBOARD-71", "DASHBOARD", "https://ws/sql/dashboards/71", d("2024-01-01"), "table_lineage"),
    ], NODE_SCHEMA)
    audit = spark.createDataFrame([
        (dt.datetime(2024, 1, 25), "deleteSchema", "catalog", "main.a_b", None, None, None, None, None),
        (dt.datetime(2024, 1, 25), "deleteDashboard", "catalog", None, None, None, None, "7", None),
    ], "event_time timestamp, action_name string, service_name string, full_name_arg string, job_id string, "
       "pipelineId string, notebookId string, dashboardId string, queryId string")
    ref = rows(P.deleted_entities(nd, P.deletions(audit, "ws", AS_OF, 30)), "node")
    assert ref == [("DASHBOARD-7",), ("main.a_b.t",), ("main.axb.t",)]
    strict = rows(P.deleted_entities(nd, P.deletions(audit, "ws", AS_OF, 30, "strict"), "strict"), "node")
    assert strict == [("DASHBOARD-7",), ("main.a_b.t",)]
    lk = links(spark, [("main.a_b.t", "x"), ("main.axb.t", "y"), ("main.a_b_old.t", "z")])
    hits_ref = P.deleted_entities(nd.limit(0), P.deletions(audit, "ws", AS_OF, 30))
    dels_ref = P.deletions(audit, "ws", AS_OF, 30).select(
        F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("node_type"),
        F.lit(None).cast("string").alias("entity_path"), "action_name", "schema_table_name")
    assert hits_ref.count() == 0
    left_ref = rows(P.match_deleted_links(lk, dels_ref), "source_node")
    assert left_ref == []  # main.a_b% also hits main.a_b_old and (via _) main.axb
    dels_strict = P.deletions(audit, "ws", AS_OF, 30, "strict").select(
        F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("node_type"),
        F.lit(None).cast("string").alias("entity_path"), "action_name", "schema_table_name")
    assert rows(P.match_deleted_links(lk, dels_strict), "source_node") == [("main.a_b_old.t",), ("main.axb.t",)]


def test_repeated_deletions_meet_a_node_once(spark, monkeypatch):
    """A schema deleted 3,000 times: one counted hit a node, and as many rows as deletions after its last event, in several tasks."""
    nd = spark.createDataFrame([("main.s.t", T, "https://ws/explore/data/main/s/t", d("2024-01-24"), "table_lineage"),
                                ("main.s.u", T, "https://ws/explore/data/main/s/u", d("2024-01-25"), "table_lineage"),
                                ("main.r.v", T, "https://ws/explore/data/main/r/v", d("2024-01-01"), "table_lineage")], NODE_SCHEMA)
    dels = spark.range(3000).select(
        F.expr("date_add(date'2024-01-25', cast(id % 2 as int))").alias("event_date"), F.lit("deleteSchema").alias("action_name"),
        F.lit("main.s%").alias("schema_table_name"), F.lit("https://ws/explore/data/main/s/%").alias("deleted_entity_path"))
    assert rows(P.deleted_entities(nd, dels, counted=True), "node", "n") == [("main.s.t", 3000), ("main.s.u", 1500)]
    monkeypatch.setattr(P, "ROWS_PER_TASK", 500)
    hit = P.deleted_entities(nd, dels)
    assert hit.rdd.getNumPartitions() == 9
    assert rows(hit.groupBy("node").count(), "node", "count") == [("main.s.t", 3000), ("main.s.u", 1500)]


def test_closure_of_a_search_is_united_while_it_holds_bits(spark, monkeypatch):
    monkeypatch.setattr(TR, "ROWS_PER_TASK", 200)
    la = api(spark, [(f"a{i}", "hub") for i in range(70)] + [("hub", f"a{i}") for i in range(0, 70, 2)] + [("a1", "x")])
    reach = TR.reach_both(la, seeds(spark, "hub", *[f"a{i}" for i in range(70)]))
    got = TR.closure(reach=reach)
    assert rows(got, "seed", "node") == rows(TR.closure(reach.rows(TR.UP), reach.rows(TR.DOWN)), "seed", "node")
    assert got.rdd.getNumPartitions() > 1 and reach.rows(TR.UP).rdd.getNumPartitions() > 1
