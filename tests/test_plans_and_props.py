"""Plan-shape checks and property tests."""

import contextlib
import io
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeloom.operators import links as L
from edgeloom.operators import traverse as TR
from edgeloom.operators import upsert as U
from edgeloom.sources.synthetic import synthetic_dag
from tests.helpers import api, links, rows, seeds

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def lazy_ctx(spark):
    from edgeloom.plans import registry
    registry.load_all()
    c = registry.Ctx(spark, SF)
    c.g.materialize = False
    return c


PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
LOOP_JOINS = ("BroadcastNestedLoopJoin", "CartesianProduct")


@pytest.mark.parametrize("name", ["edge_not_null", "objects_union", "break_two_cycles", "nodes_build",
                                  "total_connections", "most_connected", "api_nodes", "deleted_entities",
                                  "merge_delete_links", "delete_orphan_links", "delete_orphan_nodes",
                                  "links_upsert", "graph_export", "non_compliant_nodes"])
def test_no_python_and_no_loop_join(lazy_ctx, name):
    from edgeloom.plans import registry
    p = plan(registry.REGISTRY[name].fn(lazy_ctx))
    assert not any(x in p for x in PY_NODES), p
    assert not any(x in p for x in LOOP_JOINS), p


def test_event_scan_pushdown_and_pruning(lazy_ctx):
    from edgeloom.plans import registry
    p = plan(registry.REGISTRY["edge_events_max"].fn(lazy_ctx))
    scan = [ln for ln in p.splitlines() if "PushedFilters" in ln]
    assert scan, p
    # props/value/user_id columns that the lineage view never needs are pruned
    read = [ln for ln in p.splitlines() if "ReadSchema" in ln][0]
    assert "value" not in read
    # the raw events table has no workspace/date columns (they are derived), so
    # the check here is that the derived filters sit directly above the scan
    assert "Filter" in p


def test_event_date_filter_reaches_scan(spark, tmp_path):
    """On a lineage log stored with real columns, the window filter is pushed down."""
    from edgeloom.operators.edges import filter_events
    from edgeloom.sources.fixtures import Fixture
    path = str(tmp_path / "lineage")
    Fixture(spark, SF).events().write.partitionBy("event_date").parquet(path)
    df = filter_events(spark.read.parquet(path), "w1", "2024-02-10", 30)
    p = plan(df)
    assert "PartitionFilters: [isnotnull(event_date" in p and "2024-01-11" in p
    assert "workspace_id" in [ln for ln in p.splitlines() if "PushedFilters" in ln][0]


def test_bfs_adjacency_not_shuffled(spark):
    la = api(spark, [("a", "b"), ("b", "c")])
    adj = TR.adjacency(la)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        f = spark.createDataFrame([("down", "a", 0)], "_dir string, node string, _salt int")
        st_ = adj.steps
        p = plan(f.join(st_, (f["_dir"] == st_["_dir"]) & (f["node"] == st_["_from"]) & (f["_salt"] == st_["_salt"])),
                 "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in p


# ----------------------------------------------------------------- properties
names = st.sampled_from(list("abcdef"))
edge_lists = st.lists(st.tuples(names, names), min_size=1, max_size=10)
dates = st.sampled_from(["2024-01-01", "2024-01-02", "2024-01-03"])
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@SLOW
@given(st.lists(st.tuples(names, names, dates), min_size=1, max_size=8),
       st.lists(st.tuples(names, names, dates), min_size=1, max_size=8))
def test_upsert_idempotent_and_monotone(spark, t_rows, s_rows):
    t = L.break_two_cycles(links(spark, [(a, b, d, "u") for a, b, d in t_rows]))
    s = L.break_two_cycles(links(spark, [(a, b, d, "u") for a, b, d in s_rows]))
    once = U.upsert(t, s, U.LINK_KEYS)
    twice = U.upsert(once, s, U.LINK_KEYS)
    assert rows(once) == rows(twice)
    before = {(r.source_node, r.target_node): r.last_event_date for r in t.collect()}
    for r in once.collect():
        k = (r.source_node, r.target_node)
        if k in before:
            assert r.last_event_date >= before[k]


@SLOW
@given(st.lists(st.tuples(names, names, dates), min_size=1, max_size=12))
def test_no_pair_twice_after_two_cycle_break(spark, rs):
    out = L.break_two_cycles(links(spark, rs), "strict").collect()
    pairs = [tuple(sorted((r.source_node, r.target_node))) for r in out]
    assert len(pairs) == len(set(pairs))
    assert {tuple(sorted((a, b))) for a, b, _ in rs} == set(pairs)


def _reach(edges, start, up):
    seen, frontier = {start: 0}, [start]
    while frontier:
        nxt = []
        for n in frontier:
            for a, b in edges:
                m = a if up and b == n else b if (not up and a == n) else None
                if m is not None and m not in seen:
                    seen[m] = seen[n] + 1
                    nxt.append(m)
        frontier = nxt
    return seen


@SLOW
@given(edge_lists)
def test_bfs_matches_brute_force_and_symmetry(spark, edges):
    la = api(spark, edges)
    nodes = sorted({x for e in edges for x in e})
    up, down = TR.bfs_both(la, seeds(spark, *nodes), hops=edges.__len__() % 3 + 1)  # 1..3 levels per job
    up_r = {(r.seed, r.node): r.depth for r in up.collect()}
    down_r = {(r.seed, r.node): r.depth for r in down.collect()}
    for s in nodes:
        assert {n: d for (x, n), d in down_r.items() if x == s} == _reach(edges, s, False)
        assert {n: d for (x, n), d in up_r.items() if x == s} == _reach(edges, s, True)
    for a, b in itertools.product(nodes, nodes):
        assert ((a, b) in up_r) == ((b, a) in down_r)


@SLOW
@given(edge_lists)
def test_bounded_bfs_grows_to_unbounded(spark, edges):
    la = api(spark, edges)
    s = seeds(spark, edges[0][0])
    full = rows(TR.bfs(la, s, TR.DOWN), "node", "depth")
    mx = max(d for _, d in full)
    prev = 0
    for k in range(mx + 1):
        got = rows(TR.bfs(la, s, TR.DOWN, max_depth=k), "node", "depth")
        assert len(got) >= prev and all(d <= k for _, d in got)
        prev = len(got)
    assert got == full


def test_synthetic_dag_links_go_forward(spark):
    nodes, lk = synthetic_dag(spark, 200, seed=7)
    assert nodes.count() == 200 and lk.count() == 199
    idx = F.expr("cast(substring(source, 6) as int)"), F.expr("cast(substring(target, 6) as int)")
    assert lk.filter(idx[1] <= idx[0]).count() == 0
    assert lk.filter(idx[1] > 199).count() == 0
    assert nodes.filter(F.length("name") != 5).count() == 0
    assert {r.type for r in nodes.select("type").distinct().collect()} <= {"Job", "Notebook", "Table", "Dashboard",
                                                                           "Dataset"}
    n2, _ = synthetic_dag(spark, 200, seed=7)
    assert rows(nodes) == rows(n2)


def test_hub_is_salted_and_bfs_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(TR, "MIN_HOT_STEPS", 4)
    monkeypatch.setattr(TR, "STEPS_PER_BUCKET", 50)  # several buckets even for this small graph
    # the hub holds most of the steps (far more than an average bucket)
    edges = [("hub", f"l{i}") for i in range(100)] + [(f"l{i}", f"m{i % 5}") for i in range(10)] + [("r", "hub")]
    la = api(spark, edges)
    adj = TR.adjacency(la)
    assert adj.hot is not None
    hot = {(r["_dir"], r["_from"]): r["_salts"] for r in adj.hot.collect()}
    assert hot[("down", "hub")] >= 2
    assert adj.steps.select("_salt").distinct().count() > 1
    up, down = TR.bfs_both(la, seeds(spark, "r", "hub", "m1"), adj=adj)
    down_r = {(r.seed, r.node): r.depth for r in down.collect()}
    up_r = {(r.seed, r.node): r.depth for r in up.collect()}
    for s in ("r", "hub", "m1"):
        assert {n: d for (x, n), d in down_r.items() if x == s} == _reach(edges, s, False)
        assert {n: d for (x, n), d in up_r.items() if x == s} == _reach(edges, s, True)


def test_one_level_jobs_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(TR, "SMALL_FRONTIER", 0)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n5", "n2"), ("n9", "x"), ("x", "n1")]
    la = api(spark, edges)
    up, down = TR.bfs_both(la, seeds(spark, "n0", "n7"))
    down_r = {(r.seed, r.node): r.depth for r in down.collect()}
    up_r = {(r.seed, r.node): r.depth for r in up.collect()}
    for s in ("n0", "n7"):
        assert {n: d for (x, n), d in down_r.items() if x == s} == _reach(edges, s, False)
        assert {n: d for (x, n), d in up_r.items() if x == s} == _reach(edges, s, True)


def test_repeated_seeds_take_the_largest_bound(spark):
    la = api(spark, [(f"n{i}", f"n{i + 1}") for i in range(9)])
    sel = spark.createDataFrame([("n0", 0, 2), ("n0", 0, 5), ("n3", None, 1), ("n3", 1, 1), ("n6", 0, 0)],
                                "seed string, up_level int, down_level int")
    got = {}
    for r in TR.connected_nodes(la, sel).collect():
        got.setdefault(r.seed, set()).add(r.node)
    assert got == {"n0": {f"n{i}" for i in range(6)}, "n3": {f"n{i}" for i in range(5)}, "n6": {"n6"}}


def test_bounded_search_plans_no_level_beyond_its_bound(spark, monkeypatch):
    planned = []
    real = TR._Wave.plan
    monkeypatch.setattr(TR._Wave, "plan", lambda self, hops, active=None: planned.append(hops) or real(self, hops, active))
    la = api(spark, [(f"n{i}", f"n{i + 1}") for i in range(9)])
    assert TR.bfs(la, seeds(spark, "n0"), TR.DOWN, 1).count() == 2
    assert TR.bfs(la, seeds(spark, "n0"), TR.DOWN, 6).count() == 7
    assert TR.bfs(la, seeds(spark, "n9"), TR.DOWN).count() == 1         # no step leads on: no job
    assert planned == [1, 4, 2]


def test_every_level_of_a_job_is_joined_once(spark):
    la = api(spark, [(f"n{i}", f"n{i + 1}") for i in range(9)])
    adj = TR.adjacency(la, TR.DOWN)
    wave = TR._Wave(adj, TR._start(seeds(spark, "n0"), TR.DOWN, None))
    table = adj.steps._jdf.queryExecution().analyzed().toString().split("edgeloom_stage_")[1][:32]
    for hops in (1, 2, 4):
        p = wave.plan(hops)._jdf.queryExecution().executedPlan().toString()
        assert p.count(f"edgeloom_stage_{table}") == hops
    frame = {(r["node"], r["depth"], r["bits"]) for r in wave.plan(4).collect()}
    assert frame == {(f"n{i}", i, 1) for i in range(1, 5)}


def test_seeds_share_rows(spark):
    """200 seeds into one hub: the hub's steps are taken once per group of 64 seeds, not once per seed."""
    edges = [(f"s{i}", "hub") for i in range(200)] + [("hub", f"t{i}") for i in range(50)] + [("t0", "s0")]
    la = api(spark, edges)
    adj = TR.adjacency(la)
    s = seeds(spark, *[f"s{i}" for i in range(200)])
    reach = TR.search(adj, TR._start(s, TR.DOWN, None))
    groups = -(-200 // TR.GROUP)
    held = {r["depth"]: r["n"] for r in reach.deltas.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert held[0] == 200 and held[1] == groups and held[2] == 50 * groups
    got = {}
    for r in reach.rows(TR.DOWN).collect():
        assert got.setdefault((r.seed, r.node), r.depth) == r.depth
    want = {(f"s{i}", n): d for i in range(200) for n, d in _reach(edges, f"s{i}", False).items()}
    assert got == want
    lv = {r["seed"]: r["depth"] for r in reach.levels().collect()}
    assert lv == {f"s{i}": max(d for (x, _), d in want.items() if x == f"s{i}") for i in range(200)}


def test_groups_keep_their_own_bounds(spark):
    la = api(spark, [(f"n{i}", f"n{i + 1}") for i in range(12)])
    s = spark.createDataFrame([(f"n{i}", i % 4 if i % 5 else None) for i in range(12)], "seed string, max_depth int")
    got = {}
    for r in TR.bfs(la, s, TR.DOWN).collect():
        got.setdefault(r.seed, {})[r.node] = r.depth
    for i in range(12):
        most = i % 4 if i % 5 else 99
        assert got[f"n{i}"] == {f"n{j}": j - i for j in range(i, min(12, i + most) + 1)}


@SLOW
@given(edge_lists)
def test_two_sided_depth_equals_the_closure(spark, edges):
    la = api(spark, edges)
    adj = TR.adjacency(la)
    ends = sorted({n for e in edges for n in e}) + ["unknown", None]
    pairs = spark.createDataFrame(list(itertools.product(ends, ends)) + [("a", "b")] * 2, "seed string, node string")
    for direction, up in ((TR.DOWN, False), (TR.UP, True)):
        got = sorted(map(str, map(tuple, TR.node_depth(la, pairs, direction, adj=adj).collect())))
        want = [(a, b, _reach(edges, a, up).get(b, 0) if a else 0) for a, b in [tuple(r) for r in pairs.collect()]]
        assert got == sorted(map(str, want))


def test_two_sided_depth_visits_less(spark):
    """A tree of 1,093 nodes and a chain into it: the nodes' side is narrow, so the seed's closure is never made."""
    edges = [(f"t{(i - 1) // 3}", f"t{i}") for i in range(1, 1093)]
    la = api(spark, edges)
    adj = TR.adjacency(la)
    pairs = spark.createDataFrame([("t0", "t1092"), ("t0", "t400"), ("t5", "t0")], "seed string, node string")
    visited = {}
    got = {(r.seed, r.node): r.depth for r in TR.node_depth(la, pairs, TR.DOWN, adj=adj, visited=visited).collect()}
    assert got == {("t0", "t1092"): 6, ("t0", "t400"): 6, ("t5", "t0"): 0}
    assert visited["rows"] < 100 < TR.bfs(la, seeds(spark, "t0"), TR.DOWN, adj=adj).count()


def test_patterns_do_not_share_a_key(spark):
    from edgeloom.operators.patterns import bucket_patterns, like_join
    host = "https://workspace-with-a-rather-long-name.example.net"
    pats = [f"{host}/sql/dashboards%/{i:08x}-77aa" for i in range(500)] + [f"{host}/explore/data/main/s{i}/%" for i in range(500)]
    pats += ["%x%", "plain", "a\\%b", "s1%"]
    p = spark.createDataFrame([(x,) for x in pats], "p string")
    keys = bucket_patterns(p, "p")
    assert keys.count() == len(pats)
    assert keys.groupBy("_kind", "_arg", "_bkey").count().agg(F.max("count")).first()[0] <= 2
    values = [f"{host}/sql/dashboards/00000007-77aa", f"{host}/sql/dashboardsv3/000001f3-77aa", f"{host}/explore/data/main/s7/t",
              f"{host}/explore/data/main/s77", "plain", "axb", "s10", None, "", "a%b"]
    v = spark.createDataFrame([(x,) for x in values], "v string")
    got = sorted((r.v, r.p) for r in like_join(v, "v", p, "p").collect())
    want = sorted((r.v, r.p) for r in v.join(p, F.expr("v LIKE p")).collect())
    assert got == want and len(got) >= 6


def test_bucketed_visited_anti_join_shuffles_neither_side(spark):
    from edgeloom.session import stage_bucketed
    key = ["seed", "_dir", "node"]
    visited = stage_bucketed(spark.createDataFrame([("a", "down", f"n{i}") for i in range(20)],
                                                   "seed string, _dir string, node string"), key)
    cand = spark.createDataFrame([("a", "down", f"n{i}", 3) for i in range(10, 30)],
                                 "seed string, _dir string, node string, depth int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(cand.dropDuplicates(key).join(visited, key, "left_anti"), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    # one shuffle: the candidates' distinct; the bucketed visited side is read in place
    assert p.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in p and "LeftAnti" in p


def test_only_asked_rows_meet_the_ids(spark):
    """Rows that NOT IN does not concern are in branches without an exchange; NULL semantics as in SQL."""
    from edgeloom.operators import purge as P
    t = "TABLE/VIEW/PATH"
    data = [("a", t, "j1", "JOB"), ("x", t, "a", t), ("j1", "JOB", "j2", "JOB"), (None, t, "a", t), ("a", None, "x", t), ("s3://p", t, "a", t),
            ("j1", "JOB", "x", t), ("a", t, "b", t)]
    links = spark.createDataFrame(data, "source_node string, source_node_type string, target_node string, target_node_type string")
    nodes = links.selectExpr("source_node node", "source_node_type node_type").distinct()
    links.createOrReplaceTempView("t_links")
    nodes.createOrReplaceTempView("t_nodes")
    for held in (["a", "b"], [], ["a", None]):
        ids = spark.createDataFrame([(i,) for i in held], "table_id string")
        ids.createOrReplaceTempView("t_ids")
        # each end on its own, as Spark takes one NOT IN subquery a filter
        src = spark.sql(f"SELECT * FROM t_links WHERE source_node_type = '{t}' AND source_node NOT IN (SELECT table_id FROM t_ids)")
        tgt = spark.sql(f"SELECT * FROM t_links WHERE target_node_type = '{t}' AND target_node NOT IN (SELECT table_id FROM t_ids)")
        want = sorted(map(str, (tuple(r) for r in links.exceptAll(src.union(tgt).distinct()).collect())))
        assert sorted(str(tuple(r)) for r in P.drop_orphan_links(links, ids).select(*links.columns).collect()) == want
        flagged = P.flag_orphans(links, ids, P.LINK_ENDS).filter(~F.col("_orphan")).drop("_orphan")
        assert sorted(str(tuple(r)) for r in flagged.collect()) == want
        asked = spark.sql(f"SELECT * FROM t_nodes WHERE node_type = '{t}' AND node NOT IN (SELECT table_id FROM t_ids)")
        assert sorted(map(str, P.orphan_nodes(nodes, ids).collect())) == sorted(map(str, asked.collect()))
    ids = spark.createDataFrame([("a",), ("b",)], "table_id string")
    big = spark.range(10).selectExpr("concat('n', id) node", f"if(id % 2 = 0, '{t}', 'JOB') node_type")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = P.drop_orphan_nodes(big, ids)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert p.count("Exchange hashpartitioning") == 2 and "Union" in p       # the asked nodes and the ids; the rest is not moved
    assert p.index("Union") < p.index("Exchange hashpartitioning")


@pytest.mark.parametrize("narrow", [3, 1000])
def test_nodes_that_all_seeds_reached_are_closed(spark, monkeypatch, narrow):
    """70 seeds reach a clique through a hub: no job follows the clique's steps for each group. Exact, with one or more groups a row."""
    monkeypatch.setattr(TR, "SMALL_FRONTIER", 20)
    monkeypatch.setattr(TR, "SMALL_SEARCH", 20)
    monkeypatch.setattr(TR, "NARROW", narrow)
    ring = [f"t{i}" for i in range(12)]
    edges = ([(f"s{i}", "hub") for i in range(70)] + [("hub", t) for t in ring] + [(a, b) for a in ring for b in ring if a != b]
             + [("t3", "u0"), ("u0", "u1"), ("u1", "t0"), ("s5", "t1"), ("s6", "v"), ("v", "u1")])
    la = api(spark, edges)
    adj = TR.adjacency(la)
    start = [f"s{i}" for i in range(70)]
    met, real = [], TR._Wave.advance

    def advance(self, hops, active=None):
        real(self, hops, active)
        met.append(None if self.few is None else self.few.count())
    monkeypatch.setattr(TR._Wave, "advance", advance)
    reach = TR.reach_both(la, seeds(spark, *start), adj=adj)
    assert reach.words == (TR.WORDS if narrow == 3 else 1) and any(n is not None and n <= adj.total // 20 for n in met)
    for direction, up in ((TR.DOWN, False), (TR.UP, True)):
        want = {(s, n): d for s in start for n, d in _reach(edges, s, up).items()}
        assert {(r.seed, r.node): r.depth for r in reach.rows(direction).collect()} == want
        assert reach.rows(direction).count() == len(want)
    both = {(s, n) for s in start for up in (True, False) for n in _reach(edges, s, up)}
    assert sorted((r.seed, r.node) for r in reach.nodes().collect()) == sorted(both)
    lv = {r["seed"]: (r["max_upstream"], r["max_downstream"]) for r in TR.max_levels(la, seeds(spark, *start), reach=reach).collect()}
    assert lv == {s: tuple(max(_reach(edges, s, up).values()) for up in (True, False)) for s in start}


def test_steps_that_grow_are_followed_level_by_level(spark, monkeypatch):
    """In a large search a job's levels are foreseen: the hub's level, and what follows it, is no part of a job of several."""
    monkeypatch.setattr(TR, "SMALL_FRONTIER", 50)
    monkeypatch.setattr(TR, "SMALL_SEARCH", 50)
    planned, real = [], TR._Wave.plan
    monkeypatch.setattr(TR._Wave, "plan", lambda self, hops, active=None: planned.append(hops) or real(self, hops, active))
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    edges = chain + [("c9", f"x{i}") for i in range(30)] + [(f"x{i}", f"y{j}") for i in range(30) for j in range(3)]
    got = {(r.node, r.depth) for r in TR.bfs(api(spark, edges), seeds(spark, "c0"), TR.DOWN).collect()}
    assert got == set(_reach(edges, "c0", False).items()) and planned == [1, 4, 4, 1, 1]


def test_many_rows_per_seed_are_made_by_a_bounded_number_of_tasks(spark, monkeypatch):
    """The tasks that list a search's rows grow by a tenth of its rows where there would be many; the rows are the same."""
    monkeypatch.setattr(TR, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(TR, "MANY_TASKS", 3, raising=False)
    edges = [(f"s{i}", "hub") for i in range(70)] + [("hub", f"t{i}") for i in range(8)]
    reach = TR.search(TR.adjacency(api(spark, edges)), TR._start(seeds(spark, *[f"s{i}" for i in range(70)]), TR.DOWN, None))
    assert reach.held == 700
    got = reach.rows(TR.DOWN)
    assert "RoundRobinPartitioning(7)" in got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert {(r.seed, r.node): r.depth for r in got.collect()} == {(f"s{i}", n): d for i in range(70) for n, d in _reach(edges, f"s{i}", False).items()}
