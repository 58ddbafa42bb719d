"""Table sinks and views."""

from pyspark.sql import functions as F

from edgeloom.operators import upsert as U
from edgeloom.session import stage
from edgeloom.plans.build import BuildParams, GraphBuild
from edgeloom.sources.fixtures import AS_OF, HOST, OFFSET_DAYS, UPSERT_SPLIT, WORKSPACE, Fixture
from edgeloom.sources.sinks import ensure_schema, save_or_upsert
from tests.helpers import rows

SF = "/root/testdata/sf0.001"


def table(spark, name):
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _split(fx):
    ev = fx.events()
    split = F.lit(UPSERT_SPLIT.isoformat()).cast("date")
    return ev.filter(F.col("event_date") < split), ev.filter(F.col("event_date") >= split)


def test_save_or_upsert_create_then_merge(spark, tmp_path):
    fx = Fixture(spark, SF)
    params = BuildParams(WORKSPACE, HOST, AS_OF, OFFSET_DAYS)
    first, second = _split(fx)
    g1 = GraphBuild(first, params, fx.inventory(), fx.legacy())
    g2 = GraphBuild(second, params, fx.inventory(), fx.legacy())
    ensure_schema(spark, "sink_t", str(tmp_path / "wh"))
    r1 = save_or_upsert(g1.links(), "sink_t.links", U.LINK_KEYS, U.ORDER_COL)
    assert r1["created"]
    r2 = save_or_upsert(g2.links(), "sink_t.links", U.LINK_KEYS, U.ORDER_COL)
    m = {r["action"]: r["rows"] for r in U.upsert_metrics(g1.links(), g2.links(), U.LINK_KEYS).collect()}
    assert (r2["inserted"], r2["updated"]) == (m.get("inserted", 0), m.get("updated", 0))
    cols = g1.links().columns                    # the date is the table's partition column and stands last
    assert rows(spark.table("sink_t.links"), *cols) == rows(U.upsert(g1.links(), g2.links(), U.LINK_KEYS))
    cut = F.lit("2024-01-21").cast("date")
    now = spark.table("sink_t.links")
    old = U.upsert(stage(now), g2.links(), U.LINK_KEYS).filter(F.col("last_event_date") < cut).count()
    r3 = save_or_upsert(g2.links(), "sink_t.links", U.LINK_KEYS, U.ORDER_COL, keep_from=cut)
    assert r3["retired"] == old > 0
    assert spark.table("sink_t.links").filter(F.col("last_event_date") < cut).count() == 0
    assert spark.table("sink_t.links").count() > 0


def test_persistent_view(spark, tmp_path):
    from edgeloom.sources.sinks import publish
    ensure_schema(spark, "view_t", str(tmp_path / "wh"))
    a = spark.createDataFrame([(1,), (2,)], "x int")
    v = publish(a, "view_t.vw", table="view_t.vw_data")
    assert rows(v) == [(1,), (2,)]
    publish(spark.table("view_t.vw").filter("x = 2"), "view_t.vw", table="view_t.vw_data")       # may read itself
    assert rows(spark.newSession().table("view_t.vw")) == [(2,)]


def test_staged_buckets_are_one_file_each_and_scopes_clean_up(spark):
    import os

    from edgeloom.session import stage, stage_bucketed, staging_scope
    df = spark.range(5000).repartition(20).selectExpr("id % 100 AS k", "id")
    with staging_scope(spark):
        b, s = stage_bucketed(df, ["k"], 6), stage(df)
        files = [f.replace("file://", "").replace("file:", "") for f in b.inputFiles() + s.inputFiles()]
        assert len(b.inputFiles()) <= 6 and b.count() == s.count() == 5000
        tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("edgeloom_stage_")}
        assert all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files)
    left = {t.name for t in spark.catalog.listTables()}
    assert len(tables - left) == 1


def test_publish_and_export(spark, tmp_path):
    from edgeloom.operators.serve import api_links, api_nodes
    from edgeloom.sources.sinks import publish, write_graph_json
    fx = Fixture(spark, SF)
    g = GraphBuild(fx.events(), BuildParams(WORKSPACE, HOST, AS_OF, OFFSET_DAYS), fx.inventory(), fx.legacy())
    v = publish(g.links(), "vw_test_links")
    assert spark.table("vw_test_links").count() == v.count() == g.links().count()
    out = str(tmp_path / "graph")
    write_graph_json(api_nodes(g.nodes(), g.links(), "all", AS_OF), api_links(g.links(), "all"), out)
    back = spark.read.json(f"{out}/kind=link")
    assert back.count() == g.links().count()
    assert set(back.columns) == {"source", "target", "entity_path", "source_type", "target_type",
                                 "last_event_date", "lineage_source_table"}


def test_recover_half_done_swap(spark, tmp_path):
    from edgeloom.sources.sinks import overwrite_via_staging, recover_swap
    ensure_schema(spark, "swap_t", str(tmp_path / "wh"))
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(3,)], "x int")
    overwrite_via_staging(a, "swap_t.t")
    # a driver died after the staging table was complete, before the target was replaced
    b.write.saveAsTable("swap_t.t__staging")
    spark.sql("ALTER TABLE swap_t.t__staging SET TBLPROPERTIES ('edgeloom.swap' = 'ready')")
    recover_swap(spark, "swap_t.t")
    assert rows(table(spark, "swap_t.t")) == [(3,)]
    assert not spark.catalog.tableExists("swap_t.t__staging")
    # a driver died while writing the staging table: it is dropped, the target stays
    a.write.saveAsTable("swap_t.t__staging")
    recover_swap(spark, "swap_t.t")
    assert rows(table(spark, "swap_t.t")) == [(3,)]
    assert not spark.catalog.tableExists("swap_t.t__staging")


LINK = ("source_node string, source_node_type string, target_node string, target_node_type string, entity_path string, "
        "last_event_date date, lineage_source_table string")


def _links(spark, *rs):
    """(source, target, date[, path])"""
    out = [(r[0], "T", r[1], "T", r[3] if len(r) > 3 else "p", r[2], "tag") for r in rs]
    return spark.createDataFrame(out, "a string, b string, c string, d string, e string, f string, g string").selectExpr(
        "a source_node", "b source_node_type", "c target_node", "d target_node_type", "e entity_path",
        "cast(f as date) last_event_date", "g lineage_source_table")


def _files(spark, name):
    """Data files by partition."""
    spark.catalog.refreshTable(name)
    out = {}
    for f in spark.table(name).inputFiles():
        out.setdefault(f.split("last_event_date=")[1].split("/")[0], set()).add(f.rsplit("/", 1)[1])
    return out


def test_upsert_rewrites_only_the_dates_it_changes(spark, tmp_path):
    ensure_schema(spark, "part_t", str(tmp_path / "wh"))
    t = "part_t.links"
    first = _links(spark, ("a", "b", "2024-01-01"), ("c", "d", "2024-01-02"), ("e", "f", "2024-01-03"), ("g", "h", "2024-01-04"),
                   ("i", "j", None), ("k", "l", "9999-12-31"), ("m", "n", "2024-01-05", None))
    save_or_upsert(first, t, U.LINK_KEYS, U.ORDER_COL)
    before = _files(spark, t)
    assert set(before) == {"2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "9999-12-31", "__HIVE_DEFAULT_PARTITION__"}
    batch = _links(spark, ("a", "b", "2024-01-06"),              # leaves its date, which is then empty
                   ("c", "d", "2024-01-02"),                     # changes nothing
                   ("e", "f", "2023-12-31"),                     # older than the target: guarded
                   ("k", "l", "9999-12-31"), ("i", "j", "2024-01-06"),      # a NULL date fails the guard
                   ("x", "y", "2024-01-04"), ("m", "n", "2024-01-05", None))  # new; a NULL key never matches
    want = rows(U.upsert(first, batch, U.LINK_KEYS))
    got = save_or_upsert(batch, t, U.LINK_KEYS, U.ORDER_COL)
    after = _files(spark, t)
    assert rows(table(spark, t), *first.columns) == want
    m = {r["action"]: r["rows"] for r in U.upsert_metrics(first, batch, U.LINK_KEYS).collect()}
    assert (got["inserted"], got["updated"]) == (m["inserted"], m["updated"]) == (2, 3)
    assert "2024-01-01" not in after and "2024-01-06" in after
    for d in ("2024-01-02", "2024-01-03", "9999-12-31", "__HIVE_DEFAULT_PARTITION__"):
        assert after[d] == before[d], d                          # the same files
    for d in ("2024-01-04", "2024-01-05"):
        assert after[d] != before[d]
    assert not [x for x in spark.catalog.listTables("part_t") if "__staging" in x.name]


def test_upsert_null_safe_moves_out_of_the_null_date(spark, tmp_path):
    """Strict mode: NULL keys match; a replaced partition of NULL dates that ends empty is dropped."""
    ensure_schema(spark, "null_t", str(tmp_path / "wh"))
    t = "null_t.links"
    first = _links(spark, ("a", "b", "2024-01-01", None), ("c", "d", None))
    save_or_upsert(first, t, U.LINK_KEYS, U.ORDER_COL, null_safe=True)
    batch = _links(spark, ("a", "b", "2024-01-02", None), ("e", "f", None))
    want = rows(U.upsert(first, batch, U.LINK_KEYS, null_safe=True))
    save_or_upsert(batch, t, U.LINK_KEYS, U.ORDER_COL, null_safe=True)
    assert rows(table(spark, t), *first.columns) == want
    from edgeloom.sources import sinks
    sinks.replace_partitions(spark, t, spark.table(t).filter("last_event_date is null").limit(0), [None], sinks.version(spark, t))
    assert set(_files(spark, t)) == {"2024-01-02"}


def test_retention_drops_partitions_without_writing(spark, tmp_path):
    from edgeloom.sources import sinks
    ensure_schema(spark, "ret_t", str(tmp_path / "wh"))
    t = "ret_t.links"
    first = _links(spark, ("a", "b", "2024-01-01"), ("c", "d", "2024-01-01"), ("e", "f", "2024-01-02"), ("g", "h", "2024-01-03"), ("i", "j", None))
    save_or_upsert(first, t, U.LINK_KEYS, U.ORDER_COL)
    before, seen = _files(spark, t), []
    n = sinks.retire_partitions(spark, t, "2024-01-03", lambda b, a: seen.append((b.count(), a.count())))
    assert n == 3 and seen == [(3, 0)]
    assert _files(spark, t) == {d: before[d] for d in ("2024-01-03", "__HIVE_DEFAULT_PARTITION__")}
    assert rows(table(spark, t), *first.columns) == rows(U.retain(first, "2024-01-05", 2))
    assert sinks.retire_partitions(spark, t, "2024-01-03") == 0


def test_two_runs_do_not_destroy_each_other(spark, tmp_path):
    import pytest

    from edgeloom.sources import sinks
    ensure_schema(spark, "two_t", str(tmp_path / "wh"))
    t = "two_t.links"
    a = _links(spark, ("a", "b", "2024-01-01"))
    save_or_upsert(a, t, U.LINK_KEYS, U.ORDER_COL)
    read = sinks.version(spark, t)
    live = sinks._staging_name(t)                                # another run is writing its staging table
    a.write.saveAsTable(live)
    save_or_upsert(_links(spark, ("c", "d", "2024-01-02")), t, U.LINK_KEYS, U.ORDER_COL)
    assert spark.catalog.tableExists(live)
    with pytest.raises(sinks.TableChanged):                      # it read the table before: its write is refused
        sinks.replace_partitions(spark, t, a, ["2024-01-01"], read)
    assert table(spark, t).count() == 2
    spark.sql(f"ALTER TABLE {live} SET TBLPROPERTIES ('edgeloom.swap' = 'ready', 'edgeloom.owner' = 'app-2', 'edgeloom.dates' = '[\"2024-01-02\"]')")
    with pytest.raises(sinks.TableChanged):                      # another application is swapping it in
        sinks.recover_swap(spark, t)
    sinks.recover_swap(spark, t, dead=("app-2",))                # known dead: its partition is put in place
    assert not spark.catalog.tableExists(live)
    assert [str(r.last_event_date) for r in table(spark, t).collect()] == ["2024-01-01"]      # and the date it names is empty now
    old = t + "__staging_1000_abc"
    a.write.saveAsTable(old)
    sinks.recover_swap(spark, t)                                 # left unfinished long ago
    assert not spark.catalog.tableExists(old)


def test_overwrite_keeps_the_partition_column(spark, tmp_path):
    from edgeloom.sources import sinks
    ensure_schema(spark, "keep_t", str(tmp_path / "wh"))
    t = "keep_t.links"
    save_or_upsert(_links(spark, ("a", "b", "2024-01-01"), ("c", "d", "2024-01-02")), t, U.LINK_KEYS, U.ORDER_COL)
    sinks.overwrite_via_staging(spark.table(t).filter("source_node = 'a'"), t)
    assert sinks.partition_column(spark, t) == "last_event_date" and sinks.partitions(spark, t) == ["2024-01-01"]


def test_a_hot_date_is_split_by_its_size(spark, tmp_path):
    """Most rows on one date: its files follow from its size, not from a fixed number."""
    from edgeloom.sources import sinks
    ensure_schema(spark, "hot_t", str(tmp_path / "wh"))
    df = spark.range(60_000).selectExpr("concat('n', id, '-', uuid()) source_node", "cast(if(id < 55000, '9999-12-31', '2024-01-01') as date) last_event_date")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sinks.create_table(df.repartition(8), "hot_t.t", "last_event_date")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    files = _files(spark, "hot_t.t")
    assert len(files["9999-12-31"]) >= 3 and len(files["2024-01-01"]) == 1


def test_name_index_gives_the_same_suggestions(spark):
    from edgeloom.operators.serve import name_index, suggest, suggest_from
    names = [(f"main.s{i % 7}.t{i}", ["TABLE/VIEW/PATH", "JOB", "NOTEBOOK"][i % 3]) for i in range(60)]
    names += [("main.s1.t1", "JOB"), ("main.s1.t1", "JOB"), ("A%b_c", "JOB"), ("ab", None), (None, "PATHS"), ("", "JOB"), ("İstanbul", "JOB")]
    index = spark.createDataFrame(names, "name string, type string")
    made = name_index(index)
    for text in ("s1.t1", "MAIN.", "job", "path", "table/view", "%b_", "ab", "t", " ", "", None, "zzz", "main.s1.t1", "note", "aaa", "i̇st", "s1.t15"):
        assert rows_in_order(suggest_from(made, text)) == rows_in_order(suggest(index, text)), text
    assert rows_in_order(suggest_from(made, "main", 50)) == rows_in_order(suggest(index, "main", 50))
    p = suggest_from(made, "s1.t1")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(gram" in p and "WindowGroupLimit" not in p        # only the posting lists of the text's grams; the types' first entries are staged


def rows_in_order(df):
    return [tuple(r) for r in df.collect()]


def test_graph_index_matches_one_off_search(spark):
    from edgeloom.plans.search import GraphIndex, search_graph
    fx = Fixture(spark, SF)
    g = GraphBuild(fx.events(), BuildParams(WORKSPACE, HOST, AS_OF, OFFSET_DAYS), fx.inventory(), fx.legacy())
    idx = GraphIndex.build(g.nodes(), g.links(), "all", AS_OF)
    one = search_graph(g.nodes(), g.links(), "most_connected", "all", AS_OF)
    res = idx.search("most_connected")
    assert rows(res.nodes) == rows(one.nodes) and rows(res.links) == rows(one.links)
    named = idx.search("main.s0.t0")
    assert rows(named.nodes) == rows(search_graph(g.nodes(), g.links(), "main.s0.t0", "all", AS_OF).nodes)
    seeds = spark.createDataFrame([("main.s0.t0",), ("main.s1.t1",)], "seed string")
    many = idx.search_many(seeds)
    assert {r.search_target for r in many.nodes.select("search_target").distinct().collect()} <= {"main.s0.t0",
                                                                                                 "main.s1.t1"}
    sel = idx.selection(seeds)
    assert sel["indicators"].count() == sel["connected"].select("seed").distinct().count()
    assert idx.suggest("s1.t1").count() <= 5
