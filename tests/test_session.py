"""Session helpers: cluster settings, staging into the checkpoint folder."""

from edgeloom.session import cluster_conf, ensure_checkpoint_dir, stage, stage_bucketed
from tests.helpers import rows


def test_cluster_conf_scales_with_cores():
    small, big = cluster_conf(64), cluster_conf(8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 2000
    assert int(big["spark.sql.shuffle.partitions"]) == 24000
    assert big["spark.sql.sources.bucketing.enabled"] == "true"
    assert big["spark.sql.adaptive.autoBroadcastJoinThreshold"] == "64m"


def test_stage_writes_under_the_checkpoint_folder(spark):
    root = ensure_checkpoint_dir(spark)
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    staged = stage(df)
    assert rows(staged) == rows(df)
    files = staged.inputFiles()
    assert files and all("edgeloom-stages" in f and root.rstrip("/").split(":")[-1] in f for f in files)


def test_stage_bucketed_is_a_bucketed_table(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "k int, v int")
    t = stage_bucketed(df, ["k"], 4)
    assert rows(t) == rows(df)
    # a plain scan does not need the bucketing (Spark reads it unbucketed); an
    # aggregate on the bucket column does, and then needs no shuffle
    plan = t.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
