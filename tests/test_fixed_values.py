"""The fixed values that both the operators and the oracle read, held against literals."""
from pyspark.sql import functions as F

from edgeloom.functions.columns import entity_url, normalize_type
from edgeloom.operators.purge import deleted_path


def test_node_types(spark):
    want = {"TABLE": "TABLE/VIEW/PATH", "VIEW": "TABLE/VIEW/PATH", "PATH": "TABLE/VIEW/PATH", "STREAMING_TABLE": "TABLE/VIEW/PATH"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.n for r in df.select("t", normalize_type("t").alias("n")).collect()} == want


def test_deletion_urls(spark):
    params = {k: k for k in ("full_name_arg", "job_id", "pipelineId", "notebookId", "dashboardId", "queryId")}
    rows = [("deleteTable", "unityCatalog"), ("deleteSchema", "unityCatalog"), ("deleteJob", "jobs"), ("delete", "clusters")]
    df = spark.createDataFrame([(*r, "main.s1", "7", "7", "7", "7", "7") for r in rows],
                               "a string, s string, " + ", ".join(f"{k} string" for k in params))
    got = [r[0] for r in df.select(deleted_path("a", "s", params, "ws")).collect()]
    assert got == ["https://ws/explore/data/main/s1", "https://ws/explore/data/main/s1/%", None, None]


def test_entity_urls(spark):
    df = spark.createDataFrame([("JOB", "5"), ("NOTEBOOK", "5"), ("nothing", "5")], "t string, i string")
    got = {r.t: r.u for r in df.select("t", entity_url("t", "i", "ws").alias("u")).collect()}
    assert got["nothing"] is None and got["JOB"].startswith("https://ws/") and got["JOB"].endswith("5") and got["NOTEBOOK"] != got["JOB"]
