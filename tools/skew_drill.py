"""Skew drill: BFS over a graph where one hub holds a third of all links.

Builds the graph on Spark (``spark.range``): ``n`` links in total; a third go
from the hub ``h`` to distinct leaves, the rest form a random forward graph
over the other nodes (which also link into the hub). Runs a multi-seed
``bfs_both`` with hub salting on (default thresholds) and off, and checks the
two give the same rows. Not a registered query: its input is synthetic.

usage: python tools/skew_drill.py [n_links] [cpus] [n_seeds]
"""

from __future__ import annotations

import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    n_seeds = int(sys.argv[3]) if len(sys.argv) > 3 else 64
    from pyspark.sql import functions as F

    from edgeloom.operators import traverse as TR
    from edgeloom.session import get_spark, stage

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), extra={"spark.driver.memory": "16g"})
    hub_links = n // 3
    rest = n - hub_links
    nodes = max(rest // 4, 10)
    i = F.col("id")
    hub = spark.range(hub_links).select(F.lit("h").alias("source"), F.concat(F.lit("leaf"), i.cast("string"))
                                        .alias("target"))
    # forward links among v0..v{nodes-1}; every 50th node also feeds the hub
    src = F.pmod(F.xxhash64(F.lit(1), i), F.lit(nodes - 1))
    step = F.pmod(F.xxhash64(F.lit(2), i), F.lit(nodes)) + 1
    dst = F.least(src + step, F.lit(nodes - 1))
    body = spark.range(rest).select(
        F.concat(F.lit("v"), src.cast("string")).alias("source"),
        F.when(i % 50 == 0, F.lit("h")).otherwise(F.concat(F.lit("v"), dst.cast("string"))).alias("target"))
    links = stage(hub.unionByName(body))
    seeds = stage(spark.range(n_seeds).select(F.concat(F.lit("v"), (F.col("id") * 7).cast("string")).alias("seed"))
                  .unionByName(spark.range(1).select(F.lit("h").alias("seed"))))
    report = {"links": links.count(), "hub_out_links": hub_links}

    t = time.time()
    adj = TR.adjacency(links)
    report["adjacency_s"] = round(time.time() - t, 2)
    report["hot_keys"] = 0 if adj.hot is None else adj.hot.count()
    report["hub_salts"] = None if adj.hot is None else \
        [r["_salts"] for r in adj.hot.filter((F.col("_from") == "h") & (F.col("_dir") == "down")).collect()]
    t = time.time()
    up, down = TR.bfs_both(links, seeds, adj=adj)
    n_up, n_down = up.count(), down.count()
    report["bfs_salted_s"] = round(time.time() - t, 2)
    report["rows_up"], report["rows_down"] = n_up, n_down

    TR.MIN_HOT_STEPS = 10 ** 12  # no key is hot: the hub stays in one bucket
    t = time.time()
    adj0 = TR.adjacency(links)
    report["adjacency_unsalted_s"] = round(time.time() - t, 2)
    t = time.time()
    up0, down0 = TR.bfs_both(links, seeds, adj=adj0)
    same = up0.exceptAll(up).count() == 0 and down0.exceptAll(down).count() == 0 and up0.count() == n_up \
        and down0.count() == n_down
    report["bfs_unsalted_s"] = round(time.time() - t, 2)
    report["same_result"] = same
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
