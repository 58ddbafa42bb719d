"""Degree, total connections and the most connected node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out_degree(links: DataFrame, source: str = "source_node", target: str = "target_node") -> DataFrame:
    """``COUNT(target)`` per source."""
    return links.groupBy(F.col(source).alias("node")).agg(F.count(target).alias("total_connections"))


def in_degree(links: DataFrame, source: str = "source_node", target: str = "target_node") -> DataFrame:
    """``COUNT(source)`` per target."""
    return links.groupBy(F.col(target).alias("node")).agg(F.count(source).alias("total_connections"))


def degree_union(links: DataFrame, mode: str = "reference", **cols) -> DataFrame:
    """The two degree legs as rows ``(node, total_connections)``.

    ``reference`` unions them distinct, so a node whose in and out counts are
    equal keeps one row; ``strict`` keeps both.
    """
    u = out_degree(links, **cols).unionAll(in_degree(links, **cols))
    return u.distinct() if mode == "reference" else u


def _legs(links: DataFrame, source: str, target: str) -> DataFrame:
    """``(node, out, n)``: a row per link and end; ``n`` is 1 where the other end counts (it is not NULL)."""
    one = lambda c: F.col(c).isNotNull().cast("long")
    return links.select(F.inline(F.array(
        F.struct(F.col(source).alias("node"), F.lit(True).alias("out"), one(target).alias("n")),
        F.struct(F.col(target).alias("node"), F.lit(False).alias("out"), one(source).alias("n")))))


def total_connections(links: DataFrame, mode: str = "reference", source: str = "source_node",
                      target: str = "target_node") -> DataFrame:
    """Sum of a node's degree legs (``SUM`` over :func:`degree_union`).

    Computed with a single aggregation keyed on the node: each link gives an
    "out" row for its source and an "in" row for its target, and one pass keeps
    both counts and whether each leg exists. The distinct-union rule is then a
    column expression: an equal pair of legs counts once in ``reference`` mode.
    This is one shuffle instead of three, and partial aggregation keeps a hub
    node from gathering its links in one task.
    """
    out = F.col("out")
    return _total(_legs(links, source, target).groupBy("node").agg(
        F.count(F.when(out, 1)).alias("rows_out"), F.count(F.when(~out, 1)).alias("rows_in"),
        F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("n_out"),
        F.coalesce(F.sum(F.when(~out, F.col("n"))), F.lit(0)).alias("n_in")), mode)


def _total(per: DataFrame, mode: str) -> DataFrame:
    total = F.col("n_out") + F.col("n_in")
    if mode == "reference":
        same = (F.col("rows_out") > 0) & (F.col("rows_in") > 0) & (F.col("n_out") == F.col("n_in"))
        total = F.when(same, F.col("n_out")).otherwise(total)
    return per.select("node", total.cast("long").alias("total_connections"))


_COUNTS = ("rows_out", "rows_in", "n_out", "n_in")


def _signed(legs: DataFrame) -> DataFrame:
    """Sums of signed legs per node: link rows on each side, and those whose other end counts."""
    out, sign = F.col("out"), F.col("sign")
    return legs.groupBy("node").agg(
        F.sum(F.when(out, sign).otherwise(0)).alias("rows_out"), F.sum(F.when(out, 0).otherwise(sign)).alias("rows_in"),
        F.sum(F.when(out, sign * F.col("n")).otherwise(0)).alias("n_out"), F.sum(F.when(out, 0).otherwise(sign * F.col("n"))).alias("n_in"))


def degree_counts(links: DataFrame, source: str = "source_node", target: str = "target_node") -> DataFrame:
    """``(node, rows_out, rows_in, n_out, n_in)``: the degree table, counted from all links."""
    return _signed(_legs(links, source, target).withColumn("sign", F.lit(1).cast("long")))


def degree_delta(before: DataFrame, after: DataFrame, source: str = "source_node", target: str = "target_node") -> DataFrame:
    """What replacing rows ``before`` by rows ``after`` adds to the degree table: signed counts, nodes that end as they
    were left out. Both sides go into one aggregate, so links that stay cancel out map-side or in one shuffle."""
    legs = (_legs(after, source, target).withColumn("sign", F.lit(1).cast("long"))
            .unionByName(_legs(before, source, target).withColumn("sign", F.lit(-1).cast("long"))))
    changed = F.lit(False)
    for c in _COUNTS:
        changed = changed | (F.col(c) != 0)
    return _signed(legs).filter(changed)


def merge_degrees(degrees: DataFrame, deltas: list[DataFrame]) -> DataFrame:
    """The degree table after some deltas. Nodes without a link row left are dropped."""
    rows = degrees.select("node", *_COUNTS)
    for d in deltas:
        rows = rows.unionByName(d.select("node", *_COUNTS))
    merged = rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return merged.filter((F.col("rows_out") > 0) | (F.col("rows_in") > 0))


def connections_of(degrees: DataFrame, mode: str = "reference") -> DataFrame:
    """:func:`total_connections` from a degree table: no link is read."""
    return _total(degrees, mode)


def most_connected(links: DataFrame, mode: str = "reference", n: int = 1) -> DataFrame:
    """Node(s) with the largest total connections; ties broken by node name.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: a top-n per
    partition and one small merge, never a global sort.
    """
    return most_connected_of(total_connections(links, mode), n)


def most_connected_of(totals: DataFrame, n: int = 1) -> DataFrame:
    """The top of ``(node, total_connections)``."""
    return (totals.orderBy(F.col("total_connections").desc(), F.col("node").asc_nulls_last())
            .limit(n)
            .select(F.col("node").alias("id"), "total_connections"))
