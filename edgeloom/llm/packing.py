"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most ``capacity`` tokens and packed into
bins of that capacity. No bin holds two pieces of one source or of one
duplicate cluster: every bin carries a bitmap of each. Pieces go, largest
first, to the tightest bin that takes them: bins stand in order of what they
have left, and the search starts at the least that would do and goes to the
next until a bin without a conflict is found.

Only ids, sizes and two keys are shuffled. Shards are bounded, and their number
grows with the table, so no task ever holds more than a few thousand pieces;
what one source or cluster holds is spread over all shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import table

CAPACITY = 2048
SHARD_PIECES = 2000

#: A token: a run of letters, marks and digits, or one other visible character.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def cluster_key(text: Column) -> Column:
    """Texts that differ in case or white space only are one cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of every piece, pieces given in the order in which they are placed."""
    free: list[tuple[int, int]] = []             # (left, bin), in order
    held: list[tuple[int, int]] = []             # bitmaps of a bin: sources, clusters
    bit_s: dict = {}
    bit_c: dict = {}
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 1 << bit_s.setdefault(source, len(bit_s))
        c = 1 << bit_c.setdefault(cluster, len(bit_c))
        at = bisect_left(free, (size, -1))
        while at < len(free):
            hs, hc = held[free[at][1]]
            if not hs & s and not hc & c:
                break
            at += 1
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(held)
            held.append((0, 0))
        held[b] = (held[b][0] | s, held[b][1] | c)
        if left > size:
            insort(free, (left - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, tokens: Column | None = None,
         cluster: Column | None = None) -> DataFrame:
    """(id, piece, n_tokens, shard, bin): where every piece of every document goes.

    ``tokens`` counts a row's tokens (TOKEN by default), ``cluster`` names its
    duplicate cluster (equal texts up to case and white space by default). A
    document of more than ``capacity`` tokens gives full pieces, which fill a bin
    each, and a rest; pieces of one document share its cluster. A document without
    tokens (null, empty, white space) has one row with piece 0, no tokens and
    null shard and bin. Null sources are one source. Repeated ids are packed
    row by row; ties go by size, id, source, then cluster. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        (tokens if tokens is not None else token_count(body)).cast("long").alias("n"),
        (cluster if cluster is not None else cluster_key(body)).alias("cluster"))
    pieces = (rows.where("n > 0")
              .withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))))
              .withColumn("n_tokens", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int")))
    total = docs.count()
    shards = max(1, -(-total // shard_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc", "piece", "source", "cluster"], ascending=[False, True, True, True, True])
        bins = best_fit(pdf["n_tokens"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity)
        return pd.DataFrame({id_col: pdf["doc"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"],
                             "shard": pdf["shard"], "bin": bins})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, n_tokens int, shard int, bin int"
    # the piece is part of the key: pieces of one long document spread over the shards
    packed = (pieces.select("doc", "source", "cluster", "piece", "n_tokens").withColumn(
        "shard", F.pmod(F.xxhash64("doc", "source", "cluster", "piece"), F.lit(shards)).cast("int"))
        .groupBy("shard").applyInPandas(place, schema))
    none = rows.where("n = 0").select(F.col("doc").alias(id_col), F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"),
                                      F.lit(None).cast("int").alias("shard"), F.lit(None).cast("int").alias("bin"))
    return packed.unionByName(none)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
