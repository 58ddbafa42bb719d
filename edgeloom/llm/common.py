"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import stage

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list as (node, component), component = smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    round is one grouped minimum and one equi join, so no component is ever
    gathered in one place. Each round is staged to the shared checkpoint
    folder. Self loops and null ends are ignored; nodes without an edge do not
    appear. An empty edge list gives an empty result.
    """
    und = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
           .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))))
    cur = stage(und.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: link every larger neighbour of u to the smallest node around u
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: link u and its smaller neighbours to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        cur = stage(small)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    return (cur.groupBy("u").agg(F.min("v").alias("m"))
            .select(F.col("u").alias("node"), F.col("m").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """A staged frame, with a broadcast hint only where its counted rows stay within ``max_rows``.

    Beyond that the join is left to Spark, which shuffles both sides.
    """
    df = stage(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def filter_bits(keys: DataFrame, least: int, most: int = 1 << 29) -> int:
    """Bits of a :func:`key_bitmap` that tells 15 of 16 other keys apart, ``least`` to ``most``: 16 for each key, which are counted."""
    return min(most, max(least, 1 << (16 * keys.count() - 1).bit_length()))


def key_bitmap(keys: DataFrame, bits: int, col: str = "key"):
    """Broadcast bitmap of long keys: ``bits`` bits, however many keys there are. See :func:`in_bitmap`.

    Built on the executors in pieces of 4 KB; only the pieces reach the driver.
    """
    import numpy as np
    import pandas as pd

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << 15, dtype=np.uint8)
        held[pdf["slot"].to_numpy() & ((1 << 15) - 1)] = 1
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "held": [np.packbits(held, bitorder="little").tobytes()]})

    slots = keys.select(F.expr(f"shiftrightunsigned({col}, 13) % {bits}").alias("slot")).distinct()
    pieces = slots.withColumn("piece", F.shiftright("slot", 15)).groupBy("piece").applyInPandas(piece, "piece long, held binary")
    bitmap = np.zeros(bits // 64, np.uint64)
    for r in pieces.toLocalIterator():
        bitmap[r["piece"] * 512:(r["piece"] + 1) * 512] = np.frombuffer(bytes(r["held"]), dtype=np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def in_bitmap(key, bitmap):
    """Which of the uint64 keys may be in the bitmap (all that are, and few others)."""
    import numpy as np

    slot = (key >> np.uint64(13)) % np.uint64(len(bitmap) * 64)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def whole_groups(batches, key: str):
    """Batches of a partition sorted by ``key``, recut so that no group is divided between two."""
    import pandas as pd

    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        cut = int((b[key] != b[key].iloc[-1]).to_numpy().nonzero()[0][-1]) + 1 if b[key].iloc[0] != b[key].iloc[-1] else 0
        rest = b.iloc[cut:]
        if cut:
            yield b.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)
