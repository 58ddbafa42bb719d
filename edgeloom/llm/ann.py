"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Codes are signs of rotated vectors: principal axes of a bounded sample, turned
by rotations that iterative quantization learns (Gong and Lazebnik 2011). A
code is cut into 16-bit substrings and each is indexed by its value. Two codes within a Hamming radius are near in some
substring (pigeonhole), so every value near the query's is probed, and what is
found is held against the radius in full. Candidates are reranked by cosine on
the original vectors, in double precision. The radius is the one that covers
TARGET of the true neighbours within the sample; in the whole table neighbours
are nearer, so it covers more.

The table is read once for each block of queries. Each batch of rows is
encoded, indexed, probed and reranked where it is read, and only its best few
rows for each query are shuffled. Queries that find too few rows within the
radius are searched again without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import table
from edgeloom.session import stage

#: Rows that codes and radius are fitted on, at most; of them so many serve as queries.
FIT_ROWS = 10_000
FIT_QUERIES = 500
TARGET = 0.97
ROTATIONS = 2
QUERY_BLOCK = 4096


class Codes:
    """Learned codes: ROTATIONS bits for each dimension, padded to whole 16-bit substrings."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        unit = sample / np.linalg.norm(sample, axis=1)[:, None]
        _, axes = np.linalg.eigh(unit.T @ unit)
        p, d, rng = unit @ axes[:, ::-1], unit.shape[1], np.random.default_rng(seed)
        turns = []
        for _ in range(ROTATIONS):
            r, _ = np.linalg.qr(rng.normal(size=(d, d)))
            for _ in range(25):
                u, _, vt = np.linalg.svd(np.sign(p @ r).T @ p)
                r = (u @ vt).T
            turns.append(axes[:, ::-1] @ r)
        self.turn = np.hstack(turns)
        self.radius = self.turn.shape[1]
        code, n = self.encode(sample), min(FIT_QUERIES, len(sample))
        if len(sample) > 20 * k:
            far = []
            for i in range(n):
                cos = unit @ unit[i]
                cos[i] = -2
                near = np.argpartition(-cos, k)[:k]
                far.append(hamming(code[i], code[near]))
            self.radius = int(np.quantile(np.concatenate(far), TARGET, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of 16-bit substrings."""
        bits = (x @ self.turn) > 0
        short = -bits.shape[1] % 16
        return np.packbits(np.pad(bits, ((0, 0), (0, short))), axis=1).view(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class MultiIndex:
    """The substrings of a batch of codes: of each, the values in use and which of them every code holds."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.unique(codes[:, s], return_inverse=True) for s in range(codes.shape[1])]
        self.words = _words(codes)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within the radius, none missed: substring s may be radius // m away, m substrings."""
        m = len(self.tables)
        if radius >= 16 * m:
            return np.arange(len(self.codes))
        hit = np.zeros(len(self.codes), dtype=bool)
        for s, (values, held) in enumerate(self.tables):
            hit |= (np.bitwise_count(values ^ code[s]) <= radius // m)[held]
        at = np.flatnonzero(hit)
        return at[hamming(self.words[at], _words(code[None, :])) <= radius]


def _words(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words."""
    short = -codes.shape[1] % 4
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, short)))).view(np.uint64)


def _clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the vectors that take part, as doubles."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _matrix(col) -> np.ndarray:
    """Rows as doubles, each scaled by a power of two to a largest component of 1 at most and 1/2 at least.

    That is exact and changes no cosine, but squares of tiny or huge components neither vanish nor overflow.
    """
    rows = np.array([np.asarray(v, dtype=np.float64) for v in col])
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None]) if rows.size else rows


def _search(rows: DataFrame, queries: list, codes: Codes, radius: int, k: int) -> DataFrame:
    qid = np.array([q[0] for q in queries], dtype=np.int64)
    qx = _matrix([q[1] for q in queries])
    held = rows.sparkSession.sparkContext.broadcast((codes, qid, qx, codes.encode(qx)))      # QUERY_BLOCK queries at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, qid, qx, qc = held.value
        qn = np.sqrt((qx * qx).sum(axis=1))
        for b in batches:
            if not len(b):
                continue
            ids, x = b["id"].to_numpy(np.int64), _matrix(b["x"])
            norm, index, out = np.sqrt((x * x).sum(axis=1)), None, []
            index = MultiIndex(codes.encode(x))
            for i in range(len(qid)):
                at = index.within(qc[i], radius)
                at = at[ids[at] != qid[i]]
                if len(at):
                    score = (x[at] * qx[i]).sum(axis=1) / (norm[at] * qn[i])
                    best = np.lexsort((ids[at], -score))[:k]
                    out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[at][best], "score": score[best]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return rows.mapInPandas(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, nearest first, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those of another length than the most frequent one (ties: the
    longer); their queries give no rows. A query's own id is no candidate.
    Repeated ids are repeated candidates and one query, with the vector that
    sorts first. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = _clean(vectors, id_col, vec_col)
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == size["d"])
    asked = _clean(queries, id_col, vec_col).where(F.size("x") == size["d"]).groupBy("id").agg(F.min("x").alias("x"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas()
    codes = Codes(_matrix(sample["x"]), k)
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")

    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))
    asked = stage(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    out = spark.createDataFrame([], schema)
    for i in range(blocks):
        block = [(r["id"], r["x"]) for r in asked.where(F.col("block") == i).select("id", "x").collect()]
        if not block:
            continue
        found = stage(best(_search(rows, block, codes, codes.radius, k)))
        full = {r["query_id"] for r in found.groupBy("query_id").count().where(F.col("count") == k).collect()}
        short = [q for q in block if q[0] not in full]
        if short:                                                # fewer than k within the radius: all rows are looked at
            again = best(_search(rows, short, codes, 1 << 20, k))
            ids = spark.createDataFrame([(q[0],) for q in short], "query_id long")
            found = found.join(F.broadcast(ids), "query_id", "left_anti").unionByName(again)
        out = out.unionByName(found)
    return out


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
