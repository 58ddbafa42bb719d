"""Vector codes: product quantisation in whole numbers, its Lloyd rounds over cover trees.

A block is some thousand rows of one partition. A task builds one cover tree per
part position over a block, once; the trees are staged and every round reads
them. A node holds a range of the block's rows in tree order, a centre and the
largest distance from it; running sums over that order give the sum of any range
at once. A round goes down the trees with the codebooks (their size is entries
times vector length, whatever the data):

* entries that the triangle inequality rules out for a whole node are left out
  for all below it;
* with one entry left the whole range goes to it, with its running sums;
* only nodes that stay ambiguous are opened, and rows of equal vectors or of the
  last, small nodes are compared exactly, in whole numbers, ties to the lower entry.

Distances in the trees are floating-point and rounded against pruning, so no
row is given to another entry than exact comparison would give it. Tasks send
one row per entry component; equal vectors, however many, are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import sized_broadcast, table
from edgeloom.session import stage

#: Part positions, entries of a codebook, Lloyd rounds, and the factor of the components.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole-number components are held within this, so squared distances stay exact in 64 bits.
MOST = 1 << 27
#: Rows of a block; rows of a node that is not divided further.
BLOCK, LEAF = 8192, 8
#: Relative slack of distances in the trees.
SLACK = 1e-9
#: Label sums up to this many rows are broadcast.
BROADCAST_ROWS = 100_000


@dataclass
class Trees:
    """Cover trees of a block, one per part. Rows of the tree order are part * n + place."""

    order: np.ndarray      # of every place in tree order, the row of the block
    points: np.ndarray     # the parts of the rows in tree order, (places, width)
    sums: np.ndarray       # running sums of them, one row more
    first: np.ndarray      # nodes: range of places, centre (a place), radius, range of children
    last: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    child_end: np.ndarray
    parts: int


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    d = a - b
    return (d * d).sum(axis=-1)


def build(rows: np.ndarray, parts: int = PARTS) -> Trees:
    """Trees over whole-number vectors (n, length). All parts grow level by level together.

    A node of radius above 2^(i-1) and at most 2^i gets children whose rows lie within
    2^(i-1) of their centres; a centre is the first row that no earlier sibling
    covers, so sibling centres lie further apart than that.
    """
    n, length = rows.shape
    points = np.ascontiguousarray(rows.reshape(n, parts, length // parts).transpose(1, 0, 2)).reshape(parts * n, -1)
    order = np.tile(np.arange(n), parts)
    at = np.arange(parts * n)                                   # of every place, the row of ``points``
    centre_of = np.repeat(np.arange(parts) * n, n)
    far = distance(points, points[centre_of])                   # of every row of ``points``, to its node's centre
    first, last = np.arange(parts) * n, (np.arange(parts) + 1) * n
    centre, levels = np.arange(parts) * n, []
    nodes = parts
    while len(first):
        radius2 = _most(far[at], first, last)
        radius = np.sqrt(radius2.astype(np.float64)) * (1 + SLACK)
        split = (radius2 > 0) & (last - first > LEAF)
        level = {"first": first, "last": last, "centre": centre, "radius": radius,
                 "child": np.zeros(len(first), np.int64), "child_end": np.zeros(len(first), np.int64)}
        levels.append(level)
        if not split.any():
            break
        grown = np.flatnonzero(split)
        cover2 = 4.0 ** (np.ceil(np.log2(radius2[grown]) / 2) - 1)
        size = (last - first)[grown]
        place = np.repeat(first[grown] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(grown)), size)
        row = at[place]
        kid = np.full(len(row), -1, np.int64)
        kid_centre, kid_owner, kids = [centre[grown]], [np.arange(len(grown))], len(grown)
        inside = far[row] <= cover2[owner]                      # the first child has the centre of its parent
        kid[inside] = owner[inside]
        left = np.flatnonzero(~inside)
        while len(left):
            who = owner[left]
            lead = np.r_[True, who[1:] != who[:-1]]
            new = left[lead]                                    # of every node its first row not covered yet
            mine = np.repeat(np.arange(len(new)), np.diff(np.r_[np.flatnonzero(lead), len(left)]))
            d = distance(points[row[left]], points[row[new]][mine])
            inside = d <= cover2[who]
            kid[left[inside]] = kids + mine[inside]
            far[row[left[inside]]] = d[inside]
            kid_centre.append(row[new])
            kid_owner.append(owner[new])
            kids += len(new)
            left = left[~inside]
        kid_centre, kid_owner = np.concatenate(kid_centre), np.concatenate(kid_owner)
        by = np.lexsort((kid, owner))                           # rows of a child side by side, children of a node too
        at[place] = row[by]
        kid = kid[by]
        begin = np.flatnonzero(np.r_[True, kid[1:] != kid[:-1]])
        which = kid[begin]
        first, last, centre = place[begin], place[np.r_[begin[1:], len(kid)] - 1] + 1, kid_centre[which]
        parent = kid_owner[which]
        edge = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        level["child"][grown], level["child_end"][grown] = nodes + edge, nodes + np.r_[edge[1:], len(parent)]
        nodes += len(first)
    every = {k: np.concatenate([lv[k] for lv in levels]) for k in levels[0]}
    place_of = np.empty(len(at), np.int64)
    place_of[at] = np.arange(len(at))
    points = points[at]
    return Trees(order[at], points, _running(points), every["first"], every["last"], place_of[every["centre"]], every["radius"],
                 every["child"], every["child_end"], parts)


def _most(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Largest value of each range; ranges ascend and do not overlap."""
    bounds = np.stack([first, last], axis=1).ravel()
    padded = np.r_[values, values[:1]]                          # reduceat wants bounds below the length
    return np.maximum.reduceat(padded, bounds)[::2]


def _running(points: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])


def assign(trees: Trees, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Whole ranges and their entries: (first, last, entry), and how many distances were taken.

    ``books``: (parts, entries, width). Ranges cover every place once.
    """
    out, compared = [], 0
    n = len(trees.order) // trees.parts
    node, may = np.arange(trees.parts), np.ones((trees.parts, books.shape[1]), bool)
    while len(node):
        part = trees.first[node] // n
        d2 = distance(trees.points[trees.centre[node]][:, None, :], books[part])
        compared += int(may.sum())
        d = np.sqrt(np.where(may, d2, np.inf))
        least = d.min(axis=1)
        may = d <= ((least + 2 * trees.radius[node]) * (1 + SLACK))[:, None]
        alone = may.sum(axis=1) == 1
        point = trees.radius[node] == 0                         # all rows equal: the exact distances decide
        done = alone | point
        if done.any():
            exact = np.where(may[done], d2[done], np.iinfo(np.int64).max)
            out.append((trees.first[node[done]], trees.last[node[done]], exact.argmin(axis=1)))
        small = ~done & (trees.child[node] == trees.child_end[node])
        if small.any():                                         # rows of small nodes, one by one
            which = np.flatnonzero(small)
            size = (trees.last - trees.first)[node[which]]
            place = np.repeat(trees.first[node[which]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            mine = np.repeat(which, size)
            for i in range(0, len(place), 4096):
                p, w = place[i:i + 4096], mine[i:i + 4096]
                exact = np.where(may[w], distance(trees.points[p][:, None, :], books[part[w]]), np.iinfo(np.int64).max)
                compared += int(may[w].sum())
                out.append((p, p + 1, exact.argmin(axis=1)))
        open_ = np.flatnonzero(~done & ~small)
        size = (trees.child_end - trees.child)[node[open_]]
        node, may = (np.repeat(trees.child[node[open_]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()),
                     np.repeat(may[open_], size, axis=0))
    return (*(np.concatenate([o[k] for o in out]) for k in range(3)), compared)


_INTS = ("order", "first", "last", "centre", "child", "child_end")
_TREE = ", ".join(f"{k} binary" for k in ("points", *_INTS, "radius"))


def _write(t: Trees) -> list[bytes]:
    return [t.points.astype(np.int32).tobytes(), *(getattr(t, k).astype(np.int32).tobytes() for k in _INTS), t.radius.tobytes()]


def _read(b: pa.RecordBatch, i: int, parts: int, width: int) -> Trees:
    def held(name: str, kind) -> np.ndarray:
        return np.frombuffer(b.column(name)[i].as_buffer(), kind)

    points = held("points", np.int32).astype(np.int64).reshape(-1, width)
    ints = {k: held(k, np.int32).astype(np.int64) for k in _INTS}
    return Trees(points=points, sums=_running(points), radius=held("radius", np.float64), parts=parts, **ints)


def _kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> DataFrame:
    """(id, label, v): vectors without null or non-finite components, v in whole numbers."""
    x = F.col(vec_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x.cast("array<double>"), lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(
        F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), c * SCALE))))).cast("int"))
    return (vectors.where(F.col(vec_col).isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size(vec_col) > 0) & (F.size(vec_col) % parts == 0))
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole.alias("v")))


@dataclass
class Fitted:
    """Codebooks (parts, entries, width) and the staged trees of the rows they were fitted on."""

    books: np.ndarray
    trees: DataFrame

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
        entries: int = ENTRIES, rounds: int = ROUNDS) -> Fitted | None:
    """Codebooks by ``rounds`` rounds of Lloyd from the rows of the ``entries`` smallest ids; None without rows.

    Components become floor(256 * x), held within +-2^27. Rows whose vector is
    null, empty, holds null or non-finite components, or has a length that
    ``parts`` does not divide are left out, and so are those of another length
    than the row of the smallest id. Of rows with one id those with the smaller
    vector come first; rows without an id are coded but start no entry (unless no
    row has one). With fewer rows than ``entries`` the codebooks are that small.
    Unused entries stay. Other columns are not read.
    """
    rows = _kept(vectors, id_col, vec_col, label_col, parts)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("d")).first()
    if seeds is None:
        return None
    length = seeds["d"]
    width = length // parts
    rows = rows.where(F.size("v") == length)
    start = [r["v"] for r in rows.where(F.col("id").isNotNull()).orderBy("id", "v").limit(entries).collect()]
    if not start:
        start = [r["v"] for r in rows.orderBy("v").limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    kind = rows.schema["label"].dataType.simpleString()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            v = t.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).chunk(0)) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in _write(build(v, parts)))],
                                              ["ids", "labels", "points", *_INTS, "radius"])

        for b in batches:
            while b.num_rows:
                take = b.slice(0, BLOCK - sum(h.num_rows for h in held))
                held.append(take)
                b = b.slice(take.num_rows)
                if sum(h.num_rows for h in held) == BLOCK:
                    yield block()
                    held.clear()
        if held:
            yield block()

    trees = stage(rows.mapInArrow(plant, f"ids array<long>, labels array<{kind}>, {_TREE}"))
    for _ in range(rounds):
        books = _round(trees, books)
    return Fitted(books, trees)


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, width = books.shape
    held = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                t = _read(b, i, parts, width)
                first, last, entry, _ = assign(t, held.value)
                slot = first // (len(t.order) // parts) * entries + entry
                np.add.at(total, slot, t.sums[last] - t.sums[first])
                np.add.at(count, slot, last - first)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                                              pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))], ["slot", "place", "total", "n"])

    sums = (trees.drop("ids", "labels").mapInArrow(run, "slot int, place int, total long, n long").groupBy("slot", "place")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect())    # a row per entry component
    new = books.reshape(-1, width).copy()
    for r in sums:
        new[r["slot"], r["place"]] = int(r["total"]) // r["n"]
    return new.reshape(books.shape)


def codes(fitted: Fitted) -> DataFrame:
    """(id, label, codes, error) of every row: entry by part, and the squared distance over all parts."""
    parts, entries, width = fitted.books.shape
    held = fitted.trees.sparkSession.sparkContext.broadcast(fitted.books)
    kind = fitted.trees.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for b in batches:
            for i in range(b.num_rows):
                t = _read(b, i, parts, width)
                n = len(t.order) // parts
                first, last, entry, _ = assign(t, books)
                by = np.argsort(first)
                of_place = np.repeat(entry[by], (last - first)[by])
                part = np.arange(len(of_place)) // n
                d2 = distance(t.points, books[part, of_place])
                code, error = np.empty((n, parts), np.int32), np.zeros(n, np.int64)
                code[t.order, part] = of_place
                np.add.at(error, t.order, d2)
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(code.ravel())), pa.array(error)], ["id", "label", "codes", "error"])

    return fitted.trees.mapInArrow(run, f"id long, label {kind}, codes array<int>, error long")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = fit(table(spark, sf_dir, "embeddings"))
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = stage(codes(fitted).select(F.col("id").alias("vec_id"), "label", "error", F.array_join(F.transform(
        "codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")))
    by = sized_broadcast(rows.groupBy(F.col("label").alias("other")).agg(F.sum("error").alias("label_error")), BROADCAST_ROWS)
    return rows.join(by, F.col("label").eqNullSafe(F.col("other"))).select(
        "vec_id", "code", "error", "label_error", F.lit(fitted.sha256()).alias("codebooks_sha256"))


def _sql_round(name: str, books: str) -> str:
    """Entries after a round of assignments to ``books`` (part, entry, c)."""
    return f"""{name}_at AS (
  SELECT s.vec_id, s.row, s.part, s.c, arg_min(b.entry, (d2(s.c, b.c), b.entry)) AS entry, min(d2(s.c, b.c)) AS error
  FROM sub s JOIN {books} b USING (part) GROUP BY ALL
), {name}_sum AS (
  SELECT part, entry, i, CAST(floor_div(sum(c[i]), count(*)) AS BIGINT) AS m
  FROM {name}_at, unnest(range(1, len(c) + 1)) u(i) GROUP BY part, entry, i
), {name} AS (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM {books} b LEFT JOIN
  (SELECT part, entry, list(m ORDER BY i) AS c FROM {name}_sum GROUP BY part, entry) n USING (part, entry)
)"""


_D2 = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_FLOOR = "CASE WHEN {s} >= 0 THEN {s} // {n} ELSE -((-({s}) + {n} - 1) // {n}) END"
#: The same rounds with every part against every entry.
SQL_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sub AS (
  SELECT vec_id, row, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS c FROM kept, range(16) t(p)
), books0 AS (SELECT part, row - 1 AS entry, c FROM sub WHERE row <= 64
), {_sql_round("books1", "books0")}, {_sql_round("books2", "books1")}, {_sql_round("books3", "books2")},
final AS (
  SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM books3_at GROUP BY row
), sha AS (
  SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM books2, unnest(range(1, len(c) + 1)) u(i)
)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM final JOIN kept k USING (row), sha
"""
for _name, _body in (("d2(s.c, b.c)", _D2.format(a="s.c", b="b.c")), ("floor_div(sum(c[i]), count(*))", _FLOOR.format(s="sum(c[i])", n="count(*)"))):
    SQL_CODES = SQL_CODES.replace(_name, _body)
