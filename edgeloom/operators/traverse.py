"""Graph traversal over link tables: multi-seed breadth-first search and the
questions built on it (closures, levels, depths, highlighted selections).

Every operator takes a ``seeds`` DataFrame (column ``seed``) so one run answers
many start nodes; results are rows ``(seed, node, depth)``. The graph is never
collected: each level is a join of the frontier with the adjacency and a grouped
OR; the driver only decides whether another job of levels is needed, from counts
observed while the job's result is staged (no extra job). Upstream and
downstream searches share one loop (keys carry the direction), so a search
costs max(up, down) levels.

Scale notes:
* up to 64 seeds share a row: its ``bits`` say which of the group's seeds have
  reached the node, so a hub is expanded once for all of them and not once per
  seed, and the visited set has one row per group and node. Searches from more than
  ``NARROW`` starts have ``WORDS`` columns of bits, a group each, so 512 seeds share a row;
* the adjacency is deduplicated and staged once as a table bucketed by its
  probe key, so every level shuffles only the frontier against it; when the
  frontier is small AQE broadcasts it and the adjacency is streamed in place;
* a hub whose links are a large share of the adjacency would be one bucket read
  by one task every level (AQE cannot split a bucketed scan), so hot probe keys
  are salted over as many buckets as their share asks for and their frontier
  rows probe each salt;
* every step carries how many steps lead on from its end, so the work of the
  next level is known before it is planned: a job advances up to
  ``HOPS_PER_JOB`` levels while that is below ``SMALL_FRONTIER`` steps and one
  level beyond, and none at all once nothing leads on. Where all levels together may
  have many more steps than that, the levels of a job follow from how the steps have grown;
* nodes that all seeds have reached are closed: a job of many steps takes none
  that lead to them, and their rows are not compared with new ones. Where all
  goes through a hub, the level behind it would else follow every step of the graph
  for every group;
* a job is one running frame: rows found at its earlier levels pass the later
  ones through a step to themselves, so each level's join stands once in the
  plan and its new rows are written once, as the job's delta. The visited set is
  the scan of all deltas; a lost executor recomputes at most one job's levels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from edgeloom.session import stage, stage_bucketed, stage_path

# Levels advanced per Spark job while the frontier has few steps ahead (see _Wave.hops).
HOPS_PER_JOB = 4
SMALL_FRONTIER = 100_000
# Steps of the whole graph, followed once by each group of seeds, up to which a job's levels are not foreseen.
SMALL_SEARCH = 10 * SMALL_FRONTIER
UP, DOWN = "up", "down"


# Hub handling: a probe key with more steps than an average bucket is "hot"
# and its steps are spread over several salted buckets.
MIN_HOT_STEPS = 10_000
# Adjacency buckets are sized by data (at least this many steps each), never
# more than the shuffle partitions: the frontier is shuffled to the bucket
# count, so a small graph is not spread over hundreds of near-empty tasks per
# level, while a mid-size one already uses every core (one task per bucket).
STEPS_PER_BUCKET = 50_000

# Seeds of a group: the bits of a long.
GROUP = 64
# Groups that share a row where there are more than NARROW starts (a seed and direction each). (Of 16, planning a level took a minute: Catalyst names
# the condition that any bit is set anew for every subset of renamed columns.)
WORDS = 8
NARROW = GROUP * WORDS
# Seeds numbered by one task (a bound on a task, groups are cut inside it).
SEEDS_PER_TASK = 64 * 1024
# Rows per seed that one task makes of rows with bits, and of how many tasks on each makes tenfold (rows only pass through a task).
ROWS_PER_TASK = 500_000
MANY_TASKS = 200
# ``_lim`` of an unbounded search.
NO_LIMIT = 2**31 - 1
# ``_salt`` of a node's step to itself.
STAY = -1


@dataclass
class Adjacency:
    """Staged steps ``(_dir, _from, _to, _deg, _salt)`` bucketed by ``(_dir, _from, _salt)``
    (``_deg``: steps that lead on from ``_to``; every node has one step to itself,
    under salt ``STAY``), the hot probe keys with how many salts each one is spread
    over, and the steps that leave each node."""

    steps: DataFrame
    hot: DataFrame | None  # (_dir, _from, _salts); None when no key is hot
    ends: DataFrame        # (_dir, node, deg)
    total: int = 0         # steps of all directions


def adjacency(links: DataFrame, directions=(DOWN, UP), src: str = "source", dst: str = "target",
              steps_per_bucket: int | None = None, min_hot_steps: int | None = None) -> Adjacency:
    """Distinct steps to follow, staged once as a bucketed table; NULL endpoints
    are never followed.

    A hub whose steps would fill one bucket (one task per BFS level) is split:
    the number of its steps is known from one aggregate, and a key with more
    than an average bucket's share gets ``ceil(steps / share)`` salts (never more
    than there are buckets); its steps are spread by a hash of the target. The
    hot-key table has at most ``steps / share`` rows, a bound that does not
    depend on the data's skew.
    """
    if isinstance(directions, str):
        directions = (directions,)
    spark = links.sparkSession
    parts = []
    for d in directions:
        a, b = (src, dst) if d == DOWN else (dst, src)
        parts.append(F.struct(F.lit(d).alias("_dir"), F.col(a).alias("_from"), F.col(b).alias("_to")))
    adj = stage(links.select(F.inline(F.array(*parts)))
                .filter(F.col("_from").isNotNull() & F.col("_to").isNotNull())
                .distinct())
    seen = Observation()
    legs = F.array(F.struct("_dir", F.col("_from").alias("node"), F.lit(1).alias("_n")),
                   F.struct("_dir", F.col("_to").alias("node"), F.lit(0).alias("_n")))
    ends = stage(adj.select(F.inline(legs)).groupBy("_dir", "node").agg(F.sum("_n").alias("deg"))
                 .observe(seen, F.sum("deg").alias("total"), F.max("deg").alias("top")))
    total, top = seen.get["total"] or 0, seen.get["top"] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(partitions, -(-total // (steps_per_bucket or STEPS_PER_BUCKET))))
    share = max(min_hot_steps or MIN_HOT_STEPS, -(-total // buckets))
    hot, salt = None, F.lit(0)
    steps = adj.join(ends.select("_dir", F.col("node").alias("_to"), F.col("deg").alias("_deg")), ["_dir", "_to"])
    if top > share:
        hot = stage(ends.filter(F.col("deg") > share)
                    .select("_dir", F.col("node").alias("_from"), F.ceil(F.col("deg") / share).cast("int").alias("_salts")))
        steps = steps.join(hot, ["_dir", "_from"], "left")
        salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_to"), F.col("_salts")))
    stay = ends.select("_dir", F.col("node").alias("_from"), F.col("node").alias("_to"), F.col("deg").alias("_deg"),
                       F.lit(STAY).alias("_salt"))
    steps = steps.select("_dir", "_from", "_to", "_deg", salt.cast("int").alias("_salt")).unionByName(stay)
    return Adjacency(stage_bucketed(steps, ["_dir", "_from", "_salt"], buckets), hot, ends, total)


def _probe(rows: DataFrame, adj: Adjacency, grow: Column, carry: bool) -> DataFrame:
    """Rows with the salts to probe: all salts of the node where it grows, and its step to itself where rows are carried."""
    cols = rows.columns
    if adj.hot is not None:
        h = adj.hot.select("_dir", F.col("_from").alias("node"), "_salts")
        rows = rows.join(h, ["_dir", "node"], "left")
        last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    else:
        last = F.lit(0)
    if carry:
        salts = F.when(grow, F.sequence(F.lit(STAY), last)).otherwise(F.array(F.lit(STAY)))
    else:
        salts = F.sequence(F.lit(0), last) if adj.hot is not None else F.array(last)
    return rows.select(*cols, F.explode(salts).alias("_salt"))


_KEY = ["_grp", "_dir", "_lim", "node"]


def _columns(name: str, words: int) -> list[str]:
    return [name] if words == 1 else [f"{name}_{k}" for k in range(words)]


def _some(cols: list[str]) -> Column:
    """Whether any bit is set."""
    return reduce(Column.bitwiseOR, [F.col(c) for c in cols]) != 0


def _count(words: int) -> Column:
    return reduce(Column.__add__, [F.bit_count(c) for c in _columns("bits", words)])


def _united(rows: DataFrame, by: list[str], words: int) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.bit_or(c).alias(c) for c in _columns("bits", words)])


def _narrow(rows: DataFrame, words: int) -> DataFrame:
    """Rows with the ``bits`` of one group each."""
    if words == 1:
        return rows
    bits = _columns("bits", words)
    each = F.array(*[F.struct((F.col("_grp") * words + k).alias("_grp"), F.col(c).alias("bits")) for k, c in enumerate(bits)])
    return rows.select(*[c for c in rows.columns if c != "_grp" and c not in bits], F.inline(each)).filter(F.col("bits") != 0)


def _held(bits: str) -> Column:
    """Numbers of the bits that are set."""
    return F.expr(f"filter(sequence(0, {GROUP - 1}), i -> getbit({bits}, i) = 1)")


def _bit(number: str) -> Column:
    return F.expr(f"shiftleft(1L, {number})")


class _Wave:
    """One running search: the staged deltas of all levels so far and the last level.

    ``start``: distinct ``(seed, _dir, _lim)``; seeds are numbered and put into
    groups of up to ``GROUP`` with the same direction and bound. Rows hold the bits of
    ``words`` groups that follow each other, under the number of the first divided by ``words``.
    """

    def __init__(self, adj: Adjacency, start: DataFrame, words: int | None = None):
        self.adj, self.spark = adj, start.sparkSession
        seen = Observation()
        start = stage(start.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("_lim").alias("lim")))
        rows, self.deepest = seen.get["rows"], seen.get["lim"] or 0
        self.words = words or (WORDS if rows > NARROW else 1)
        self.bits = _columns("bits", self.words)
        tasks = -(-rows // SEEDS_PER_TASK)
        order = ["_most", "seed"]
        each = start.groupBy("seed").agg(F.max("_lim").alias("_most"))
        dealt = each.repartitionByRange(tasks, *order) if tasks > 1 else each.coalesce(1)
        at = F.monotonically_increasing_id()
        numbered = dealt.sortWithinPartitions(*order).select("seed", at.alias("_at"))
        # (_grp, _dir, _lim, _bit, seed): who a bit of a group stands for, the same in all directions
        self.seeds = stage(start.join(numbered, "seed").select(
            F.shiftright("_at", 6).alias("_grp"), "_dir", "_lim", (F.col("_at") % GROUP).cast("int").alias("_bit"), "seed"))
        none = F.lit(0).cast("long")
        own = [F.when(F.col("_grp") % self.words == k, _bit("_bit")).otherwise(none).alias(c) for k, c in enumerate(self.bits)]
        first = (self.seeds.withColumn("node", F.col("seed")).join(adj.ends, ["_dir", "node"], "left")
                 .select(F.floor(F.col("_grp") / self.words).alias("_grp"), *_KEY[1:], *own, F.coalesce("deg", F.lit(0)).cast("long").alias("deg"),
                         F.lit(0).alias("depth")))
        self.depth, self.paths, self.rows, self.held, self.closed, self.few = 0, [], 0, 0, None, None
        self.most, self.growth = -(-rows // GROUP) * adj.total, None
        self._keep(first, 0)

    def _keep(self, new: DataFrame, last: int) -> None:
        seen = Observation()
        ahead = F.sum(F.when((F.col("depth") == last) & (F.col("_lim") > last), F.col("deg")))
        new = new.select(*_KEY, *self.bits, "deg", "depth")
        self.schema = new.schema
        frame, path = stage_path(new.observe(seen, F.count(F.lit(1)).alias("rows"), ahead.alias("steps"), F.sum(_count(self.words)).alias("held")))
        self.depth, self.steps, self.rows = last, seen.get["steps"] or 0, self.rows + seen.get["rows"]
        self.held += seen.get["held"] or 0
        if seen.get["rows"] or not self.paths:
            self.paths.append(path)
        self.last = frame.filter(F.col("depth") == last)

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def plan(self, hops: int, active: DataFrame | None = None) -> DataFrame:
        """New rows of the next ``hops`` levels, each level's join once.

        ``_b1`` .. ``_bh`` (each of ``words`` columns) are the seeds that reach the row's node first at each of
        the job's levels. A level joins the rows of the level before with their
        steps, and earlier rows with their step to themselves, then one grouped OR
        puts them together and the visited set is taken off. (In the first job that is the
        start, which is carried along as ``_b0``.) ``active``: ``(_grp,
        _mask)``, the seeds of a group that still search (all, if None).
        """
        base = 0 if self.depth == 0 and active is None else 1
        level = lambda h: _columns(f"_b{h}", self.words)
        none = F.lit(0).cast("long")
        seen = self.deltas()
        rows = self.last.select(*_KEY, *[F.col(c).alias(b) for c, b in zip(self.bits, level(0))])
        if active is not None:
            rows = rows.join(active, "_grp").withColumn("_b0", F.col("_b0").bitwiseAND(F.col("_mask"))).drop("_mask")
        steps = self.adj.steps if self.few is None else self.few
        steps = steps.select(F.col("_dir").alias("_way"), "_from", F.col("_salt").alias("_part"), "_to", "_deg")
        if self.closed is not None:
            if self.few is None:
                steps = steps.join(self.closed, (F.col("_way") == F.col("_of")) & (F.col("_to") == F.col("_full")) & (F.col("_part") != STAY), "left_anti")
            seen = seen.join(self.closed, (F.col("_dir") == F.col("_of")) & (F.col("node") == F.col("_full")), "left_anti")
        seen = seen.groupBy(*_KEY).agg(*[F.bit_or(c).alias(k) for c, k in zip(self.bits, _columns("_seen", self.words))])
        for h in range(1, hops + 1):
            edge, new = level(h - 1), level(h)
            held = [c for i in range(base, h) for c in level(i)]
            grow = _some(edge) & (F.col("_lim") > self.depth + h - 1)
            if h == 1 and base:
                rows = rows.filter(grow)
            probe = _probe(rows, self.adj, grow, carry=h > 1 or not base)
            moved = F.col("_part") != STAY
            kept = [F.when(moved, none).otherwise(F.col(c)).alias(c) for c in held]
            rows = (probe.join(steps, (F.col("_dir") == F.col("_way")) & (F.col("node") == F.col("_from")) & (F.col("_salt") == F.col("_part")))
                    .select("_grp", "_dir", "_lim", F.col("_to").alias("node"), F.col("_deg").alias("deg"), *kept,
                            *[F.when(moved, F.col(c)).otherwise(none).alias(n) for c, n in zip(edge, new)])
                    .groupBy(*_KEY).agg(F.max("deg").alias("deg"), *[F.bit_or(c).alias(c) for c in [*held, *new]]))
            known = [none] * self.words
            if base:
                rows = rows.join(seen, _KEY, "left")
                known = [F.coalesce(c, none) for c in _columns("_seen", self.words)]
            for i in range(base, h):
                known = [k.bitwiseOR(F.col(c)) for k, c in zip(known, level(i))]
            rows = rows.select(*_KEY, "deg", *held, *[F.col(n).bitwiseAND(F.bitwise_not(k)).alias(n) for n, k in zip(new, known)])
            rows = rows.filter(_some([*held, *new]))
        levels = F.array(*[F.struct(*[F.col(b).alias(c) for b, c in zip(level(i), self.bits)], F.lit(self.depth + i).alias("depth")) for i in range(1, hops + 1)])
        return rows.select(*_KEY, "deg", F.inline(levels)).filter(_some(self.bits))

    def hops(self, most: int) -> int:
        """Levels of the next job. In a large search these are as many as stay below SMALL_FRONTIER steps if the steps
        grow on as in the last job: one level of a hub may lead to the whole graph, for every group."""
        if self.steps > SMALL_FRONTIER or self.words > 1:
            return 1
        if self.most <= SMALL_SEARCH:
            return most
        if self.growth is None:
            return 1
        hops, ahead = 1, self.steps * self.growth
        while hops < most and ahead <= SMALL_FRONTIER:
            hops, ahead = hops + 1, ahead * self.growth
        return hops

    def _closed(self) -> DataFrame | None:
        """(_of, _full): direction and node where all seeds of the direction have been, staged; None if there is no such node.
        (A bit of a node stands in one delta only.)"""
        held = self.deltas().groupBy("_dir", "node").agg(F.sum(_count(self.words)).alias("_held"))
        all_ = self.seeds.groupBy("_dir").agg(F.count(F.lit(1)).alias("_held"))
        seen = Observation()
        closed = stage(held.join(all_, ["_dir", "_held"]).select(F.col("_dir").alias("_of"), F.col("node").alias("_full"))
                       .observe(seen, F.count(F.lit(1)).alias("rows")))
        return closed if seen.get["rows"] else None

    def _few(self) -> DataFrame | None:
        """The frontier's steps to nodes that are not closed, staged, where these are few: they go to the frontier, which then stays in place."""
        ahead = self.last.select("_dir", F.col("node").alias("_from")).distinct()
        left = (self.adj.steps.filter(F.col("_salt") != STAY).join(ahead, ["_dir", "_from"], "left_semi")
                .join(self.closed, (F.col("_dir") == F.col("_of")) & (F.col("_to") == F.col("_full")), "left_anti"))
        return stage(left) if left.count() <= self.adj.total // 20 else None

    def advance(self, hops: int, active: DataFrame | None = None) -> None:
        if self.steps > SMALL_FRONTIER:
            self.closed = self._closed()
            self.few = self._few() if self.closed is not None and active is None and hops == 1 and self.depth else None
        else:
            self.few = None
        before = self.steps
        self._keep(self.plan(hops, active), self.depth + hops)
        self.growth = max(1.0, (self.steps / max(1, before)) ** (1 / hops))


@dataclass
class Reach:
    """What a search reached: ``wide`` (rows of ``words`` groups of seeds, node and depth,
    with the bits of the seeds) and ``seeds`` (who the bits stand for)."""

    wide: DataFrame
    seeds: DataFrame
    held: int = 0          # bits set in all deltas: rows per seed that they stand for
    words: int = 1

    @property
    def deltas(self) -> DataFrame:
        """A row per group of seeds, node and depth."""
        return _narrow(self.wide, self.words)

    def _named(self, rows: DataFrame, seeds: DataFrame, by: list[str], spread: bool = True) -> DataFrame:
        """Rows with ``bits`` as one row per seed. Where these are many, the rows are dealt evenly first, while they are few."""
        tasks = -(-self.held // ROWS_PER_TASK)
        if tasks > MANY_TASKS:
            tasks = max(MANY_TASKS, -(-tasks // 10))
        if spread and tasks > 1:
            rows = rows.repartition(tasks)
        rows = _narrow(rows, self.words)
        if spread and tasks > 1:
            # a list of a group's seeds is met once a row; its own join would be looked up, and written, for each of them
            who = seeds.groupBy(*by).agg(F.collect_list(F.struct("_bit", "seed")).alias("_who"))
            rows = (rows.join(F.broadcast(who) if seeds.count() <= SEEDS_PER_TASK else who, by).withColumn("_who", F.explode("_who"))
                    .withColumn("_bit", F.col("_who._bit")).withColumn("seed", F.col("_who.seed")).drop("_who"))
        else:
            rows = rows.join(seeds, by)
        return rows.filter(F.expr("getbit(bits, _bit) = 1")).drop("bits", "_bit", "_grp", "_lim")

    def rows(self, direction: str) -> DataFrame:
        """``(seed, node, depth)`` of one direction."""
        of = F.col("_dir") == direction
        return self._named(self.wide.filter(of).drop("_dir"), self.seeds.filter(of).drop("_dir"), ["_grp", "_lim"]).select("seed", "node", "depth")

    def nodes(self) -> DataFrame:
        """``(seed, node)`` of all directions, distinct: put together while the rows still hold bits."""
        per = _united(self.wide, ["_grp", "node"], self.words)
        return self._named(per, self.seeds.select("_grp", "_bit", "seed").distinct(), ["_grp"]).select("seed", "node")

    def levels(self) -> DataFrame:
        """``(seed, _dir, depth)``: the deepest level of every seed. The rows are put together while they still hold
        bits, so only one row per group and level is given names."""
        per = _united(self.wide, ["_grp", "_dir", "_lim", "depth"], self.words)
        return self._named(per, self.seeds, ["_grp", "_dir", "_lim"], spread=False).groupBy("seed", "_dir").agg(F.max("depth").alias("depth"))


def search(adj: Adjacency, start: DataFrame, hops: int | None = None) -> Reach:
    """Breadth-first search from ``start`` (:func:`_start`), ``hops`` levels per job at most.

    Exact: a job's levels each take off what was reached before them, so a key's
    bits appear once, at the seed's smallest depth.
    """
    wave = _Wave(adj, start)
    most = max(1, int(hops or HOPS_PER_JOB))
    while wave.steps and wave.depth < wave.deepest:
        wave.advance(min(wave.hops(most), wave.deepest - wave.depth))
    return Reach(wave.deltas(), wave.seeds, wave.held, wave.words)


def _start(seeds: DataFrame, direction: str, limit_col: str | None, max_depth: int | None = None) -> DataFrame:
    lim = F.col(limit_col).cast("int") if limit_col and limit_col in seeds.columns else F.lit(None).cast("int")
    lim = F.coalesce(lim if max_depth is None else F.least(lim, F.lit(int(max_depth))), F.lit(NO_LIMIT))
    # a seed asked for more than once is searched to its largest bound
    return (seeds.filter(F.col("seed").isNotNull())
            .groupBy("seed").agg(F.max(lim).alias("_lim"))
            .select("seed", F.lit(direction).alias("_dir"), "_lim"))


def bfs(links: DataFrame, seeds: DataFrame, direction: str, max_depth: int | None = None, src: str = "source",
        dst: str = "target", adj: Adjacency | None = None, hops: int | None = None) -> DataFrame:
    """Nodes reachable from each seed with their hop count (start included, depth 0).

    ``direction`` ``down`` follows links source -> target, ``up`` goes against
    them. ``max_depth``: ``None`` = unbounded; an int stops expanding at that
    depth (0 or less = the start only). If ``seeds`` has a ``max_depth``
    column, each seed gets its own bound (NULL = unbounded), carried along the
    frontier so no bound is gathered to the driver. ``hops``: BFS levels per
    Spark job (default ``HOPS_PER_JOB``).
    """
    adj = adj if adj is not None else adjacency(links, direction, src, dst)
    return search(adj, _start(seeds, direction, "max_depth", max_depth), hops).rows(direction)


def reach_both(links: DataFrame, seeds: DataFrame, up_limit: str | None = None, down_limit: str | None = None,
               src: str = "source", dst: str = "target", adj: Adjacency | None = None, hops: int | None = None) -> Reach:
    """Upstream and downstream searches advanced together (the same jobs serve both directions).

    ``up_limit`` / ``down_limit`` name per-seed bound columns of ``seeds``.
    """
    adj = adj if adj is not None else adjacency(links, (DOWN, UP), src, dst)
    return search(adj, _start(seeds, UP, up_limit).unionByName(_start(seeds, DOWN, down_limit)), hops)


def bfs_both(links: DataFrame, seeds: DataFrame, up_limit: str | None = None, down_limit: str | None = None,
             src: str = "source", dst: str = "target", adj: Adjacency | None = None, hops: int | None = None):
    """:func:`reach_both` as ``(up, down)`` frames of ``(seed, node, depth)``."""
    reach = reach_both(links, seeds, up_limit, down_limit, src, dst, adj, hops)
    return reach.rows(UP), reach.rows(DOWN)


def seeds_of(df: DataFrame, col: str = "id") -> DataFrame:
    return df.select(F.col(col).alias("seed"))


def closure(up: DataFrame | None = None, down: DataFrame | None = None, reach: Reach | None = None) -> DataFrame:
    """Union (distinct) of the upstream and downstream node sets per seed (``reach``: the search of both, whose bits
    are united before they become rows)."""
    if reach is not None:
        return reach.nodes()
    return up.select("seed", "node").unionByName(down.select("seed", "node")).distinct()


def closure_semi(nodes_api: DataFrame, nodes: DataFrame) -> DataFrame:
    """Served node rows whose id is in the closure, per seed."""
    return nodes_api.join(nodes.select("seed", F.col("node").alias("id")), "id", "inner")


_LINK_REST = ("entity_path", "source_type", "target_type", "last_event_date", "lineage_source_table")


def traversed_links(links_api: DataFrame, up: DataFrame, down: DataFrame) -> DataFrame:
    """Links walked by the two searches: target in the upstream closure, or
    source in the downstream closure; one row per (seed, source, target).

    Among several rows of one pair the maximum under a fixed total order is
    kept (the reference keeps whichever came last in an unordered result).
    """
    lu = links_api.join(up.select("seed", F.col("node").alias("target")), "target")
    ld = links_api.join(down.select("seed", F.col("node").alias("source")), "source")
    both = lu.unionByName(ld)
    rest = [c for c in _LINK_REST if c in links_api.columns]
    return (both.groupBy("seed", "source", "target")
            .agg(F.max(F.struct(*rest)).alias("_r"))
            .select("seed", "source", "target", *[F.col(f"_r.{c}").alias(c) for c in rest]))


def max_levels(links: DataFrame, seeds: DataFrame, adj: Adjacency | None = None, reach: Reach | None = None) -> DataFrame:
    """Deepest BFS level reachable upstream and downstream of each seed (``reach``: an unbounded search of both)."""
    reach = reach or reach_both(links, seeds, adj=adj)
    of = lambda d: F.max(F.when(F.col("_dir") == d, F.col("depth"))).cast("long")
    return reach.levels().groupBy("seed").agg(of(UP).alias("max_upstream"), of(DOWN).alias("max_downstream"))


def node_depth(links: DataFrame, pairs: DataFrame, direction: str, adj: Adjacency | None = None,
               visited: dict | None = None) -> DataFrame:
    """Shortest hops from ``seed`` to ``node`` in one direction; 0 if unreachable.

    Two-sided: one search starts at the seeds, one at the nodes against the
    direction, and the one with fewer steps ahead advances by a level. After a
    levels of one and b of the other, exactly the pairs a + b apart meet: some
    node lies in the last level of both. Settled pairs leave the search, and
    seeds or nodes without open pairs leave their frontier. Once one side has no
    steps ahead, the open pairs are unreachable. ``visited`` takes the number of
    rows that the two searches have kept.
    """
    adj = adj if adj is not None else adjacency(links)
    back = UP if direction == DOWN else DOWN
    asked = stage(pairs.select("seed", "node").filter(F.col("seed") != F.col("node")).distinct())
    ahead = _Wave(adj, _start(asked, direction, None), words=1)
    behind = _Wave(adj, _start(asked.select(F.col("node").alias("seed")), back, None), words=1)
    open_ = (asked.join(ahead.seeds.select("seed", F.col("_grp").alias("_ga"), F.col("_bit").alias("_a")), "seed")
             .join(behind.seeds.select(F.col("seed").alias("node"), F.col("_grp").alias("_gb"), F.col("_bit").alias("_b")), "node"))
    found, left = None, True
    while left and ahead.steps and behind.steps:
        seen = Observation()
        open_ = stage(open_.observe(seen, F.count(F.lit(1)).alias("rows")))
        left = seen.get["rows"]
        if not left:
            break
        side, grp, bit = (ahead, "_ga", "_a") if ahead.steps <= behind.steps else (behind, "_gb", "_b")
        side.advance(1, open_.groupBy(F.col(grp).alias("_grp")).agg(F.bit_or(_bit(bit)).alias("_mask")))
        wanted = open_.groupBy("_ga", "_a", "_gb").agg(F.bit_or(_bit("_b")).alias("_want"))
        met = (ahead.last.select(F.col("_grp").alias("_ga"), "node", F.col("bits").alias("_abits"))
               .join(open_.select("_ga", "_gb").distinct(), "_ga")
               .join(behind.last.select(F.col("_grp").alias("_gb"), "node", F.col("bits").alias("_bbits")), ["_gb", "node"])
               .select("_ga", "_gb", "_bbits", F.explode(_held("_abits")).alias("_a"))
               .groupBy("_ga", "_a", "_gb").agg(F.bit_or("_bbits").alias("_bbits")))
        hits = stage(open_.join(met.join(wanted, ["_ga", "_a", "_gb"])
                                .select("_ga", "_a", "_gb", F.col("_bbits").bitwiseAND(F.col("_want")).alias("_hit")), ["_ga", "_a", "_gb"])
                     .filter(F.expr("getbit(_hit, _b) = 1"))
                     .select("seed", "node", F.lit(ahead.depth + behind.depth).alias("depth")))
        open_ = open_.join(hits, ["seed", "node"], "left_anti")
        found = hits if found is None else found.unionByName(hits)
    if visited is not None:
        visited["rows"] = ahead.rows + behind.rows
    if found is None:
        return pairs.select("seed", "node", F.lit(0).cast("long").alias("depth"))
    return (pairs.join(found, ["seed", "node"], "left")
            .select("seed", "node", F.coalesce(F.col("depth"), F.lit(0)).cast("long").alias("depth")))


def _clamp(req: Column, mx: Column, what: str):
    level = (F.when(req.isNull(), F.lit(None)).when(req > mx, mx).when(req < 0, F.lit(0)).otherwise(req))
    msg = (F.when(req.isNull(), F.lit(None))
           .when(req > mx, F.concat(F.lit("Maximum level is "), mx.cast("string")))
           .when(req < 0, F.lit("Minimum level is 0")))
    return level.cast("long").alias(f"{what}_level"), msg.alias(f"{what}_message")


def clamp_levels(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Requested levels clamped into ``[0, max]`` with the message shown.

    ``requests``: ``(seed, requested_up, requested_down)`` (NULL = not a number,
    which leaves that direction unbounded); ``levels``: :func:`max_levels`.
    """
    j = requests.join(levels, "seed")
    up_l, up_m = _clamp(F.col("requested_up"), F.col("max_upstream"), "up")
    dn_l, dn_m = _clamp(F.col("requested_down"), F.col("max_downstream"), "down")
    return j.select("seed", "requested_up", "requested_down", up_l, up_m, dn_l, dn_m)


def default_levels(levels: DataFrame, default: int = 3) -> DataFrame:
    """Levels shown when a node is selected: ``min(default, max)`` each way."""
    return levels.select("seed", F.least(F.lit(default).cast("long"), F.col("max_upstream")).alias("up_level"),
                         F.least(F.lit(default).cast("long"), F.col("max_downstream")).alias("down_level"))


def connected_nodes(links: DataFrame, selection: DataFrame, adj: Adjacency | None = None) -> DataFrame:
    """Bounded upstream set plus bounded downstream set per selected seed.

    ``selection``: ``(seed, up_level, down_level)``; a NULL level is unbounded.
    """
    up, down = bfs_both(links, selection, up_limit="up_level", down_limit="down_level", adj=adj)
    return closure(up, down)


def induced_links(links_api: DataFrame, node_set: DataFrame) -> DataFrame:
    """Links with both ends in the seed's node set: ``(seed, link...)``."""
    s = links_api.join(node_set.select("seed", F.col("node").alias("source")), "source")
    return s.join(node_set.select("seed", F.col("node").alias("target")), ["seed", "target"], "left_semi")


highlighted_links = induced_links


def highlight_levels(links_api: DataFrame, connected: DataFrame, seeds: DataFrame,
                     adj: Adjacency | None = None, reach: Reach | None = None) -> DataFrame:
    """Over a seed's highlighted links: the deepest upstream hop count of a
    link source and the deepest downstream hop count of a link target
    (unbounded shortest hops from the seed, 0 when unreachable).

    ``reach``: the unbounded search that :func:`max_levels` of the same selection
    has made; without it the search is made here.
    """
    reach = reach or reach_both(links_api, seeds, adj=adj)
    hl = induced_links(links_api, connected).select("seed", "source", "target")
    up = reach.rows(UP).select("seed", F.col("node").alias("source"), F.col("depth").alias("du"))
    dn = reach.rows(DOWN).select("seed", F.col("node").alias("target"), F.col("depth").alias("dd"))
    per = (hl.join(up, ["seed", "source"], "left").join(dn, ["seed", "target"], "left")
           .groupBy("seed")
           .agg(F.max(F.coalesce("du", F.lit(0))).alias("cu"), F.max(F.coalesce("dd", F.lit(0))).alias("cd")))
    return (seeds.select("seed").distinct().join(per, "seed", "left")
            .select("seed", F.coalesce("cu", F.lit(0)).cast("long").alias("current_upstream"),
                    F.coalesce("cd", F.lit(0)).cast("long").alias("current_downstream")))


def selection_indicators(nodes_api: DataFrame, links_api: DataFrame, connected: DataFrame) -> DataFrame:
    """Per seed: selected node count (distinct ids), highlighted link rows and
    ``round(100 * selected / node rows, 2)``; node rows count the full graph."""
    total = nodes_api.agg(F.count(F.lit(1)).alias("_total"))                # one row
    sel = connected.groupBy("seed").agg(F.countDistinct("node").alias("n_selected"))
    hl = induced_links(links_api, connected).groupBy("seed").agg(F.count(F.lit(1)).alias("n_links"))
    pct = F.when(F.col("_total") > 0, F.round(F.col("n_selected") * F.lit(100.0) / F.col("_total").cast("double"), 2))
    return (sel.join(hl, "seed", "left").join(F.broadcast(total), F.lit(True), "left")
            .select("seed", F.col("n_selected").cast("long").alias("n_selected"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    pct.cast("double").alias("pct_highlighted")))
