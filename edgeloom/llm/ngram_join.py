"""N-gram Jaccard join with signature trees; documents are grouped by their links.

Two documents link when the Jaccard similarity of their shingle sets reaches
NUM / DEN. Documents come together in buckets: a set's shingles are dealt into
parts by hash, and a key is the hash of all shingles of one part. Two linked
sets differ in fewer shingles than there are parts, so some part is the same
in both. A passage that many documents share stands among other shingles in
its parts and so makes no large bucket.

Components are wanted, not pairs, so work is spared where it changes nothing:

1. equal sets are one node;
2. star step: every member of a bucket is verified against its first member,
   its leader, and verified links are joined to components;
3. the members of all buckets of one leader are a group. Groups that still hold
   more than one component get a signature tree. A tree's nodes hold the OR and
   the AND of their members' token bitmaps, their size range and whether they
   lie in one component. A dual traversal goes down pairs of nodes whose
   largest possible overlap would do: no member shares what all members of its
   node have and no member of the other node has. Trees have bitmaps of one
   width, which large sets fill; the pairs that are left are held against
   bitmaps as wide as their sets ask for. So only members that may link with one
   of another component are left. Their whole sets, one a member and
   group, are verified in place, and only links that join components leave a
   group: fewer than its members. Large groups are cut into blocks; every pair
   of blocks is a traversal of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import shingles as sh
from edgeloom.llm.common import components, filter_bits, in_bitmap, key_bitmap, sized_broadcast, table, whole_groups
from edgeloom.session import stage

BITS = 1024                      # of a token bitmap in a tree, and of a small document's
MOST_BITS = 1 << 16              # of a large document's
FANOUT = 8
LEAF = 16                        # members up to which a bucket is a single leaf
BLOCK = 2000                     # members of one traversal's side
FILTER_BITS = 1 << 26            # of the bitmap that tells shared keys, at least
PARTS_OVER = 1.35                # parts for every shingle that may differ: few parts are empty
BROADCAST_ROWS = 2_000_000


def differing(a: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most shingles that a set of size ``a`` and a linked, not smaller one can differ in: b <= a den / num, and
    |A xor B| = a + b - 2 o with o >= num (a + b) / (num + den)."""
    b = a * den // num
    return (a + b) * (den - num) // (den + num)


def parts_of(cls: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes from 2^c to 2^(c+1) - 1 are class c: how many parts it has, and how many may differ."""
    d = differing((np.int64(2) << cls.astype(np.int64)) - 1, num, den)
    return np.ceil(PARTS_OVER * (d + 1)).astype(np.int64), d


def part_keys(s: np.ndarray, text: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of all parts of distinct shingles ``s``, which are ordered by text.

    A set takes part in its own size class and, as the larger of a pair, in the
    class below when partners there are in reach. An empty part gives a key
    only for sets with so few shingles that all their other parts may differ.
    """
    keys, owners = [], []
    n = np.bincount(text) if len(text) else np.zeros(0, np.int64)
    m = n[text]
    own = np.floor(np.log2(np.maximum(m, 1))).astype(np.int64)
    least = -(-m * num // den)
    for down in (0, 1):
        cls = own - down
        use = (cls >= 0) & ((np.int64(2) << np.maximum(cls, 0)) - 1 >= least) if down else np.ones(len(s), dtype=bool)
        if not use.any():
            continue
        x, t, c = s[use], text[use], cls[use]
        p, d = parts_of(c, num, den)
        part = (sh.mix(x ^ np.uint64(0xA5A5A5A5)) % p.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((part, t))
        x, t, c, part, p, d = x[order], t[order], c[order], part[order], p[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (part[1:] != part[:-1])]))
        total = np.add.reduceat(sh.mix(x), first)
        tag = (c[first] * 1_000_003 + part[first]).astype(np.uint64)
        held = np.bincount(t[first], minlength=len(n))
        # of two linked sets' equal parts, the first has d others before it at most, in either set
        early = np.arange(len(first)) - (np.cumsum(held) - held)[t[first]] <= d[first]
        keys.append(sh.mix(total ^ sh.mix(tag))[early])
        owners.append(t[first][early])
        tf = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        for k in tf[held[t[tf]] <= d[tf]].tolist():
            there = set(part[(t == t[k])].tolist())
            empty = np.array([i for i in range(int(p[k])) if i not in there], dtype=np.int64)
            keys.append(sh.mix(sh.mix((c[k] * 1_000_003 + empty).astype(np.uint64)) + np.uint64(7)))
            owners.append(np.full(len(empty), t[k]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    buf, begin = sh.joined(texts)
    h, text, _, _ = sh.word_hashes(buf, begin)
    s, t, _ = sh.shingle_hashes(h, text, k)
    return sh.distinct(s, t)


def _per_chunk(fn, cols: list[str]):
    """Maps (ids, texts) of a slice of a batch to columns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["doc"].to_numpy(), b["body"].tolist()
            for lo, hi in sh.chunks(texts):
                yield pd.DataFrame(dict(zip(cols, fn(ids[lo:hi], texts[lo:hi]))))
    return run


def _facts(k: int):
    def fn(ids, texts):
        s, t = _sets(texts, k)
        n = np.bincount(t, minlength=len(ids))
        a, b = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        np.add.at(a, t, sh.mix(s))
        np.add.at(b, t, sh.mix(s ^ np.uint64(0x5555)))
        return ids, n, a.view(np.int64), b.view(np.int64), sized_bits(s, t, len(ids))
    return _per_chunk(fn, ["doc", "n", "s1", "s2", "bitmap"])


def _emit(k: int, num: int, den: int, seen=None):
    """(key, doc) of every part; with a bitmap of shared keys, (key, doc, n) of the parts in it."""
    def fn(ids, texts):
        s, t = _sets(texts, k)
        key, own = part_keys(s, t, num, den)
        if seen is None:
            return key.view(np.int64), ids[own]
        hit = in_bitmap(key, seen.value)
        return key.view(np.int64)[hit], ids[own[hit]], np.bincount(t, minlength=len(ids))[own[hit]].astype(np.int32)
    return _per_chunk(fn, ["key", "doc"] if seen is None else ["key", "doc", "n"])


class SignatureTree:
    """Levels of nodes over documents, those of one component side by side and components by their least size: size
    ranges, the component of pure nodes (else -1), OR and AND bitmaps."""

    def __init__(self, n: np.ndarray, label: np.ndarray, bits: np.ndarray):
        least = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, n)
        self.order = np.lexsort((n, label, least[label]))
        lo = hi = n[self.order]
        lab, any_ = label[self.order], bits[self.order]
        all_ = any_
        self.levels = [(lo, hi, lab, any_, all_)]
        while len(lo) > 1:
            at = np.arange(0, len(lo), FANOUT)
            same_lo, same_hi = np.minimum.reduceat(lab, at), np.maximum.reduceat(lab, at)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            any_, all_ = np.bitwise_or.reduceat(any_, at, axis=0), np.bitwise_and.reduceat(all_, at, axis=0)
            lab = np.where((same_lo == same_hi), same_lo, -1)
            self.levels.append((lo, hi, lab, any_, all_))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1).astype(np.int64)


def dual_traversal(a: SignatureTree, b: SignatureTree, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) in different components whose overlap may do; each pair once when a is b."""
    top = max(len(a.levels), len(b.levels))
    i = j = np.zeros(1, np.int64)
    for level in range(top - 1, -1, -1):
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        keep_i, keep_j = [i[:0]], [j[:0]]
        for x in range(0, len(i), 200_000):                       # bounded memory
            p, q = i[x:x + 200_000], j[x:x + 200_000]
            ok = (la[1][p] * den >= lb[0][q] * num) & (lb[1][q] * den >= la[0][p] * num)
            ok &= (la[2][p] != lb[2][q]) | (la[2][p] < 0)
            if same:
                ok &= p <= q
            p, q = p[ok], q[ok]
            small = np.maximum(la[0][p], -(-lb[0][q] * num // den))    # least sizes that a linked pair here can have
            other = np.maximum(lb[0][q], -(-la[0][p] * num // den))
            need = -(-num * (small + other) // (num + den))
            # every bit that all members here have and none there is a shingle, at least, that is not shared
            most = np.minimum(la[1][p] - _popcount(la[4][p] & ~lb[3][q]), lb[1][q] - _popcount(lb[4][q] & ~la[3][p]))
            ok = most >= need
            if same and not level:
                ok &= p < q
            keep_i.append(p[ok])
            keep_j.append(q[ok])
        i, j = np.concatenate(keep_i), np.concatenate(keep_j)
        if level:
            na = len(a.levels[min(level - 1, len(a.levels) - 1)][0])
            nb = len(b.levels[min(level - 1, len(b.levels) - 1)][0])
            fi, fj = (FANOUT if level < len(x.levels) else 1 for x in (a, b))     # a shallower tree waits at its root
            ci, cj = i[:, None] * fi + np.arange(fi), j[:, None] * fj + np.arange(fj)
            i2 = np.repeat(ci, fj, axis=1).ravel()
            j2 = np.tile(cj, (1, fi)).ravel()
            ok = (i2 < na) & (j2 < nb)
            i, j = i2[ok], j2[ok]
    return a.order[i], b.order[j]


def leaf_pairs(group: np.ndarray, n: np.ndarray, label: np.ndarray, bits: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs within groups of LEAF members at most, rows of a group being neighbours: such a group is one leaf."""
    out = []
    for step in range(1, LEAF):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        j = i + step
        a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (label[i] != label[j]) & (a * den >= b * num)
        i, j = i[ok], j[ok]
        most = np.minimum(n[i] - _popcount(bits[i] & ~bits[j]), n[j] - _popcount(bits[j] & ~bits[i]))
        ok = most * (num + den) >= num * (n[i] + n[j])
        out.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _in_group(label: np.ndarray, n: np.ndarray, side: np.ndarray, bits: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that :func:`dual_traversal` leaves; of two different blocks, one row of each."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return left[:0], right[:0]
    same = bool((side == 2).all())
    tree = SignatureTree(n[left], label[left], bits[left])
    i, j = dual_traversal(tree, tree if same else SignatureTree(n[right], label[right], bits[right]), num, den, same)
    return left[i], right[j]


def _traverse(num: int, den: int):
    """Keeps the members of each group that may link with one of another component there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "bucket"):
            group, side = b["bucket"].to_numpy(), b["side"].to_numpy()
            n, label = b["n"].to_numpy(np.int64), pd.factorize(b["label"])[0]
            sized = b["bitmap"].tolist()
            bits = folded(sized)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.concatenate([first, [len(b)]]))
            small = np.flatnonzero(np.repeat((size <= LEAF) & (np.minimum.reduceat(side, first) == 2), size))
            use = np.zeros(len(b), dtype=bool)
            i, j = (small[x] for x in leaf_pairs(group[small], n[small], label[small], bits[small], num, den))
            for x in reachable(sized, n, i, j, num, den):
                use[x] = True
            large = np.ones(len(b), dtype=bool)
            large[small] = False
            for at, count in zip(first[large[first]].tolist(), size[large[first]].tolist()):
                own = slice(at, at + count)
                i, j = _in_group(label[own], n[own], side[own], bits[own], num, den)
                for x in reachable(sized, n, at + i, at + j, num, den):
                    use[x] = True
            yield b.loc[use, ["bucket", "doc", "label", "side"]]
    return run


def sized_bits(s: np.ndarray, t: np.ndarray, count: int) -> list[bytes]:
    """Packed token bitmaps of ``count`` texts, whose shingles are ``s`` and texts ``t``: of BITS to MOST_BITS, the power
    of two that is twice the text's shingles or more. A bitmap folded in halves is that of fewer bits."""
    n = np.bincount(t, minlength=count)
    width = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), BITS, MOST_BITS)
    end = np.cumsum(width)
    bits = np.zeros(int(end[-1]) if count else 0, dtype=np.uint8)
    bits[(end - width)[t] + (s % width[t].astype(np.uint64)).astype(np.int64)] = 1
    held = np.packbits(bits).tobytes()
    return [held[(e - w) // 8:e // 8] for e, w in zip(end.tolist(), width.tolist())]


def folded(bitmaps: list[bytes], size: int = BITS // 8) -> np.ndarray:
    """Bitmaps of ``size`` bytes or more as rows of that many."""
    out = np.empty((len(bitmaps), size // 8), np.uint64)
    length = np.array([len(x) for x in bitmaps], dtype=np.int64)
    for w in np.unique(length).tolist():
        at = np.flatnonzero(length == w)
        for x in range(0, len(at), max(1, (1 << 24) // w)):              # bounded memory
            own = at[x:x + max(1, (1 << 24) // w)]
            out[own] = np.bitwise_or.reduce(np.frombuffer(b"".join([bitmaps[k] for k in own.tolist()]), np.uint64).reshape(len(own), -1, size // 8), axis=1)
    return out


def reachable(bitmaps: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those whose bitmaps, in the narrower one's width, leave room for a link."""
    length = np.array([len(x) for x in bitmaps], dtype=np.int64)
    width, out = np.minimum(length[i], length[j]), []
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        rows = np.unique(np.concatenate([i[own], j[own]]))
        bits = folded([bitmaps[k] for k in rows.tolist()], w)
        for x in range(0, len(own), max(1, (1 << 24) // w)):             # bounded memory
            p, q = i[own[x:x + max(1, (1 << 24) // w)]], j[own[x:x + max(1, (1 << 24) // w)]]
            a, b = bits[np.searchsorted(rows, p)], bits[np.searchsorted(rows, q)]
            most = np.minimum(n[p] - _popcount(a & ~b), n[q] - _popcount(b & ~a))
            ok = most * (num + den) >= num * (n[p] + n[q])
            out.append((p[ok], q[ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (i[:0], j[:0])


def forest(sets: list[np.ndarray], label: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Of the pairs (i, j) those that link, but for pairs whose rows the links before, and equal labels, join already."""
    root = list(range(int(label.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x
    out = []
    order = np.argsort(i, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1], [True]])) if len(i) else [0]
    for lo, hi in zip(cut[:-1], cut[1:]):
        x = int(i[order[lo]])
        others = [y for y in j[order[lo:hi]].tolist() if find(label[y]) != find(label[x])]
        for at in range(0, len(others), 500):
            part = others[at:at + 500]
            size = np.array([len(sets[y]) for y in part])
            theirs = np.concatenate([sets[y] for y in part])
            place = np.minimum(np.searchsorted(sets[x], theirs), len(sets[x]) - 1)
            o = np.add.reduceat((sets[x][place] == theirs).astype(np.int64), np.cumsum(size) - size)
            for y in np.flatnonzero((num + den) * o >= num * (len(sets[x]) + size)).tolist():
                a, b = find(label[x]), find(label[part[y]])
                if a != b:
                    root[b] = a
                    out.append((x, part[y]))
    return out


def _verify(num: int, den: int):
    """Links (a, b) that join the components of each group, verified on the whole sets ``s`` of its rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, "bucket"):
            group, doc, side = b["bucket"].to_numpy(), b["doc"].to_numpy(), b["side"].to_numpy()
            sets = [np.sort(np.asarray(x, np.int64)) for x in b["s"]]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            sized = sized_bits(np.concatenate(sets).view(np.uint64), np.repeat(np.arange(len(sets)), n), len(sets))
            bits, rows = folded(sized), []
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                label = pd.factorize(b["label"].iloc[lo:hi])[0]
                i, j = _in_group(label, n[lo:hi], side[lo:hi], bits[lo:hi], num, den)
                i, j = reachable(sized[lo:hi], n[lo:hi], i, j, num, den)
                rows += [(doc[lo + x], doc[lo + y]) for x, y in forest(sets[lo:hi], label, i, j, num, den)]
            yield pd.DataFrame(rows, columns=["a", "b"], dtype=np.int64)
    return run


def _in_reach(num: int, den: int):
    """Keeps the pairs whose sizes and token bitmaps leave room for a link."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            at = np.arange(len(p))
            i, _ = reachable(p["bits"].tolist() + p["bits2"].tolist(), np.concatenate([p["n"].to_numpy(np.int64), p["m"].to_numpy(np.int64)]),
                             at, at + len(p), num, den)
            yield p.iloc[i][["a", "b"]]
    return run


def _whole_sets(wanted: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(doc, s) of the documents wanted, staged; no other texts are read."""
    texts = rows.join(sized_broadcast(wanted.distinct(), BROADCAST_ROWS), "doc")

    def fn(ids, texts):
        s, t = _sets(texts, k)
        cut = np.searchsorted(t, np.arange(len(ids) + 1))
        s = s.view(np.int64)
        return ids, [s[cut[i]:cut[i + 1]] for i in range(len(ids))]

    return stage(texts.select("doc", "body").mapInPandas(_per_chunk(fn, ["doc", "s"]), "doc long, s array<long>"))


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, verified on whole shingle sets; texts of candidates only are fetched.

    Sizes and bitmaps, which are narrow, are held against the threshold first, so that few whole sets move.
    """
    narrow = nodes.select("doc", "n", "bitmap").dropDuplicates(["doc"])
    pairs = (pairs.distinct().join(narrow.toDF("a", "n", "bits"), "a").join(narrow.toDF("b", "m", "bits2"), "b")
             .where(f"least(n, m) * {den} >= greatest(n, m) * {num}"))
    pairs = stage(pairs.select("a", "b", "n", "m", "bits", "bits2").mapInPandas(_in_reach(num, den), "a long, b long"))
    sets = _whole_sets(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")), rows, k)
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
    o = F.size(F.array_intersect("sa", "sb"))
    return stage(both.where((num + den) * o >= num * (F.size("sa") + F.size("sb"))).select("a", "b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4,
                den: int = 5) -> DataFrame:
    """(id, n_shingles, component) per row: component is the smallest id reachable by links, itself included.

    Ids are integers. Documents without words (null, empty, white space) have
    no shingles and link with nothing. Rows that share an id are one node of
    the graph, with one row each; a null id has a null component. An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    facts = stage(rows.mapInPandas(_facts(k), "doc long, n long, s1 long, s2 long, bitmap binary"))
    nodes = facts.where((F.col("n") > 0) & F.col("doc").isNotNull())
    first = nodes.groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"))
    member = stage(nodes.select("doc", "s1", "s2", "n").join(first, ["s1", "s2", "n"]).select("doc", "rep", "n"))
    equal = member.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    skip = sized_broadcast(equal.select(F.col("b").alias("doc")).distinct(), BROADCAST_ROWS)
    reps = rows.where(F.col("doc").isNotNull()).join(skip, "doc", "left_anti")

    # keys held by more than one document, then all their holders
    keys = reps.mapInPandas(_emit(k, num, den), "key long, doc long")
    shared = stage(keys.groupBy("key").agg(F.min("doc").alias("leader"), F.max("doc").alias("last"))
                   .where("leader < last").select("key", "leader"))
    held = stage(reps.mapInPandas(_emit(k, num, den, key_bitmap(shared, filter_bits(shared, FILTER_BITS))), "key long, doc long, n int")
                 .join(shared, "key").select("leader", "doc", "n").distinct())
    star = _links(held.where("leader <> doc").select(F.col("leader").alias("a"), F.col("doc").alias("b")), nodes, rows, k, num, den)

    # groups of one leader that hold several components (of two members whose sizes are out of reach nothing can come)
    comp = components(star).withColumnRenamed("node", "doc").withColumnRenamed("component", "label")
    named = stage(held.join(sized_broadcast(comp, BROADCAST_ROWS), "doc", "left").withColumn("label", F.coalesce("label", "doc")))
    mixed = (named.groupBy("leader").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("c"),
                                         F.min("n").alias("least"), F.max("n").alias("most"))
             .where(f"l <> m AND (c > 2 OR least * {den} >= most * {num})")
             .select("leader", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    inside = named.join(mixed, "leader").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # the pairs of blocks that a member's block stands in; side 2: both sides are the same block
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("p"), F.greatest(o, F.col("block")).alias("q"),
        F.when(o == F.col("block"), 2).when(F.col("block") < o, 0).otherwise(1).alias("side")))
    split = inside.select("leader", "doc", "label", "n", F.inline(sides)).join(nodes.select("doc", "n", "bitmap").distinct(), ["doc", "n"])
    close = stage(split.select(F.xxhash64("leader", "p", "q").alias("bucket"), "doc", "label", "side", "n", "bitmap")
                  .repartition("bucket").sortWithinPartitions("bucket")
                  .mapInPandas(_traverse(num, den), "bucket long, doc long, label long, side int").distinct())
    sets = _whole_sets(close.select("doc"), rows, k)
    more = stage(close.join(sets, "doc").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_verify(num, den), "a long, b long"))

    whole = components(star.unionByName(more).unionByName(equal)).select(F.col("node").alias("doc"), "component")
    return facts.select("doc", "n").join(whole, "doc", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id."""
    gone = near_groups(docs, id_col, **more).where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(sized_broadcast(gone, BROADCAST_ROWS), id_col, "left_anti").select(docs.columns)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


SQL_NGRAM = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
tok AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t HAVING count(*) > 1),
ord AS (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(c, 1), t) AS r FROM tok LEFT JOIN df USING (t)),
pre AS (SELECT doc_id, n, t FROM ord WHERE r <= n - (9 * n + 9) // 10 + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.t = b.t AND a.doc_id < b.doc_id
    AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
link AS (SELECT x, y FROM cand JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
    WHERE 19 * len(list_intersect(a.s, b.s)) >= 9 * (len(a.s) + len(b.s))),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM s UNION SELECT reach.d, edge.y FROM reach JOIN edge ON edge.x = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r) AS component_id FROM s JOIN reach ON reach.d = s.doc_id GROUP BY s.doc_id, s.s
"""
