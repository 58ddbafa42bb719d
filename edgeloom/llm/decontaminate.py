"""Benchmark decontamination by edit distance.

The CGK random walk (Chakraborty, Goldenberg, Koucky 2016) maps strings so that
a small edit distance becomes a small Hamming distance: a pointer moves over
the string, at step j it writes the byte it stands on and then moves on or
stays, by a random bit of (j, byte). Bit-sampling LSH keeps some of the steps
as a key. An edit lets two walks part, but they meet again, and steps sampled
before it are not touched.

Windows start at every word (in a word of more than LONG_WORD bytes at every
character), in items as in documents, so an exact copy always shares a key. Key
sizes go by item length, and a class gets walks with other bits until TARGET of
its items, edited as far as the similarity allows, share a key with their copy
(``plan``, a seeded simulation on the driver). Items of fewer than SHORT bytes, and
classes that do not reach the target in MOST_REPEATS walks, miss nothing: of
k + 1 parts of an item one outlives k edits, and parts are looked for at every byte.

Candidates are held against 64 bytes of the item around the shared key by a
bit-parallel search over many candidates at once, which decides items of 64 bytes or
less. What is left is verified exactly: the least edit distance between the
whole item and any passage of the document around the place that the window
names, by a bit-parallel Sellers search. ``recall()`` gives the whole in figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import sized_broadcast, table

SIMILARITY = 0.8
#: Share of items, edited up to the similarity, that must share a key with their copy.
TARGET = 0.97
MOST_REPEATS = 16
#: (least item bytes, steps walked, steps sampled); an item takes the first class it is long enough for.
CLASSES = ((64, 24, 14), (32, 12, 12))
#: Items of fewer bytes are looked for by their parts.
SHORT = CLASSES[-1][0]
#: In longer words a window starts at every character.
LONG_WORD = 32
#: Bytes of an item that a candidate is held against first; of a longer item's, the share of errors that similarity
#: leaves and LENIENT may be wrong there.
PIECE = 64
LENIENT = 0.16
#: A block of benchmark items that is sent to every task holds so many bytes at most; more items are done in more passes.
BLOCK_BYTES = 16 << 20
CHUNK = 2 << 20
#: Candidates that are held at once, and searched at once.
PAIRS = 1 << 18
LANES = 1 << 13
BROADCAST_ROWS = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
for _b in (9, 10, 11, 12, 13):
    _LOWER[_b] = 32
_M1 = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered and every run of white space one space, none at the ends."""
    return b" ".join(bytes(_LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)]).split())


def window_starts(buf: np.ndarray) -> np.ndarray:
    """Places in ``buf`` (texts with a zero byte after each) where windows start: every word, every character of a long one."""
    solid = (buf != 32) & (buf != 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    long = np.flatnonzero(size > LONG_WORD)
    if not len(long):
        return start
    n = size[long]
    inner = np.repeat(start[long] - np.cumsum(n) + n, n) + np.arange(n.sum())
    held = np.zeros(len(buf), dtype=bool)
    held[start] = held[inner[buf[inner] & 0xC0 != 0x80]] = True
    return np.flatnonzero(held)


def _walk_bits(repeat: int, steps: int) -> np.ndarray:
    return np.random.default_rng(1000 + repeat).integers(0, 2, (steps, 256)).astype(np.int32)


def _sampled(repeat: int, steps: int, kept: int) -> set[int]:
    return set(np.random.default_rng(2000 + repeat).choice(steps, kept, replace=False).tolist())


def keys(buf: np.ndarray, at: np.ndarray, repeat: int, steps: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sampled CGK key of the window at every place of ``at``, and where its walk ends; ``buf`` runs on for ``steps`` bytes."""
    bits, sampled = _walk_bits(repeat, steps), _sampled(repeat, steps, kept)
    p, key = at.astype(np.int32), np.full(len(at), repeat * 64 + steps, dtype=np.uint64)
    for j in range(max(sampled) + 1):
        c = buf[p]
        if j in sampled:
            key = (key ^ c) * _M1
            key ^= key >> np.uint64(29)
        last = p
        p = p + bits[j][c]
    return key, last + 1


def edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """``text`` after so many random byte edits (changes, insertions, deletions)."""
    s = bytearray(text)
    for _ in range(edits):
        at, c, how = int(rng.integers(0, len(s))), int(rng.integers(97, 123)), rng.integers(0, 3)
        if how == 0:
            s[at] = c
        elif how == 1:
            s.insert(at, c)
        elif len(s) > 1:
            del s[at]
    return bytes(s)


def _class_of(size: int) -> int:
    return next((c for c, (least, _, _) in enumerate(CLASSES) if size >= least), len(CLASSES))


def plan(items: list[tuple[int, bytes]], similarity: float = SIMILARITY, sample: int = 48, tries: int = 4) -> list[int]:
    """Walks for each class until TARGET of a sample's edited copies share a key; 0: by parts (or no such items)."""
    out, rng = [], np.random.default_rng(7)
    for c, (_, steps, kept) in enumerate(CLASSES):
        own = sorted({b for _, b in items if _class_of(len(b)) == c}, key=lambda b: (len(b), b))
        own = [own[i] for i in np.unique(np.linspace(0, len(own) - 1, sample).astype(int))] if own else []
        pairs = [(b, normalised(edited(b, _most(len(b), similarity), rng).decode("utf-8", "replace"))) for b in own for _ in range(tries)]

        def of(text: bytes, repeat: int, steps=steps, kept=kept) -> np.ndarray:
            buf = np.frombuffer(text + bytes(steps + 2), np.uint8)
            key, end = keys(buf, window_starts(buf), repeat, steps, kept)
            return key[end <= len(text)]

        left, repeats = pairs, 0
        while len(left) > (1 - TARGET) * len(pairs) and repeats < MOST_REPEATS:
            left = [(a, b) for a, b in left if not len(np.intersect1d(of(a, repeats), of(b, repeats)))]
            repeats += 1
        out.append(repeats if len(left) <= (1 - TARGET) * len(pairs) else 0)
    return out


def _most(size: int, similarity: float) -> int:
    return int((1 - similarity) * size + 1e-9)


def edit_search(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance between ``item`` and any passage of ``text``, and where that passage ends (first such)."""
    m = len(item)
    if not m:
        return 0, 0
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, where = full, 0, m, m, 0
    for j, c in enumerate(text):                           # Myers 1999, columns as one integer
        eq = peq.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp, hn = down | (full & ~(d0 | up)), up & d0
        score += 1 if hp & top else -1 if hn & top else 0
        hp, hn = (hp << 1) & full, (hn << 1) & full        # a passage may start anywhere: row 0 stays 0
        up, down = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, where = score, j + 1
    return best, where


class _Lookup:
    """Places of a sorted table of keys that hold a key, for many keys at once."""

    def __init__(self, key: np.ndarray, who: np.ndarray, off: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.who, self.off = key[order], who[order], off[order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self._slot(key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * _M1) >> np.uint64(44)).astype(np.int64)

    def pairs(self, mine: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, offset in the item) of every shared key, about PAIRS at a time."""
        may = np.flatnonzero(self.seen[self._slot(mine)])
        lo, hi = np.searchsorted(self.key, mine[may]), np.searchsorted(self.key, mine[may], "right")
        hit = np.flatnonzero(hi > lo)
        at, lo, n = at[may[hit]], lo[hit], (hi - lo)[hit]
        total, done = np.cumsum(n), 0
        while done < len(n):
            to = max(done + 1, int(np.searchsorted(total, total[done] - n[done] + PAIRS, "right")))
            k = n[done:to]
            pick = np.repeat(lo[done:to] - np.cumsum(k) + k, k) + np.arange(k.sum())
            yield np.repeat(at[done:to], k), self.who[pick], self.off[pick]
            done = to


def _codes(buf: np.ndarray, at: np.ndarray | None, size: int) -> np.ndarray:
    """The ``size`` bytes (8 at most) at every place of ``at``, or at every place that has as many, as a number."""
    n = len(buf) - size + 1 if at is None else len(at)
    code = np.zeros(max(0, n), np.uint64)
    for j in range(size):
        code = (code << np.uint64(8)) | (buf[j:j + len(code)] if at is None else buf[at + j])
    return code


class Index:
    """Window keys, and parts of the short items, of a block of items; what every task holds."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY, repeats: list[int] | None = None):
        self.items, self.similarity = items, similarity
        repeats = plan(items, similarity) if repeats is None else repeats
        self.buf, _, self.first = _joined([b for _, b in items])
        self.sizes = np.array([len(b) for _, b in items], dtype=np.int64)
        self.most = np.array([_most(len(b), similarity) for _, b in items], dtype=np.int64)
        self.tables, self.parts = [], []                   # (repeat, steps, kept, lookup), (size, lookup)
        of = np.array([_class_of(len(b)) for _, b in items])
        by_parts = of == len(CLASSES)
        for c, (_, steps, kept) in enumerate(CLASSES):
            own = np.flatnonzero(of == c)
            if not repeats[c]:
                by_parts[own] = True
            elif len(own):
                buf, text_of, first = _joined([items[k][1] for k in own])
                at, long_buf = window_starts(buf), np.concatenate([buf, np.zeros(steps + 1, np.uint8)])
                who, off = own[text_of[at]], at - first[text_of[at]]
                for repeat in range(repeats[c]):
                    key, end = keys(long_buf, at, repeat, steps, kept)
                    whole = end - at + off <= self.sizes[who]
                    self.tables.append((repeat, steps, kept, _Lookup(key[whole], who[whole], off[whole])))
        held: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(by_parts).tolist():
            n = min(int(self.most[k]) + 1, len(items[k][1]))
            cut = [len(items[k][1]) * i // n for i in range(n + 1)]
            for x, y in zip(cut, cut[1:]):
                held.setdefault(min(8, y - x), []).append((k, x))
        for size, where in sorted(held.items()):
            who, off = np.array(where, dtype=np.int64).T
            self.parts.append((size, _Lookup(_codes(self.buf, self.first[who] + off, size), who, off)))

    def candidates(self, buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in buf, item, offset in the item) of every shared key or part, some at a time."""
        if self.tables:
            at, long_buf = window_starts(buf), np.concatenate([buf, np.zeros(64, np.uint8)])
            for repeat, steps, kept, lookup in self.tables:
                yield from lookup.pairs(keys(long_buf, at, repeat, steps, kept)[0], at)
        for size, lookup in self.parts:
            code = _codes(buf, None, size)
            yield from lookup.pairs(code, np.arange(len(code)))

    def near(self, buf: np.ndarray, place: np.ndarray, who: np.ndarray, off: np.ndarray, low: np.ndarray,
             high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which candidates may be leaks, and the least edit distance of PIECE bytes of the item (the item, if shorter).

        Each one's text is ``buf`` from ``low`` to ``high``.
        """
        size = np.minimum(self.sizes[who], PIECE)
        begin = np.minimum(off, self.sizes[who] - size)
        slack = np.minimum(self.most[who], _most(PIECE, self.similarity))
        items = np.concatenate([self.buf, np.zeros(PIECE, np.uint8)])
        least = np.zeros(len(place), np.int64)
        for lo in range(0, len(place), LANES):
            x = slice(lo, lo + LANES)
            piece = items[(self.first[who[x]] + begin[x])[:, None] + np.arange(PIECE)]
            piece[np.arange(PIECE) >= size[x][:, None]] = 255   # no byte of UTF-8
            at = place[x] - off[x] + begin[x] - slack[x]
            least[x] = _least_distances(piece, size[x], buf, at, np.maximum(at, low[x]),
                                        np.minimum(at + size[x] + 2 * slack[x], high[x]))
        most = np.where(self.sizes[who] <= PIECE, self.most[who], ((1 - self.similarity + LENIENT) * size).astype(np.int64))
        return least <= most, least


def _least_distances(piece: np.ndarray, size: np.ndarray, buf: np.ndarray, at: np.ndarray, low: np.ndarray,
                     high: np.ndarray) -> np.ndarray:
    """:func:`edit_search` for many pieces of 64 bytes at most, each in ``buf`` from ``low`` to ``high``, read from ``at`` on."""
    one, top = np.uint64(1), (size - 1).astype(np.uint64)
    up, down = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
    score, best = size.copy(), size.copy()
    for j in range(int((high - at).max(initial=0))):
        p = at + j
        inside = (p >= low) & (p < high)
        c = np.where(inside, buf[np.clip(p, 0, len(buf) - 1)], 254).astype(np.uint8)
        eq = np.packbits(piece == c[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | ~(d0 | up), up & d0
        score += ((hp >> top) & one).astype(np.int64) - ((hn >> top) & one).astype(np.int64)
        hp, hn = hp << one, hn << one
        up, down = hn | ~(d0 | hp), hp & d0
        np.minimum(best, score, out=best, where=inside)
    return best


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return buf, np.repeat(np.arange(len(texts)), size), np.cumsum(size) - size


def leaks(texts: list[bytes], index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(number of the text, number of the item, edit distance, end of the passage) of every leak, best place each."""
    buf, text_of, first = _joined(texts)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    asked: set[tuple[int, int, int, int]] = set()          # (text, item, from, to)
    decided: dict[tuple[int, int], tuple[int, int]] = {}
    for place, who, off in index.candidates(buf):
        text = text_of[place]
        near, least = index.near(buf, place, who, off, first[text], first[text] + length[text])
        place, who, off, least, text = place[near], who[near], off[near], least[near], text[near]
        begin = place - first[text] - off
        whole = index.sizes[who] <= PIECE
        # items of PIECE bytes or less: the best place, the first of equal ones
        t, k, d, b = text[whole], who[whole], least[whole], begin[whole]
        order = np.lexsort((b, d, k, t))
        t, k, d, b = t[order], k[order], d[order], b[order]
        head = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])[:len(t)]
        for i, j, best in zip(t[head].tolist(), k[head].tolist(), zip(d[head].tolist(), b[head].tolist())):
            decided[i, j] = min(best, decided.get((i, j), best))
        # windows of one copy name the same place up to a few edits: they are verified once
        text, who, begin = text[~whole], who[~whole], begin[~whole]
        slack = index.most[who] + 2
        begin = begin // slack * slack
        asked.update(zip(text.tolist(), who.tolist(), (begin - slack).tolist(), (begin + index.sizes[who] + 2 * slack).tolist()))
    asked.update((t, k, b - int(index.most[k]), b + int(index.sizes[k] + index.most[k])) for (t, k), (_, b) in decided.items())
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for t, k, left, right in sorted(asked):
        item = index.items[k][1]
        old = found.get((t, k))
        if old is not None and old[0] == 0:
            continue
        left = max(0, left)
        d, end = edit_search(item, texts[t][left:max(0, right)])
        if d <= index.most[k] and (old is None or d < old[0]):
            found[t, k] = (d, left + end)
    for (t, k), (d, end) in found.items():
        yield t, k, d, end


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of BLOCK_BYTES at most (a longer item is a block of its own), one at a time on the driver."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).orderBy("i", "t")
    block, held = [], 0
    for r in rows.toLocalIterator():
        b = normalised(r["t"])
        if b:
            if block and held + len(b) > BLOCK_BYTES:
                yield block
                block, held = [], 0
            block.append((r["i"], b))
            held += len(b)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item, distance, similarity, end): documents that hold a passage within the edit distance of an item.

    Similarity is 1 - distance / item length, in bytes of the normalised text
    (A-Z lowered, white space collapsed); ``end`` is where the best passage
    ends. Null and empty documents and items match nothing. Items that repeat
    are separate items, repeated documents give repeated rows, other columns
    are not read, and an empty table gives no rows. Whole documents are read,
    a few at a time; nothing is shuffled.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance int, similarity double, end int"
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("body"))
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast((block, plan(block, similarity)))   # BLOCK_BYTES at most

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = Index(held.value[0], similarity, held.value[1])
            for b in batches:
                got, texts, ids, size = [], [], [], 0
                for doc, body in zip(b["doc"], b["body"]):
                    texts.append(normalised(body))
                    ids.append(doc)
                    size += len(texts[-1])
                    if size >= CHUNK:
                        got += [(ids[t], index.items[k], d, e) for t, k, d, e in leaks(texts, index)]
                        texts, ids, size = [], [], 0
                if texts:
                    got += [(ids[t], index.items[k], d, e) for t, k, d, e in leaks(texts, index)]
                yield pd.DataFrame({id_col: [g[0] for g in got], item_col: [g[1][0] for g in got],
                                    "distance": [g[2] for g in got],
                                    "similarity": [1 - g[2] / len(g[1][1]) for g in got], "end": [g[3] for g in got]})

        out = out.unionByName(rows.mapInPandas(run, schema))
    return out


def remove_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all other rows as they are (null ids too)."""
    leaking = find_leaks(docs, benchmark, id_col, **more).select(id_col).distinct()
    return docs.join(sized_broadcast(leaking, BROADCAST_ROWS), id_col, "left_anti").select(docs.columns)


def recall(items: list[bytes], edit_rate: float, tries: int = 20, seed: int = 1) -> float:
    """Share of edited item copies (random byte edits at this rate, in random surroundings) that are found, of those
    that the edits and the normalising after them leave within the similarity."""
    rng = np.random.default_rng(seed)
    index = Index([(i, b) for i, b in enumerate(items)])
    hit = total = 0
    for i, b in enumerate(items):
        for _ in range(tries):
            s = edited(b, int(edit_rate * len(b) + 1e-9), rng)
            around = bytes(rng.choice(np.frombuffer(b"abcdefghij ", np.uint8), 300))
            text = normalised((around[:150] + b" " + s + b" " + around[150:]).decode("utf-8", "replace"))
            if edit_search(b, text)[0] > index.most[i]:
                continue
            total += 1
            hit += any(k == i for _, k, _, _ in leaks([text], index))
    return hit / max(1, total)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
