"""Spelling variants: the vocabulary composed with a one-edit transducer and with itself.

Counting the words is Spark's (extraction, deletion rule, one grouped count).
Near pairs come from finite-state composition. The vocabulary is dealt by
initial state: words that share their first letters go on from one state of the
acceptor, and an edit behind those letters keeps both words in that part. An
edit within them leaves the same last letters, so those pairs meet in the
acceptor of the reversed words. Of each part a task builds the minimal acyclic
acceptor A and composes A, the one-edit transducer and A again:

* before the edit both sides are in the same state, so all that can follow is
  known once per state of the minimal acceptor, however many prefixes lead there;
* at the edit two arcs (replaced) or an arc and the state itself (inserted,
  deleted) are followed, and from there only what both right languages accept;
* a state knows how many words lie below it, so an accepted pair is a pair of
  positions in the sorted part.

A part of more than ``limit`` words is divided at the next letter where its words
part. The pairs whose edit is that letter share all the rest, and are found by
an equi join on it, so no task holds more than ``limit`` words or one key's
letters, and no pair is lost. Only one row per word and part leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import ascii_lower, table, whole_groups
from edgeloom.session import stage

#: Letters of a word.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
#: Shortest word, least occurrences, how many times a form outnumbers its variant, and the deletion rule's divisor.
LEAST, OCCURS, RATIO, DIVISOR = 7, 2, 10, 31
#: First letters that words of a part share. Edits within them leave ``LEAST - HEAD`` last letters or more alike.
HEAD = 3
#: Words of a part that one task composes at once, and of all its parts about.
LIMIT, WORDS_PER_TASK = 8_000, 20_000


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct strings.

    State q accepts the empty string if ``final[q]``, has the arcs
    ``arcs[q]`` (letter -> state, in letter order) and ``count[q]`` strings.
    Arcs lead to states of smaller number; ``root`` has the largest.
    """

    def __init__(self, strings: list[str]):
        self.final, self.arcs, self.count, self.sizes = [], [], [], []
        known: dict = {}
        path, last = [[False, {}]], ""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, *arcs.items())
                q = known.get(key)
                if q is None:
                    q = known[key] = len(self.final)
                    n, sizes = int(final), int(final)
                    for r in arcs.values():
                        n += self.count[r]
                        m = self.sizes[r]
                        sizes |= (m << 1 | m >> 63) & 0xFFFFFFFFFFFFFFFF
                    self.final.append(final)
                    self.arcs.append(arcs)
                    self.count.append(n)
                    self.sizes.append(sizes)             # lengths accepted, modulo 64, as bits
                if path:
                    path[-1][1][last[len(path) - 1]] = q

        for s in strings:
            same, most = 0, min(len(s), len(last))
            while same < most and s[same] == last[same]:
                same += 1
            settle(same)
            path.extend([False, {}] for _ in range(len(s) - same))
            path[-1][0] = True
            last = s
        settle(0)
        settle(-1)
        self.root = len(self.final) - 1

    def offsets(self, q: int) -> dict:
        """Of each letter, the position of its first string among those of the state."""
        at, out = int(self.final[q]), {}
        for c, r in self.arcs[q].items():
            out[c] = at
            at += self.count[r]
        return out


class Composition:
    """Accepted pairs of acceptor, one-edit transducer, acceptor: positions (i, j) of strings one edit apart."""

    def __init__(self, acceptor: Acceptor):
        self.a, self._common = acceptor, {}
        self._offsets = [acceptor.offsets(q) for q in range(len(acceptor.final))]

    def common(self, r: int, s: int) -> list:
        """Positions below r and s of the strings that both accept."""
        if r == s:
            return [(i, i) for i in range(self.a.count[r])]
        if not self.a.sizes[r] & self.a.sizes[s]:
            return []
        found = self._common.get((r, s))
        if found is None:
            self._follow(r, s)
            found = self._common[(r, s)]
        return found

    def _follow(self, r: int, s: int) -> None:
        """The pair of states, after those that both sides reach from it (no recursion: words may be long)."""
        a, common, arcs, sizes = self.a, self._common, self.a.arcs, self.a.sizes
        todo = [(r, s)]
        while todo:
            x, y = todo[-1]
            if (x, y) in common:
                todo.pop()
                continue
            ax, ay = arcs[x], arcs[y]
            both = [c for c in ax if c in ay] if len(ax) <= len(ay) else [c for c in ay if c in ax]
            steps = [(c, ax[c], ay[c]) for c in both]
            wait = [(u, v) for _, u, v in steps if u != v and sizes[u] & sizes[v] and (u, v) not in common]
            if wait:
                todo.extend(wait)
                continue
            out = [(0, 0)] if a.final[x] and a.final[y] else []
            for c, u, v in steps:
                ox, oy = self._offsets[x][c], self._offsets[y][c]
                if u == v:
                    out.extend((ox + i, oy + i) for i in range(a.count[u]))
                elif sizes[u] & sizes[v]:
                    out.extend((ox + i, oy + j) for i, j in common[(u, v)])
            common[(x, y)] = out
            todo.pop()

    def edits_at(self, q: int) -> list:
        """Pairs below q that differ in their first letter there."""
        a, out, sizes = self.a, [], self.a.sizes
        arcs, at = list(a.arcs[q].items()), self._offsets[q]
        for k, (c, r) in enumerate(arcs):
            m, o = sizes[r], at[c]
            for d, s in arcs[k + 1:]:                                   # c replaced by d
                if m & sizes[s]:
                    p = at[d]
                    out.extend((o + i, p + j) for i, j in (self.common(r, s) if r < s else
                                                           [(y, x) for x, y in self.common(s, r)]))
            if not m & sizes[q]:
                continue
            if a.final[q] and a.final[r]:                               # c inserted before what follows
                out.append((0, o))
            ar, orr = a.arcs[r], self._offsets[r]
            for d, s in arcs:
                if d != c and d in ar:                                  # before c itself: counted one letter on
                    x, y = s, ar[d]
                    if x == y or sizes[x] & sizes[y]:
                        p, t = at[d], o + orr[d]
                        out.extend((p + i, t + j) for i, j in (self.common(x, y) if x <= y else
                                                               [(v, u) for u, v in self.common(y, x)]))
        return out

    def pairs(self) -> np.ndarray:
        """All pairs of the acceptor, each once, as rows (i, j)."""
        a, below = self.a, []
        for q in range(len(a.final)):                                   # arcs lead to smaller numbers
            own = self.edits_at(q)
            parts = [np.array(own, dtype=np.int64)] if own else []
            for c, r in a.arcs[q].items():
                if below[r] is not None:
                    o = self._offsets[q][c]
                    parts.append(below[r] + o if o else below[r])
            below.append(None if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts))
        last = below[a.root]
        return np.empty((0, 2), np.int64) if last is None else last


def near_in_part(words: list[str], n: np.ndarray, shared: int, behind: bool) -> tuple:
    """Of the words of one part with near words in it: (word, n_near, near_n, near), one column each.

    The first ``shared`` letters are the same in all. ``behind``: the strings are
    reversed words, and only pairs that differ within the words' first ``HEAD``
    letters count (the others have met in front).
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    words, n = [words[i] for i in order], n[order]
    pair = Composition(Acceptor([w[shared:] for w in words])).pairs()
    if behind:
        words = [w[::-1] for w in words]
        if len(pair):
            head = np.array([w[:HEAD] for w in words], dtype=object)
            pair = pair[head[pair[:, 0]] != head[pair[:, 1]]]
    if not len(pair):
        return [], [], [], []
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__))] = np.arange(len(words))
    me, other = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([pair[:, 1], pair[:, 0]])
    by = np.lexsort((rank[other], -n[other], me))
    me, other = me[by], other[by]
    first = np.flatnonzero(np.r_[True, me[1:] != me[:-1]])
    return ([words[i] for i in me[first]], np.diff(np.r_[first, len(me)]).tolist(), n[other[first]].tolist(),
            [words[i] for i in other[first]])


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words of all parts of a partition sorted by part."""
    for b in whole_groups(batches, "part"):
        part, s, n = b["part"].to_numpy(), b["s"].tolist(), b["n"].to_numpy(np.int64)
        shared, behind = b["shared"].to_numpy(), b["behind"].to_numpy()
        cut = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(b)]
        out = [], [], [], []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if j - i > 1:
                for held, new in zip(out, near_in_part(s[i:j], n[i:j], int(shared[i]), bool(behind[i]))):
                    held.extend(new)
        word, count, near_n, near = out
        yield pd.DataFrame({"word": np.array(word, dtype=object), "n_near": np.array(count, np.int64),
                            "near_n": np.array(near_n, np.int64), "near": np.array(near, dtype=object)})


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurs: int = OCCURS,
               divisor: int = DIVISOR) -> DataFrame:
    """(word, n): words of ``least`` letters or more that occur ``occurs`` times or more in all texts.

    A word is a maximal run of ``LETTERS``, A-Z in lower case. Where ``divisor``
    divides h, the crc32 of ``<id>:<run>``, the run has lost its letter number
    h % length. A null text has no words; a null id is written as nothing;
    repeated rows count again; other columns are not read.
    """
    run = F.col("run")
    low = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(ascii_lower(run))
    h, size = F.col("h"), F.length("run")
    at = (h % size).cast("int")
    word = F.when(h % divisor == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, size))).otherwise(run)
    return (docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
            .select("id", low.alias("run"))
            .select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
            .select(word.alias("word")).where(F.length("word") >= least)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurs))


_PART = ["behind", "key"]
_NEAR = "word string, n_near long, near_n long, near string"


def _letters_alike(a: str, b: str):
    """How many first letters two strings share."""
    short = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.sequence(F.lit(0), short), lambda i: (i > 0) & (F.left(F.col(a), i) == F.left(F.col(b), i))))


def _divide(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts cut at the letter where their words first part: the smaller parts, and (word, near words) across them."""
    at = F.col("alike")
    smaller = hot.select("behind", F.left(F.col("s"), at + 1).alias("key"), (at + 1).alias("shared"), "s", "n")
    whole, after = F.col("s").substr(at + 1, F.length("s")), F.col("s").substr(at + 2, F.length("s"))
    rest = F.array(F.struct(whole.alias("rest"), F.lit("").alias("letter")),
                   F.struct(after.alias("rest"), F.left(whole, F.lit(1)).alias("letter")))
    ends = (hot.select("behind", "key", "s", "n", "alike", F.posexplode(rest).alias("cut", "end"))
            .where((F.col("cut") == 0) | (F.length("s") > at)).select("behind", "key", "s", "n", "end.rest", "end.letter"))
    # words with equal rests have distinct letters in front of them: as many as there are letters, at most
    met = (ends.groupBy("behind", "key", "rest")
           .agg(F.collect_list(F.struct("n", F.when(F.col("behind"), F.reverse("s")).otherwise(F.col("s")).alias("word"), "letter")).alias("all"))
           .where(F.size("all") > 1))
    one, letter, head = F.col("one.word"), F.col("one.letter"), F.left("rest", F.lit(1))

    def parted(x):
        # a letter inserted before the same letter parts the two words further on
        later = ((x["letter"] == "") & (letter == head)) | ((letter == "") & (x["letter"] == head))
        return (x["word"] != one) & ~later & (~F.col("behind") | (F.left(x["word"], F.lit(HEAD)) != F.left(one, F.lit(HEAD))))

    others = F.filter("all", parted)
    best = F.array_min(F.transform("others", lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word"))))
    across = (met.select("behind", "rest", "all", F.explode("all").alias("one")).select(one.alias("word"), others.alias("others"))
              .where(F.size("others") > 0)
              .select("word", F.size("others").cast("long").alias("n_near"), best.alias("best"))
              .select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near")))
    return smaller, across


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, near_n, near) of the words with near words: how many, and the one of largest n (ties: first in
    code-point order). ``words``: distinct (word, n), each word of ``LEAST`` letters or more."""
    front = F.struct(F.lit(False).alias("behind"), F.left("word", F.lit(HEAD)).alias("key"), F.lit(HEAD).alias("shared"), F.col("word").alias("s"))
    back = F.reverse("word")
    tail = LEAST - HEAD
    rear = F.struct(F.lit(True).alias("behind"), F.left(back, F.lit(tail)).alias("key"), F.lit(tail).alias("shared"), back.alias("s"))
    parts = words.select("n", F.inline(F.array(front, rear))).select("behind", "key", "shared", "s", "n")
    ready, found = None, None
    while True:
        large = stage(parts.groupBy(*_PART).agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("a"), F.max("s").alias("z"))
                      .where(F.col("c") > limit).select(*_PART, _letters_alike("a", "z").alias("alike")))
        small = parts.join(large, _PART, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        if large.isEmpty():
            break
        parts, across = _divide(parts.join(large, _PART))
        parts, across = stage(parts), stage(across)
        found = across if found is None else found.unionByName(across)

    ready = stage(ready)
    tasks = max(ready.sparkSession.sparkContext.defaultParallelism, ready.count() // WORDS_PER_TASK)
    part = F.concat(F.when(F.col("behind"), "<").otherwise(">"), "key")
    pairs = (ready.select(part.alias("part"), "behind", "shared", "s", "n").repartition(tasks, "part").sortWithinPartitions("part")
             .mapInPandas(_compose, _NEAR))
    pairs = pairs if found is None else pairs.unionByName(found)
    return (pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.near").alias("near")))


def group_variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n).

    A word's form is its near word of largest n, if that is ``ratio`` times the
    word's n or more. The root is where the chain of forms ends. Counts grow by
    ``ratio`` along a chain, so the largest count bounds its length, and steps
    double. An empty vocabulary gives no rows.
    """
    words = stage(words)
    form = F.col("near_n") >= ratio * F.col("n")
    rows = stage(words.join(near_words(words, limit), "word", "left")
                 .select("word", F.when(form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(form, F.col("near_n")).alias("form_n")))
    most, least = words.agg(F.max("n"), F.min("n")).first()
    chain = 0
    while most is not None and least * ratio ** (chain + 1) <= most:
        chain += 1
    jump = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    reach = 1
    while reach < chain:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = stage(jump.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        reach *= 2
    return (rows.join(jump, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(table(spark, sf_dir, "documents")))


#: Words by the same rule; near words meet by what is left when one letter is taken out.
SQL_SPELLING = r"""
WITH RECURSIVE table256 AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
    FROM range(256) r(b))
), raw AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS pre,
         unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT pre, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM raw WHERE length(r) >= 7
), hashed AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(pre || r)) + 1),
              lambda i: CAST(('0x' || substr(hex(encode(pre || r)), 2 * i - 1, 2)) AS BIGINT))),
              lambda x, y: xor(x >> 8, t[CAST(xor(x & 255, y) AS BIGINT) + 1])), 4294967295) AS h
  FROM runs, table256
), words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT near.word, count(*) AS n_near, max(v.n) AS near_n, arg_min(near.near, (-v.n, near.near)) AS near
  FROM near JOIN words v ON v.word = near.near GROUP BY near.word
), forms AS (
  SELECT w.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL
), roots AS (
  SELECT chain.word, chain.at AS root FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
