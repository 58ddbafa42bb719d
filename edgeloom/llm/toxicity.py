"""Toxicity scores from a learned lexicon, fuzzy matching and context windows.

The lexicon (words and word beginnings) and the weights are learned from a
bounded sample of labelled rows. Misspelled terms are caught by intersecting
Levenshtein automata with the lexicon trie; the intersection is made
deterministic lazily, one transition at a time, and shared by all words a
worker sees. Every hit is weighed by the window around it: inside quotation
marks it counts apart from open abuse.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import table

#: Bounds of what is gathered to fit: labelled rows, lexicon terms.
MAX_FIT_ROWS = 20_000
MAX_TERMS = 400
#: A term stands for toxic text from this share of the unlike toxic fit documents (and at least so many), and
#: from this ratio of document rates.
MIN_TOXIC_SHARE = 0.004
MIN_TOXIC_DOCS = 6
MIN_RATIO = 12.0
PREFIXES = (4, 5, 6)
#: Words on either side of a hit in which an opening and a closing quotation mark make it a quotation.
WINDOW = 6
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")
_QUOTE = re.compile(r"[\"“”„«»‘’]")


class TrieAutomaton:
    """Lexicon trie intersected with Levenshtein automata of one edit (terms of five letters and more).

    A state is a set of (trie node, edits so far); states and transitions are
    made when first met. A whole term accepts at the end of a word, a beginning
    accepts as soon as it is read.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.child, self.end, self.far = [{}], [0], [False]     # end: 1 whole word, 2 beginning
        for term, beginning in sorted(terms):
            at = 0
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.end.append(0)
                    self.far.append(False)
                at = self.child[at][c]
            self.end[at] |= 2 if beginning else 1
            self.far[at] = self.far[at] or len(term) >= 5
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.done: list[tuple[int, int]] = []                  # best edits when the word ends here, when it goes on
        self.words: dict[str, int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set) -> int:
        todo = list(pairs)
        while todo:                                            # a letter of the term left out
            node, e = todo.pop()
            if e == 0:
                for n in self.child[node].values():
                    if (n, 1) not in pairs:
                        pairs.add((n, 1))
                        todo.append((n, 1))
        key = frozenset((n, e) for n, e in pairs if not (e == 1 and (n, 0) in pairs))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ok = [(e, self.end[n]) for n, e in key if self.end[n] and (e == 0 or self.far[n])]
            self.done.append((min((e for e, _ in ok), default=2), min((e for e, kind in ok if kind & 2), default=2)))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if (n := self.child[node].get(c)) is not None:
                out.add((n, e))
            if e == 0:
                out.add((node, 1))                             # a letter too many
                out.update((n, 1) for n in self.child[node].values())
        self.next[state][c] = s = self._state(out)
        return s

    def edits(self, word: str) -> int:
        """0 or 1: edits to the nearest term; 2: none within reach."""
        if (got := self.words.get(word)) is not None:
            return got
        s, best = self.start, 2
        for c in word:
            s = self.next[s].get(c, -1)
            s = s if s >= 0 else -1
            if s < 0:
                break
            best = min(best, self.done[s][1])
            if best == 0 or not self.sets[s]:
                break
        else:
            best = min(best, self.done[s][0])
            return self._keep(word, best)
        if s >= 0:
            return self._keep(word, best)
        s, best = self.start, 2                                # some transition was new: walk again and make it
        for c in word:
            s = self.next[s][c] if c in self.next[s] else self._step(s, c)
            best = min(best, self.done[s][1])
            if best == 0 or not self.sets[s]:
                return self._keep(word, best)
        return self._keep(word, min(best, self.done[s][0]))

    def _keep(self, word: str, best: int) -> int:
        if len(self.words) >= 300_000:                         # memory bound; only a cache
            self.words.clear()
        self.words[word] = best
        return best


N_FEATURES = 5


def features(text: str | None, lexicon: TrieAutomaton) -> list[float]:
    """log counts of exact and fuzzy hits, open and quoted, and the density of hits."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = {}
    for w in set(words):
        e = lexicon.edits(w)
        if e < 2:
            hits[w] = e
    if not hits:
        return [0.0] * N_FEATURES
    spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
    count = [[0, 0], [0, 0]]
    for i, w in enumerate(words):
        if w in hits:
            left = low[spans[max(0, i - WINDOW)][0]:spans[i][0]]
            right = low[spans[i][1]:spans[min(len(words) - 1, i + WINDOW)][1]]
            # an odd number of marks before the hit and another one after it: the hit is quoted
            quoted = len(_QUOTE.findall(left)) % 2 == 1 and _QUOTE.search(right) is not None
            count[hits[w]][quoted] += 1
    n = sum(map(sum, count))
    return [math.log1p(count[0][0]), math.log1p(count[0][1]), math.log1p(count[1][0]), math.log1p(count[1][1]),
            n / (len(words) + 20)]


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: list[float]            # of the features, then the bias

    def scores(self, texts, lexicon: TrieAutomaton) -> np.ndarray:
        x = np.array([features(t, lexicon) for t in texts], dtype=float).reshape(-1, N_FEATURES)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _lexicon(rows: DataFrame) -> list[tuple[str, bool]]:
    """Words and beginnings that mark toxic fit documents; at most MAX_TERMS reach the driver.

    Copies of one toxic text would make each of its words look toxic, so
    support counts unlike documents only: those that differ in the smallest
    hash of their long words, which copies with a few edits nearly always share.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), F.lit(0)))
    rows = rows.withColumn("w", words).withColumn("k", F.coalesce(
        F.array_min(F.transform(F.filter("w", lambda w: F.length(w) >= 8), lambda w: F.xxhash64(w))), F.xxhash64("_text")))
    words = rows.select("_id", "_y", "k", F.explode("w").alias("w"))
    parts = F.array(F.struct(F.col("w").alias("t"), F.lit(False).alias("b")),
                    *[F.when(F.length("w") >= n, F.struct(F.substring("w", 1, n).alias("t"), F.lit(True).alias("b")))
                      for n in PREFIXES])
    terms = words.select("_id", "_y", "k", F.inline(F.array_compact(parts))).distinct()
    unlike = F.countDistinct(F.when(F.col("_y") == 1, F.col("k")))
    n = rows.agg(unlike.alias("tox"), F.sum(1 - F.col("_y")).alias("ok")).first()
    tox, ok = n["tox"] or 0, n["ok"] or 0
    stat = terms.groupBy("t", "b").agg(unlike.alias("a"), F.sum(1 - F.col("_y")).alias("c"))
    ratio = ((F.col("a") + 0.5) / (tox + 1)) / ((F.col("c") + 0.5) / (ok + 1))
    found = (stat.where((F.col("a") >= max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * tox)) & (ratio >= MIN_RATIO) & (F.length("t") >= 3))
             .orderBy(F.desc("a"), "t", "b").limit(4 * MAX_TERMS).collect())
    kept: list[tuple[str, bool]] = []
    prefixes: set[str] = set()
    for r in sorted(found, key=lambda r: (not r["b"], len(r["t"]), r["t"])):      # short beginnings first
        if not any(r["t"][:k] in prefixes for k in PREFIXES):
            kept.append((r["t"], bool(r["b"])))
            if r["b"]:
                prefixes.add(r["t"])
    return kept[:MAX_TERMS]


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps; the bias is not shrunk much."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(xb.shape[1]), np.diag([0.05] * x.shape[1] + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        step = np.linalg.solve((xb * (p * (1 - p) + 1e-9)[:, None]).T @ xb + shrink, xb.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _mapper(terms: list[tuple[str, bool]], fn):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = TrieAutomaton(terms)
        for b in batches:
            yield fn(b, lexicon)
    return run


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Learn lexicon and weights from at most MAX_FIT_ROWS labelled rows outside the held-out fold.

    Rows are taken in the order of a hash of their id, so the sample does not
    lean on any source. Without a toxic and a clean row the model is a constant.
    """
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(MAX_FIT_ROWS))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(
        F.broadcast(chosen), "_id")                       # MAX_FIT_ROWS ids at most
    terms = _lexicon(rows)
    cols = [f"f{i}" for i in range(N_FEATURES)]

    def measure(b: pd.DataFrame, lexicon: TrieAutomaton) -> pd.DataFrame:
        out = pd.DataFrame([features(t, lexicon) for t in b["_text"]], columns=cols, dtype=float)
        out["_y"] = b["_y"].to_numpy()
        return out

    got = rows.select("_text", "_y").mapInPandas(
        _mapper(terms, measure), ", ".join(f"{c} double" for c in cols) + ", _y int").toPandas()
    y = got["_y"].to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 2)
        return Model(terms, [0.0] * N_FEATURES + [math.log(p / (1 - p))])
    return Model(terms, _logistic(got[cols].to_numpy(), y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per input row, whole texts; null and empty texts get the score of no hit.

    Repeated ids give repeated rows, null ids stay null; other columns are not
    read. No shuffle: a row is scored where it is read.
    """
    def run(b: pd.DataFrame, lexicon: TrieAutomaton) -> pd.DataFrame:
        return pd.DataFrame({id_col: b[id_col], "score": model.scores(b["_text"], lexicon)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInPandas(
        _mapper(model.terms, run), f"`{id_col}` {kind}, score double")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with their columns unchanged."""
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = TrieAutomaton(model.terms)
        for t in texts:
            yield pd.Series(model.scores(t, lexicon))

    return docs.where(scored(F.coalesce(F.col(text_col), F.lit(""))) < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
