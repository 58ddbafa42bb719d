"""Spelling variants, vector codes and byte-level BPE against brute force, SQL and the rank format's own library."""
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Regex, pre_tokenizers

from edgeloom.llm import byte_bpe as B
from edgeloom.llm import queries as Q
from edgeloom.llm import spelling as S
from edgeloom.llm import vector_codes as V

RANKS = public.path("byte_bpe_50k.tiktoken")


# ------------------------------------------------------------ spelling
def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def variants_by_hand(n):
    out = {}
    best = {}
    for w in n:
        around = [v for v in n if near(w, v)]
        top = min(around, key=lambda v: (-n[v], v), default=None)
        best[w] = top if top is not None and n[top] >= 10 * n[w] else None
        out[w] = [best[w], None, n[w], len(around), n[best[w]] if best[w] else None]
    for w in n:
        r = w
        while best[r]:
            r = best[r]
        out[w][1] = r
    return {(w, *v) for w, v in out.items()}


def words_by_hand(docs):
    n = Counter()
    for i, t in docs:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                n[run] += 1
                run = ""
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def random_words(rng, size, letters="abé", shared=""):
    out = set()
    while len(out) < size:
        out.add(shared + "".join(rng.choice(letters) for _ in range(rng.randrange(7 if not shared else 1, 11))))
    return {w for w in out if len(w) >= 7}


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghij"])
def test_composition_gives_every_pair_once(letters):
    rng = random.Random(len(letters))
    words = sorted(random_words(rng, 90, letters) | {"", "a", "b", "ab", "ba", "aa", "aab"})
    pairs = [tuple(sorted(p)) for p in S.Composition(S.Acceptor(words)).pairs().tolist()]
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_acceptor_is_minimal_and_takes_long_words():
    a = S.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(a.final) == 5 and a.count[a.root] == 4
    long = "x" * 50_000
    assert S.Composition(S.Acceptor([long + "a", long + "b"])).pairs().tolist() == [[0, 1]]


@pytest.mark.parametrize("limit", [3, 25, 10_000])
def test_near_words_at_any_limit(spark, limit):
    """Parts that are divided lose no pair: shared beginnings, shared ends, words that are others' beginnings."""
    rng = random.Random(limit)
    words = random_words(rng, 60) | random_words(rng, 60, "ab", "prefixx") | {w[::-1] for w in random_words(rng, 60, "ab", "xiffuss")}
    n = {w: rng.choice([2, 2, 3, 20, 31, 400, 5000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {tuple(r) for r in S.group_variants(df, limit=limit).collect()}
    assert got == variants_by_hand(n)


def test_vocabulary_rule_and_edge_rows(spark):
    rng = random.Random(5)
    vocab = ["straße", "Übermäßig", "ÜBERMÄSSIG", "naïveté×÷a", "Wörterbuch", "letters", "LETTERS", "shorts", "a" * 40]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(40)) + rng.choice([".", "1", "_", "\n"])) for i in range(60)]
    docs += [(1, None), (2, ""), (None, "nullnames nullnames"), (3, "repeated"), (3, "repeated"), (4, "y" * 200_000 + " " + "y" * 200_000)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, word string, n int, run int")
    got = {r["word"]: r["n"] for r in S.vocabulary(df).collect()}
    assert got == words_by_hand(docs)
    assert got["repeated"] == 2 and "nullnames" in got


def test_spelling_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.group_variants(S.vocabulary(df)).collect() == []


def test_chain_of_forms(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "zzzzzzz": 5}
    got = {r["word"]: r["root"] for r in S.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == {w: "aaabbbb" if w[0] == "a" else w for w in n}


# ------------------------------------------------------------ vector codes
def lloyd_by_hand(x, parts, entries, rounds):
    w = x.shape[1] // parts
    books = [[x[k, p * w:(p + 1) * w].tolist() for k in range(min(entries, len(x)))] for p in range(parts)]

    def best(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for r in x[:, p * w:(p + 1) * w].tolist():
                held.setdefault(best(p, r)[1], []).append(r)
            for k, rs in held.items():
                books[p][k] = [sum(c) // len(rs) for c in zip(*rs)]
    last = [[best(p, r) for p, r in ((p, row[p * w:(p + 1) * w].tolist()) for p in range(parts))] for row in x]
    return books, [[k for _, k in row] for row in last], [sum(d for d, _ in row) for row in last]


@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "far"])
def test_trees_assign_as_brute_force_and_cover_every_place(kind):
    rng = np.random.default_rng(2)
    x = {"spread": rng.integers(-300, 300, (700, 32)), "ties": rng.integers(-2, 3, (700, 32)),
         "equal": np.repeat(rng.integers(-9, 9, (1, 32)), 700, axis=0),
         "far": rng.integers(-V.MOST, V.MOST, (300, 32))}[kind]
    t = V.build(x)
    books = np.stack([x[:64, p * 2:p * 2 + 2] for p in range(16)])
    first, last, entry, taken = V.assign(t, books)
    by = np.argsort(first)
    assert first[by][0] == 0 and last[by][-1] == 16 * len(x) and (first[by][1:] == last[by][:-1]).all()
    code = np.empty((len(x), 16), int)
    code[t.order, np.arange(16 * len(x)) // len(x)] = np.repeat(entry[by], (last - first)[by])
    want = np.stack([V.distance(x[:, None, p * 2:p * 2 + 2], books[p][None]).argmin(axis=1) for p in range(16)], axis=1)
    assert (code == want).all()
    for i in range(len(t.first)):                               # a node's rows lie within its radius
        held = t.points[t.first[i]:t.last[i]]
        assert (np.sqrt(V.distance(held, t.points[t.centre[i]]).astype(float)) <= t.radius[i]).all()
    if kind == "equal":
        assert len(t.first) == 16                               # equal rows, however many, are one node


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(3)
    centres = rng.integers(-20000, 20000, (30, 64))
    x = centres[rng.integers(0, 30, 6000)] + rng.integers(-4, 5, (6000, 64))
    t = V.build(x)
    first, last, _, taken = V.assign(t, np.stack([centres[:, p * 4:p * 4 + 4] for p in range(16)]))
    assert taken < 0.1 * 16 * 30 * 6000 and (last - first).max() > 50


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.3, 32)], int(i) % 3 if i % 7 else None) for i in rng.permutation(150)]
    rows += [(900, rows[0][1], 1), (900, rows[0][1], 1), (901, [0.0] * 32, None)]
    dropped = [(1000, None, 1), (1001, [], 1), (1002, [None] + [0.0] * 31, 1), (1003, [float("nan")] + [0.0] * 31, 2),
               (1004, [float("inf")] + [0.0] * 31, 2), (1005, [0.5] * 16, 2), (1006, [0.5] * 33, 2)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + dropped], "vec_id long, embedding array<double>, label int, id string, error int")
    kept = sorted(rows, key=lambda r: r[0])
    x = np.array([[math.floor(256 * v) for v in r[1]] for r in kept])
    books, code, error = lloyd_by_hand(x, 16, 64, 2)
    fitted = V.fit(df.repartition(5))
    assert fitted.books.tolist() == books
    got = sorted((r["id"], r["codes"], r["error"], r["label"]) for r in V.codes(fitted).select("id", "codes", "error", "label").fillna(-1).collect())
    assert got == sorted((r[0], c, e, -1 if r[2] is None else r[2]) for r, c, e in zip(kept, code, error))
    assert fitted.sha256() == hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()


def test_codes_of_huge_null_and_empty_input(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert V.fit(spark.createDataFrame([], schema)) is None
    assert V.fit(spark.createDataFrame([(1, None, 1)], schema)) is None
    huge = [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [1e-300] * 16, None), (None, [0.0] * 16, None)]
    got = {r["id"]: r for r in V.codes(V.fit(spark.createDataFrame(huge, schema))).collect()}
    assert got[1]["codes"] == [0] * 16 and got[2]["codes"] == [1] * 16 and got[3]["codes"] == [2] * 16 == got[None]["codes"]
    lone = V.fit(spark.createDataFrame([(None, [0.25] * 16, 1)], schema))
    assert lone.books.tolist() == [[[64]]] * 16


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_vector_codes"])
def test_query_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(Q.ORACLES[name])
    got = Q.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


# ------------------------------------------------------------ byte-level BPE
@pytest.fixture(scope="module")
def library():
    ranks = {t: r for r, t in enumerate(B.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "plain words, don't they're", "  \n\t x  \r\n", "naïve 漢字 🙂👩‍👩‍👧 ́", "a" * 5000, "ab " * 3000, "\n" * 3000, "1234567890" * 50,
         "\x00\x01\x1c\x85  　end", "<|endoftext|>", "½²٣ⅷ", "﻿bom", "é" * 777]


def test_ids_are_those_of_the_rank_format(spark, library):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("ab 's1é漢🙂\n\t-.") for _ in range(rng.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)] + [(5000, None, "x", None), (None, "no id", "x", None), (0, "again", "x", None)],
                               "doc_id long, text string, id string, ids array<int>")
    coded = B.encode(df, RANKS, public.PATTERN)
    want = [(i, library.encode_ordinary(t)) for i, t in [*enumerate(texts), (5000, ""), (None, "no id"), (0, "again")]]
    assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in coded.collect()))) == sorted(map(repr, want))
    back = B.decode(coded, RANKS, public.PATTERN).collect()
    assert sorted((bytes(r["bytes"]), r["text"]) for r in back) == sorted((t.encode(), t) for t in [*texts, "", "no id", "again"])


def test_pieces_chunks_and_a_lookup_that_starts_anew(library, monkeypatch):
    tok, *_ = B._load(B.build(B.read_ranks(RANKS), public.PATTERN))
    rng = random.Random(7)
    bits = ["word", " ", "  ", "\n", "'s", "-", "é", "\x1c", "漢", "\x85", "\u00a0", "\u2003", "\x0b", "7", "longer-word", "\u200b", "\u180e"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(400))) for _ in range(150)]
    monkeypatch.setattr(B.pieces, "__defaults__", (50,))
    encoder = B.Encoder(tok, public.PATTERN, most=300)
    for t in texts:
        assert "".join(B.pieces(t)) == t
        assert encoder.ids(t).tolist() == library.encode_ordinary(t)
    assert encoder.held < 20_000


def test_every_code_point(library):
    """The library's Unicode tables and the rank format's agree on the ids of every code point between other characters."""
    tok, *_ = B._load(B.build(B.read_ranks(RANKS), public.PATTERN))
    text = [f"a{c}a1{c}1 {c} {c}{c}.{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c < "\ue000"][::7]
    assert [e.ids for e in tok.encode_batch_fast(text, add_special_tokens=False)] == [library.encode_ordinary(t) for t in text]
    common = [c for c in map(chr, range(0x3000)) if B._COMMON.fullmatch(c)]
    split, encoder = pre_tokenizers.Split(Regex(public.PATTERN), "isolated"), B.Encoder(tok, public.PATTERN)
    for c in common:
        t = f"a{c}a1{c}1 {c} {c}{c}.{c}  {c}"
        assert encoder.split(t) == [m for m, _ in split.pre_tokenize_str(t)]
        assert encoder.ids(t).tolist() == library.encode_ordinary(t)


def test_spans_and_split_characters(spark, library):
    texts = [t for t in TEXTS if t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in B.encode(df, RANKS, public.PATTERN, offsets=True).collect():
        t, at = texts[r["doc_id"]], 0
        raw, begins = t.encode(), np.cumsum([0] + [len(c.encode()) for c in t])
        for i, b, e, c, d in zip(r["ids"], r["byte_start"], r["byte_end"], r["char_start"], r["char_end"]):
            assert raw[b:e] == library.decode_single_token_bytes(i) and b == at
            assert begins[c] <= b < begins[c + 1] and begins[d - 1] < e <= begins[d]
            at = e
        assert at == len(raw)
    ids = library.encode_ordinary("🙂漢")                         # cut within a character: bytes exact, text marked
    cut = spark.createDataFrame([(1, ids[:1]), (2, ids), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: (bytes(r["bytes"]), r["text"]) for r in B.decode(cut, RANKS, public.PATTERN).collect()}
    assert got[1][0] == library.decode_bytes(ids[:1]) and "�" in got[1][1]
    assert got[2] == ("🙂漢".encode(), "🙂漢") and got[3] == got[4] == (b"", "")


def test_byte_table_and_ranks(tmp_path):
    assert len(set(B.byte_alphabet())) == 256 and B.byte_alphabet()[0x20] == "Ġ" and B.byte_alphabet()[0x41] == "A"
    bad = tmp_path / "ranks"
    bad.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        B.read_ranks(str(bad))


def test_bpe_query(spark, library):
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_bpe_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.decode(B.encode(df, RANKS, public.PATTERN), RANKS, public.PATTERN).collect() == []
