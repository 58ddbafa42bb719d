"""Shingle joins, line dedup, suffix order and compact windows against brute force."""
import hashlib
import random

import numpy as np
import pytest

from edgeloom.llm import compact_windows, line_dedup, ngram_join, suffix_dedup
from edgeloom.llm.common import components

VOCAB = [a + b for a in ("ka", "lo", "mi", "ne", "su", "tar", "ven", "zo") for b in ("bel", "dor", "fin", "gal", "hun", "jes", "kop", "lam")]


def words(rng, n):
    return [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n)]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB) + "x"
    return w


def corpus(seed, base=60):
    """Random texts, exact copies, near copies at all distances, shared passages and odd rows."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(base)]
    for _ in range(base):
        w = rng.choice(texts).split()
        texts.append(" ".join(edited(rng, w, rng.randrange(0, max(1, len(w) // 12) + 1))))
    passage = words(rng, 60)
    texts += [" ".join(words(rng, rng.randrange(5, 60)) + passage + words(rng, rng.randrange(5, 60))) for _ in range(12)]
    texts += [None, "", "  \t ", "one", "one two", "ONE two", texts[0], texts[0], "é😀 " * 70, "\0 a b c", texts[1].upper()]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, body string, doc int").repartition(5)


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if x]
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])


def brute_groups(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,num,den,seed", [(3, 9, 10, 1), (5, 4, 5, 2), (2, 1, 2, 3)])
def test_groups(spark, k, num, den, seed):
    rows = corpus(seed)
    got = ngram_join.near_groups(frame(spark, rows), k=k, num=num, den=den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, k, num, den)


def test_groups_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(df, k=3).collect())
    assert got == [(-1, 2, None), (5, 2, 5), (5, 2, 5), (7, 0, 7)]
    assert ngram_join.near_groups(df.limit(0)).count() == 0
    assert ngram_join.keep_first(df.where("doc_id = 7")).columns == ["doc_id", "text"]


def test_dual_traversal_finds_what_all_pairs_do():
    rng = np.random.default_rng(5)
    sets = [set(rng.integers(0, 4000, rng.integers(5, 60)).tolist()) for _ in range(150)]
    sets += [set(list(s)[:-1]) | {9000 + i} for i, s in enumerate(sets[:60])]
    n, label = np.array([len(s) for s in sets]), np.arange(len(sets)) % 90
    bits = np.zeros((len(sets), ngram_join.BITS), np.uint8)
    for i, s in enumerate(sets):
        bits[i, [x % ngram_join.BITS for x in s]] = 1
    tree = ngram_join.SignatureTree(n, label, np.packbits(bits, axis=1).view(np.uint64))
    i, j = ngram_join.dual_traversal(tree, tree, 4, 5, True)
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert true <= found and len(found) < 5 * len(true) + 50


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rows = corpus(8, base=40)
    got = ngram_join.near_groups(frame(spark, rows), k=2, num=1, den=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 2, 1, 2)


def test_near_misses_make_few_rows(spark, monkeypatch):
    rng = random.Random(12)
    base, rows = words(rng, 200), []
    for i in range(60):                                        # two edits each: any two share 0.89 of their shingles at most
        w = list(base)
        w[3 * i + 4], w[3 * (i * 7 % 60) + 5] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(w)))
    counts, real = [], ngram_join.stage

    def counted(df):
        out = real(df)
        counts.append(out.count())
        return out
    monkeypatch.setattr(ngram_join, "stage", counted)
    got = ngram_join.near_groups(frame(spark, rows), k=3, num=9, den=10).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 3, 9, 10)
    assert max(counts) < 10 * len(rows)                        # neither a row per pair nor one per member and bucket


def test_near_misses_among_large_documents_are_told_by_their_bitmaps(spark, monkeypatch):
    """Documents of 1,500 shingles fill a bitmap of 1,024 bits, so that no two of them look unlike in it."""
    rng = random.Random(14)
    base, rows = words(rng, 1500), []
    for i in range(24):                                        # any two share about half of their shingles
        w = list(base)
        w[i % 20::20] = [f"x{i}x{k}" for k in range(len(w[i % 20::20]))]
        rows.append((i, " ".join(w)))
    rows.append((30, rows[5][1] + " end"))
    counts, real = [], ngram_join.stage

    def counted(df):
        out = real(df)
        if out.columns[:2] in (["a", "b"], ["bucket", "doc"]):
            counts.append(out.count())
        return out
    monkeypatch.setattr(ngram_join, "stage", counted)
    got = ngram_join.near_groups(frame(spark, rows), k=5, num=4, den=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 5, 4, 5)
    assert len(counts) == 4 and max(counts) < 10               # pairs, links, members left in a group, their links


def test_bitmaps_of_all_widths_bound_the_overlap():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64)) for n in (3, 400, 700, 900, 5000, 9000, 70000)]
    sets += [np.unique(np.concatenate([s[:int(len(s) * .95)], rng.integers(0, 1 << 60, len(s) // 50 + 1, dtype=np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    bitmaps = ngram_join.sized_bits(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets))
    assert {8 * len(b) for b in bitmaps} == {ngram_join.BITS, 2048, 16384, 32768, ngram_join.MOST_BITS}
    i, j = np.triu_indices(len(sets), 1)
    kept = set(zip(*(x.tolist() for x in ngram_join.reachable(bitmaps, n, i, j, 4, 5))))
    near = {(a, b) for a, b in zip(i.tolist(), j.tolist())
            if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert len(near) == 6 and near <= kept and len(kept) < 9


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(None, 3), (5, 5)]
    comp = {}
    for a, b in edges:
        if a is not None and a != b:
            comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a is not None and a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == comp
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_words(line):
    return frozenset(w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w)


def brute_lines(rows):
    before, out = [], set()
    for i, t in sorted((r for r in rows if r[0] is not None)):
        for k, line in enumerate((t or "").split("\n")):
            w = line_words(line)
            if w and any(5 * len(w & v) >= 4 * len(w | v) for v in before):
                out.add((i, k))
            before.append(w)
    return out


def line_corpus(seed):
    rng = random.Random(seed)
    pool = [words(rng, rng.randrange(1, 40)) for _ in range(50)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            w = rng.choice(pool) if rng.random() < 0.6 else words(rng, rng.randrange(1, 40))
            lines.append("  ".join(edited(rng, w, rng.randrange(0, len(w) // 6 + 1))))
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n \n"), (103, "A\tb\r"), (104, "a B"), (105, rows[0][1])]


def test_lines(spark):
    rows = line_corpus(3)
    got = line_dedup.later_matches(frame(spark, rows)).collect()
    want = brute_lines(rows)
    assert {(r["doc"], r["line"]) for r in got} == want and len(got) == len(want) > 50
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        left = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in want]
        touched = any(d == i for d, _ in want)
        if touched and not "".join(left).strip():
            assert i not in kept
        else:
            assert kept[i] == (None if t is None else "\n".join(left))


def test_unlike_long_lines_are_no_candidates(spark, monkeypatch):
    """Lines of 90 common words: most pairs share a prefix word, none matches."""
    rng = random.Random(6)
    common = [f"w{i}" for i in range(250)]
    rows = [(i, " ".join(rng.sample(common, 90))) for i in range(200)]
    pairs, real = [], line_dedup.stage

    def counted(df):
        out = real(df)
        if "count" in out.columns:
            pairs.append(out.count())
        return out
    monkeypatch.setattr(line_dedup, "stage", counted)
    assert {(r["doc"], r["line"]) for r in line_dedup.later_matches(frame(spark, rows)).collect()} == brute_lines(rows) == set()
    assert pairs == [0]


def test_near_copies_of_a_line_do_not_all_meet(spark, monkeypatch):
    """One large group of near copies whose edits are words of their own: these come first in every prefix."""
    rng = random.Random(9)
    base, rows = words(rng, 70), []
    for i in range(500):
        w = list(base)
        for k in rng.sample(range(70), rng.randrange(2, 7)):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    pairs, real = [], line_dedup.stage

    def counted(df):
        out = real(df)
        if "count" in out.columns:
            pairs.append(out.count())
        return out
    monkeypatch.setattr(line_dedup, "stage", counted)
    assert {(r["doc"], r["line"]) for r in line_dedup.later_matches(frame(spark, rows)).collect()} == brute_lines(rows)
    assert pairs[0] < 20 * len(rows)


def test_lines_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c", 3), (1, "a b c", 9), (None, "a b c", 3)], "doc_id long, text string, __x int")
    assert sorted(map(tuple, line_dedup.dedup_lines(df, chars_col="__x").collect()), key=str) == sorted(
        [(None, "a b c", 5), (1, "a b c", 5), (None, "a b c", 5)], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_tables_with_clashing_names(spark):
    """Names that the operator uses itself may be columns of the input."""
    names = ["gone", "of", "row", "id", "body", "lines", "removed", "kept", "doc", "line", "__gone", "__doc", "__lines", "__kept", "__removed", "a.b"]
    rows = [(1, "one two three\nfour five six") + tuple(range(len(names))), (2, "one two three\nseven") + tuple(range(len(names)))]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(df).collect())
    assert got == [rows[0], (2, "seven") + tuple(range(len(names)))]


def brute_bytes(rows, length=suffix_dedup.LENGTH):
    first, out = {}, {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, b in raw.items():
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            first[s] = min(i, first.get(s, i))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group", [5000, 1])
def test_bytes(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)            # 1: the way of very large groups
    rng = random.Random(11)
    rows = corpus(9)
    long = "".join(rng.choice("ab ") for _ in range(400))
    rows += [(1000 + i, long[rng.randrange(200):][:rng.randrange(40, 200)] + rng.choice("xyz") * rng.randrange(0, 60)) for i in range(40)]
    rows += [(2000, "z" * 300), (2001, "z" * 120), (2002, "é" * 30), (2003, "x" + "é" * 30), (2004, "a" * 49), (2005, "a" * 49), (2006, "a" * 50), (2007, "a" * 51)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == brute_bytes(rows)


def test_bytes_of_odd_tables(spark):
    t = "x" * 30 + "y" * 30
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t + t), (5, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(-1, 0), (3, 0), (3, 0), (4, 120), (5, 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_windows_are_the_tree_nodes():
    rng = np.random.default_rng(2)
    for _ in range(60):
        v = rng.integers(1 << 30, 1 << 62, rng.integers(1, 60)).astype(np.uint64)
        least = int(rng.integers(1, 12))
        want = set()
        for c in range(len(v)):
            a = b = c
            while a > 0 and v[a - 1] > v[c]:
                a -= 1
            while b < len(v) - 1 and v[b + 1] > v[c]:
                b += 1
            if b - a + 1 >= least:
                want.add((a, c, b))
        assert set(zip(*(x.tolist() for x in compact_windows.compact_windows(v, least)))) == want


def test_passages(spark):
    rows = corpus(21)
    got = compact_windows.near_passages(frame(spark, rows)).collect()
    text = dict(rows)
    for r in got:                                                # every passage is as near as it says
        a = shingles(" ".join((text[r["doc_id"]]).split()[r["start_word"]:r["end_word"]]), 5)
        b = shingles(" ".join((text[r["match_doc_id"]]).split()[r["match_start"]:r["match_end"]]), 5)
        assert r["match_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
        assert r["similarity"] >= 0.8 and abs(len(a & b) / len(a | b) - r["similarity"]) < 1e-9
    first, need = {}, set()
    for i, t in sorted(rows):
        w = (t or "").lower().split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k:k + 50]), i) < i:
                need.add(i)
    assert need <= {r["doc_id"] for r in got} and len(need) > 10
    assert compact_windows.near_passages(frame(spark, rows).limit(0)).count() == 0


def test_no_exact_passage_is_missed_among_many_holders(spark):
    """Parts of the passages stand in many documents, so first and previous holders differ from function to function."""
    rng = random.Random(31)
    rows, need = [], {}
    for p in range(6):
        passage = words(rng, 50)
        decoys = [words(rng, 40) + passage[k:k + 10] + words(rng, 40) for k in range(0, 41, 5) for _ in range(12)]
        rng.shuffle(decoys)
        a, d = (words(rng, 20) + passage + words(rng, 20) for _ in range(2))
        texts = decoys[:len(decoys) // 2] + [a] + decoys[len(decoys) // 2:] + [d]
        rows += [(1000 * p + i, " ".join(t)) for i, t in enumerate(texts)]
        need[rows[-1][0]] = 1000 * p + len(decoys) // 2
    got = compact_windows.near_passages(frame(spark, rows)).collect()
    for doc, lead in need.items():
        assert any(r["doc_id"] == doc and r["match_doc_id"] == lead and r["start_word"] <= 20 and r["end_word"] >= 70 for r in got)


@pytest.mark.parametrize("edits, size", [(0, 60), (1, 60), (1, 96), (2, 100), (2, 110), (3, 150), (5, 250)])
def test_whole_stretches_are_verified(edits, size):
    """Evenly spread edits: no run between two of them is worth the next, but the passage as a whole is near enough."""
    rng = random.Random(size + edits)
    for _ in range(20):
        p = [rng.random() for _ in range(size)]
        q = list(p)
        for e in range(edits):
            q[(e + 1) * size // (edits + 1)] = rng.random()
        around = [[rng.random() for _ in range(rng.randrange(30))] for _ in range(4)]
        a, b = (np.array([hash(tuple(w[i:i + 5])) & (1 << 63) - 1 for i in range(len(w) - 4)], dtype=np.uint64)
                for w in (around[0] + p + around[1], around[2] + q + around[3]))
        got = compact_windows.compare(a, b)
        assert any(x[1] - x[0] + 1 >= 0.9 * (size - 4) and x[4] >= 0.8 for x in got)


def test_recall_of_near_passages(spark):
    """Passages of 96 to 250 words with evenly spread edits, each once repeated: 0.9 of them or more are found."""
    rng, rows, need = random.Random(41), [], []
    for k, (edits, size) in enumerate([(1, 96), (2, 110), (3, 150), (3, 200), (5, 250)] * 8):
        p = words(rng, size)
        q = list(p)
        for e in range(edits):
            q[(e + 1) * size // (edits + 1)] = f"edit{k}x{e}"
        rows += [(2 * k, " ".join(words(rng, 15) + p + words(rng, 15))), (2 * k + 1, " ".join(words(rng, 15) + q + words(rng, 15)))]
        need.append((2 * k + 1, 2 * k, size))
    got = compact_windows.near_passages(frame(spark, rows)).collect()
    found = sum(any(r["doc_id"] == d and r["match_doc_id"] == m and r["end_word"] - r["start_word"] >= 0.8 * n for r in got) for d, m, n in need)
    assert found >= 0.9 * len(need)


@pytest.mark.parametrize("holders", [2, 12])
def test_recall_where_parts_stand_in_many_documents(spark, holders):
    """Every 20-word block of a passage stands in other documents too, all of them before the near repeat."""
    rng, rows, need = random.Random(50 + holders), [], []
    for k, (edits, size) in enumerate([(1, 96), (2, 110), (3, 150), (5, 250)] * 5):
        p = words(rng, size)
        q = list(p)
        for e in range(edits):
            q[(e + 1) * size // (edits + 1)] = f"edit{k}x{e}"
        texts = [words(rng, 30) + p[x:x + 20] + words(rng, 30) for x in range(0, size - 19, 20) for _ in range(holders)]
        texts.insert(rng.randrange(len(texts)), words(rng, 15) + p + words(rng, 15))
        lead = next(i for i, x in enumerate(texts) if len(x) == size + 30 and x[15:15 + size] == p)
        texts.append(words(rng, 15) + q + words(rng, 15))
        rows += [(1000 * k + i, " ".join(x)) for i, x in enumerate(texts)]
        need.append((rows[-1][0], 1000 * k + lead, size))
    got = compact_windows.near_passages(frame(spark, rows)).collect()
    found = sum(any(r["doc_id"] == d and r["match_doc_id"] == m and r["end_word"] - r["start_word"] >= 0.8 * n for r in got) for d, m, n in need)
    assert found >= 0.9 * len(need)


def test_partners_beyond_two_leaders_are_met(spark):
    """Every signature that a passage shares with its near repeat has two earlier holders, each of half of it."""
    rng, rows, need, k = random.Random(61), [], [], 0
    while len(need) < 6:
        p, base = words(rng, 60), 1000 * k
        k += 1
        decoys = []
        for at in range(0, 31, 3):
            decoys += [words(rng, 30) + p[at:at + 30] + words(rng, 30) for _ in range(5)]
        q = p[:30] + words(rng, 1) + p[31:]
        texts = [" ".join(x) for x in decoys + [words(rng, 9) + p + words(rng, 9), words(rng, 11) + q + words(rng, 11)]]
        number, key, _, _ = compact_windows.windows(texts)
        holders = {}
        for t, x in zip(number.tolist(), key.tolist()):
            holders.setdefault(x, set()).add(t)
        lead, last = len(texts) - 2, len(texts) - 1
        both = [sorted(h) for h in holders.values() if lead in h and last in h]
        if both and all(lead not in h[:2] for h in both):
            rows += [(base + i, t) for i, t in enumerate(texts)]
            need.append((base + last, base + lead))
    got = compact_windows.near_passages(frame(spark, rows).repartition(5)).collect()
    pairs = {(r["doc_id"], r["match_doc_id"]) for r in got}
    assert set(need) <= pairs


def test_pairs_move_once_and_only_texts_that_are_asked_for(spark, monkeypatch):
    """Pairs of windows are dealt to their documents once, without being made distinct first; where the lists of stretches
    are too many to be sent, no other text moves to them."""
    monkeypatch.setattr(compact_windows, "ARRAY_ROWS", 0)
    rows, plans, real = corpus(23), [], compact_windows.stage

    def seen(df, **more):
        plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, **more)
    monkeypatch.setattr(compact_windows, "stage", seen)
    near, _ = compact_windows._near_and_seen(frame(spark, rows).selectExpr("doc_id as doc", "coalesce(text, '') as body"))
    found = [p for c, p in plans if c == ["doc", "s", "e", "leader", "s2", "e2"]]
    assert len(found) == 2 and not any("Aggregate" in p for p in found)
    verified = [p for c, p in plans if "match_start" in c][:2]
    assert len(verified) == 2 and all("LeftSemi" in p for p in verified) and near.count() > 10


def test_joint_windows_have_the_least_hashes_of_all_their_functions():
    rng = random.Random(6)
    texts = [" ".join(words(rng, n)) for n in (49, 50, 51, 400)] + [None, "", " ".join(words(rng, 60) * 3)]
    number, key, a, b = compact_windows.windows(texts)
    s, t = compact_windows._sequence(texts)
    groups = compact_windows.HASHES // compact_windows.AGREE
    for i in set(t.tolist()):
        own = s[t == i]
        n = len(own) - compact_windows.MIN_SHINGLES + 1
        held = [[] for _ in range(n)]
        for k, x, y in zip(key[number == i].tolist(), a[number == i].tolist(), b[number == i].tolist()):
            for at in range(x, y + 1):
                held[at].append(k)
        assert all(len(h) == groups for h in held)
        same = {}
        for at, h in enumerate(held):                            # equal content, equal signatures
            assert same.setdefault(own[at:at + compact_windows.MIN_SHINGLES].tobytes(), sorted(h)) == sorted(h)


def test_runs_of_a_word_are_one_window():
    rng = random.Random(71)
    text = " ".join(words(rng, 60) + ["again"] * 1000 + words(rng, 60) + ["once", "more"] * 400 + words(rng, 60))
    number, _, a, b = compact_windows.windows([text, text])
    for i in (0, 1):
        assert (b - a)[number == i].max() > 600 and (number == i).sum() < 200
    assert sum((b - a + 1)[number == 0]) == 3 * (len(text.split()) - 4 - 45)     # every start, in all groups


def test_runs_of_a_word_in_many_documents(spark):
    """Documents that repeat one word, each in a run of its own length and place, at near and far diagonals."""
    rng, rows, run = random.Random(72), [], {}
    for i in range(12):
        before, size = words(rng, rng.randrange(5, 300)), rng.randrange(70, 600)
        run[i] = (len(before), len(before) + size)
        rows.append((i, " ".join(before + ["again"] * size + words(rng, 40))))
    got = compact_windows.near_passages(frame(spark, rows)).collect()
    for i in range(1, 12):
        assert any(r["doc_id"] == i and r["start_word"] <= run[i][0] + 5 and r["end_word"] >= run[i][1] - 5 for r in got)
    assert all(r["similarity"] >= 0.8 and r["match_doc_id"] < r["doc_id"] for r in got)
    met = {k: sum(1 for r in got if r["doc_id"] == k) for k in run}
    assert max(met.values()) <= 4 * 12                       # passages of whole runs, not one for each place


def test_longest_previous_factors():
    rng = random.Random(3)
    for _ in range(60):
        docs = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))])
        raw = [bytes(rng.choice([0, 1, 97]) for _ in range(5)) for _ in docs]
        got = suffix_dedup.longest_previous_factors(np.frombuffer(b"".join(raw), np.uint8).copy().view("S5"), docs)
        for i, x in enumerate(raw):
            assert got[i] == max((next((k for k in range(5) if x[k] != y[k]), 5) for y, d in zip(raw, docs) if d < docs[i]), default=0)
