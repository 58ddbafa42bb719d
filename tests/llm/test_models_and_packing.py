"""Toxicity, decontamination, nearest neighbours, packing and the pipeline."""
import random
import zlib

import numpy as np
import pytest

from edgeloom.llm import ann, decontaminate, packing, toxicity

SYL = ["ba", "ko", "li", "me", "nu", "pra", "sto", "ti", "vem", "zor"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYL) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(1)
    terms = [("idiot", False), ("scum", False), ("lowe", True), ("stupid", False), ("morons", True)]
    tree = toxicity.TrieAutomaton(terms)
    tries = ["idiot", "idiott", "idot", "scumm", "scum", "lowei", "lowx", "xmorons", "morns", "moronsabc", "stupyd", "", "é"]
    for t, _ in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randrange(0, 2)] = rng.choice(["", "a", "z", "o"])
            tries.append("".join(w) + rng.choice(["", "", "q"]))
    for w in tries + tries:                                      # the second time from the cache
        best = 2
        for t, beginning in terms:
            near = min(lev(w[:k], t) for k in range(len(w) + 1)) if beginning else lev(w, t)
            best = min(best, near if near == 0 or len(t) >= 5 else 2)
        assert tree.edits(w) == min(best, 2), w


def test_quotation_counts_apart():
    tree = toxicity.TrieAutomaton([("idiot", False)])
    open_, quoted = toxicity.features("you idiot there", tree), toxicity.features('they said "you idiot" there', tree)
    assert open_[0] > 0 and open_[1] == 0 and quoted[0] == 0 and quoted[1] > 0
    assert toxicity.features(None, tree) == toxicity.features("fine words", tree) == [0.0] * 5


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = random.Random(3)
    bad = ["grobian", "schurke", "vermin", "dolt"]
    docs, labels = [], []
    for i in range(500):
        w, y = prose(rng, rng.randrange(5, 80)).split(), int(i % 4 == 0)
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(bad) + (rng.choice(["", "x"]) if i > 100 else ""))
        docs.append((i, " ".join(w), "s", 1.5))
        if i % 5 < 4:
            labels.append((i, 1, y))
    docs += [(1000, None, None, None), (1001, "", "s", 0.0), (None, "vermin", "s", None)]
    labels += [(1000, 1, None), (None, 1, 1), (7777, 0, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string, _text double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 503 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.97
    assert got[1000] == got[1001] < 0.5 <= got[None]
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_labels_of_the_held_out_fold_are_not_read(toxic_tables):
    docs, labels = toxic_tables
    turned = labels.withColumn("toxic", labels["toxic"]).where(~toxicity.held_out())
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_without_labels(toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.fit(docs, labels.limit(0))
    assert all(abs(r["score"] - 0.25) < 1e-9 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_edit_search():
    rng = random.Random(2)
    for _ in range(150):
        a, b = bytes(rng.choices(b"abc", k=rng.randrange(1, 9))), bytes(rng.choices(b"abc", k=rng.randrange(0, 14)))
        want = min(lev(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.edit_search(a, b)[0] == want


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randrange(12, 50)) for _ in range(25)]
    docs = [prose(rng, rng.randrange(1, 150)) for _ in range(60)]
    for k in range(0, 60, 3):
        w = list(rng.choice(items))
        for _ in range(rng.randrange(0, len(w) // 40 + 1)):
            w[rng.randrange(len(w))] = rng.choice("qxy")
        docs[k] = prose(rng, 20) + "\n" + "".join(w).upper() + "  " + prose(rng, 5)
    docs += [None, "", "a", items[0], "\t".join(items[1].split())]
    rows = [(i, t, 0) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows + [(None, items[2], 0)], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "  ")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(df, bench).collect()}
    want = {}
    for i, t, _ in rows + [(None, items[2], 0)]:
        for j, item in enumerate(items):
            a = decontaminate.normalised(item)
            d, _ = decontaminate.edit_search(a, decontaminate.normalised(t))
            if d <= 0.2 * len(a):
                want[i, j] = d
    assert got == want and len(want) >= 20
    left = decontaminate.remove_leaking(df, bench)
    assert left.columns == df.columns
    # a null id names no document: its row stays
    assert {r["doc_id"] for r in left.collect()} == ({i for i, _, _ in rows} | {None}) - {i for i, _ in want if i is not None}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == decontaminate.find_leaks(df.limit(0), bench).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    items = [prose(rng, 20) for _ in range(12)]
    df = spark.createDataFrame([(i, prose(rng, 10) + " " + t) for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == {(i, i) for i in range(12)}


def test_recall_of_edited_items():
    rng = random.Random(12)
    items = [decontaminate.normalised(prose(rng, 40)) for _ in range(25)]
    assert decontaminate.recall(items, 0.0, 2) == 1.0
    assert decontaminate.recall(items, 0.05, 4) >= 0.95


def vectors(seed, n=900, d=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:300] = x[100]                                          # one vector holds many rows
    return x


def brute_nearest(ids, x, k=5):
    x = x.astype(np.float64)
    norm, out = np.sqrt((x * x).sum(1)), {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x * x[q]).sum(1) / (norm * norm[q])
        s[q] = -np.inf
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k]]
    return out


def test_recall_and_exact_scores(spark):
    x, ids = vectors(4), np.arange(900)
    rows = [(int(i), [float(v) for v in r], 1.0) for i, r in zip(ids, x)]
    rows += [(5000, None, 0.0), (5050, [0.0] * 24, 0.0), (5100, [float("nan")] * 24, 0.0), (5150, [float("inf")] + [1.0] * 23, 0.0),
             (5200, [1.0, None] + [1.0] * 22, 0.0), (5250, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(4)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(ids, x)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
    assert got[100] == want[100] and got[150] == want[150]       # ties go to the smaller id
    assert ann.nearest(df.limit(0), df).count() == 0


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_tiny_and_huge_vectors(spark):
    """Squares of these components vanish or overflow; their cosines do not."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, (x[7] * 1e-200).tolist()), (1050, (x[9] * 1e200).tolist()), (1100, [5e-324] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id in (7, 1000, 1050, 1100)")).collect()}
    assert got[(7, 1)][0] == 1000 and got[(1000, 1)][0] == 7 and got[(1050, 1)][0] == 9
    assert all(abs(got[k][1] - 1) < 1e-12 for k in ((7, 1), (1000, 1), (1050, 1)))
    assert len([k for k in got if k[0] == 1100]) == 5


def test_probing_misses_no_code():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (400, 3)).astype(np.uint16)
    index = ann.MultiIndex(codes)
    for radius in (0, 5, 14, 20, 48):
        for q in codes[:10]:
            assert set(index.within(q, radius).tolist()) == set(np.flatnonzero(ann.hamming(codes, q) <= radius).tolist())


def brute_fit(pieces, capacity):
    bins = []
    out = []
    for size, source, cluster in pieces:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and source not in b["s"] and cluster not in b["c"]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= size
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
        out.append(k)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(8)
    for _ in range(20):
        p = sorted([(rng.randrange(1, 60), rng.choice("abcdefgh"), rng.randrange(40)) for _ in range(120)], reverse=True)
        assert packing.best_fit([x[0] for x in p], [x[1] for x in p], [x[2] for x in p], 64) == brute_fit(p, 64)


def test_packing_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 90)), rng.choice(["a", "a", "a", "b", "c", None]), 7) for i in range(150)]
    rows += [(200, None, "a", 1), (201, " \n", "b", 1), (202, prose(rng, 700), "c", 1), (203, rows[0][1].upper(), "d", 1), (0, rows[0][1], rows[0][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int").repartition(3)
    got = [tuple(r) for r in packing.pack(df, capacity=100, shard_pieces=40).collect()]
    size = {}
    for d, piece, n, shard, b in got:
        assert 0 < n <= 100 or (n == 0 and shard is None and b is None)
        size[d] = size.get(d, 0) + n
    assert size[202] == 700 and sorted(p for d, p, *_ in got if d == 202) == list(range(7)) and size[200] == size[201] == 0
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[2] or "" for r in rows}
    shards = {}
    for d, piece, n, shard, b in got:
        if n:
            key = " ".join(text[d].lower().split())
            shards.setdefault(shard, []).append((-n, d, piece, source[d], key, b))
    assert len(shards) > 1
    for own in shards.values():
        own.sort()
        bins = {}
        for want, x in zip(brute_fit([(-n, s, c) for n, _, _, s, c, _ in own], 100), own):
            assert bins.setdefault(want, x[5]) == x[5]
    assert packing.pack(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path, toxic_tables):
    import corpus_pipeline as cp

    rng = random.Random(15)
    item = prose(rng, 30)
    docs, labels = toxic_tables
    extra = [(2000, prose(rng, 80), "en", "a", 1), (2002, prose(rng, 40) + " " + item, "en", "b", 1), (2003, "one line here now\n" + prose(rng, 60), "en", "c", 1),
             (2004, "one line here now\n" + prose(rng, 60), None, None, None), (2006, "one line here now", "en", "c", 17)]
    extra.append((2001, extra[0][1].replace("ba", "bo", 1), "en", "a", 1))
    toxic = next(r["text"] for r in docs.collect() if r["doc_id"] == 4)
    extra.append((2005, toxic + " " + prose(rng, 10), "en", "a", 1))
    plain = docs.where("doc_id < 500").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) as bigint) AS n_chars")
    all_docs = plain.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    all_docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frames, cur = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, fn in cp.STAGES:
        fn(spark, cur, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        before, cur = cur, spark.read.parquet(f"{tmp_path}/out-{name}")
        frames[name] = {r["doc_id"]: r for r in cur.collect()}
        if name != cp.STAGES[-1][0]:
            assert cur.columns == before.columns
    clean = {i for i in range(500) if i % 4}
    assert clean <= set(frames["toxicity"]) and 4 not in frames["toxicity"] and 2005 not in frames["toxicity"]
    assert frames["line_dedup"][2004]["text"] == extra[3][1].partition("\n")[2]
    assert frames["line_dedup"][2004]["n_chars"] == len(frames["line_dedup"][2004]["text"]) and 2006 not in frames["line_dedup"]
    assert 2002 in frames["ngram_jaccard_join"] and 2002 not in frames["decontamination"]
    assert set(frames["best_fit_packing"]) == set(frames["decontamination"])
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} == set(frames["best_fit_packing"])


def test_exact_copies_of_short_items_are_found():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    items = [" ".join(word() for _ in range(n)).encode() for n in range(1, 13) for _ in range(10)]
    items += ["漢字かな交じり文の見本です水火木金土日月星空海".encode(), b"x" + bytes(rng.choices(b"abc/.", k=90))]
    index = decontaminate.Index(list(enumerate(items)))
    texts = [(" ".join(word() for _ in range(40)) + " ").encode() + t + b" " + word().encode() for t in items]
    glued = [b"ab (" + t + b")" for t in items]
    for docs in (texts, glued):
        exact = {(t, k) for t, k, d, _ in decontaminate.leaks(docs, index) if d == 0}
        assert {(k, k) for k in range(len(items))} <= exact


def test_edited_short_items_against_brute_force():
    rng, pick = random.Random(22), np.random.default_rng(22)
    items = [decontaminate.normalised(prose(rng, n)) for n in (1, 2, 3, 4) for _ in range(8)]
    items = [b for b in items if len(b) < decontaminate.SHORT]
    docs = [decontaminate.normalised(prose(rng, 6)) + b" " + decontaminate.edited(b, len(b) // 5, pick) for b in items for _ in range(3)]
    index = decontaminate.Index(list(enumerate(items)))
    got = {(t, k): d for t, k, d, _ in decontaminate.leaks(docs, index)}
    want = {(t, k): d for t, x in enumerate(docs) for k, b in enumerate(items)
            for d in [decontaminate.edit_search(b, x)[0]] if d <= 0.2 * len(b)}
    assert got == want and len(want) >= len(docs)


@pytest.mark.parametrize("rate", [0.1, 0.15, 0.2])
def test_recall_up_to_the_threshold(rate):
    rng = random.Random(23)
    items = [decontaminate.normalised(prose(rng, n)) for n in (8, 12, 16, 20, 40) for _ in range(8)]
    assert decontaminate.recall(items, rate, 4) >= 0.95
