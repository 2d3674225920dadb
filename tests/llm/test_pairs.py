"""Joins and searches against brute force."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import components as C
from lattica.llm import decontam as D
from lattica.llm import embed_neardup as E
from lattica.llm import jaccard_join as J
from lattica.llm import queries
from lattica.llm.common import chunks, table


def groups(ids, links):
    up = {i: i for i in ids}

    def top(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    want = groups({x for p in links for x in p}, links)
    for few in (C.FEW_LINKS, 0):
        old, C.FEW_LINKS = C.FEW_LINKS, few
        got = {r["id"]: r["component"] for r in C.components(df).collect()}
        assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
        assert C.components(df.limit(0)).count() == 0
        C.FEW_LINKS = old


def test_blocks_meet_once(spark):
    df = spark.createDataFrame([(k % 3, i) for k in range(3) for i in range(40 if k else 7)] + [(9, 1)], "k long, id long")
    b = C.blocked(df, ["k"], "id", 8).collect()
    assert not [r for r in b if r["k"] == 9]
    met: dict = {}
    for r in b:
        met.setdefault((r["k"], r["lo"], r["hi"]), []).append(r)
    pairs = [(k, x["id"], y["id"]) for (k, lo, hi), rows in met.items() for x in rows for y in rows if x["id"] < y["id"] and (lo == hi or x["own"] != y["own"])]
    assert len(pairs) == len(set(pairs)) == 7 * 6 // 2 + 2 * (40 * 39 // 2)


def test_components_meet_others_once(spark):
    rows = [(k, i, 1 if i % 9 or k == 2 else i) for k in range(3) for i in range(90 if k else 8)]
    b = C.apart(spark.createDataFrame(rows, "k long, id long, c long"), "k", "c", "id", 8).collect()
    met: dict = {}
    for r in b:
        met.setdefault((r["k"], r["lo"], r["hi"]), []).append(r)
    pairs = [(k, x["id"], y["id"]) for (k, lo, hi), g in met.items() for x in g for y in g if x["id"] < y["id"] and x["c"] != y["c"] and (lo == hi or x["own"] != y["own"])]
    assert sorted(pairs) == sorted((k, i, j) for k, i, c in rows for l, j, d in rows if k == l and i < j and c != d)


def brute_jaccard(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    ids = sorted(sets)
    links = []
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 85 * (len(x) + len(y) - n):
                    links.append((a, b))
    return {i: (len(s), g) for (i, s), g in zip(sorted(sets.items()), (groups(ids, links)[i] for i in ids), strict=True)}


def near_copies(rng, n, words, edits):
    vocab = [f"w{i}" for i in range(500)]
    base = rng.choices(vocab, k=words)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


def test_jaccard_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, " \n", "a", "A", "a b", "a b c d", "a b c d e", "A b c", "x " * 50, "x " * 51, *near_copies(rng, 60, 120, 5), *near_copies(rng, 25, 30, 1), *near_copies(rng, 12, 2000, 30)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(rng.choices('abcdefghij', k=80))}" for _ in range(40)] + ["same text of a few words"] * 30
    df = spark.createDataFrame([(i * 3 + 1, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    want = brute_jaccard({i * 3 + 1: t for i, t in enumerate(texts)})
    old = J.LIST_BLOCK, J.HOT_LEAST, J.HOT_SHARE, J.BROADCAST_IDS
    for J.LIST_BLOCK, J.HOT_LEAST, J.HOT_SHARE, J.BROADCAST_IDS in (old, (16, 2, 0.0, 0)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.contract(df).collect()}
        assert got == want
    J.LIST_BLOCK, J.HOT_LEAST, J.HOT_SHARE, J.BROADCAST_IDS = old
    assert J.contract(df.union(df)).count() == 2 * len(texts)
    twice = df.union(spark.createDataFrame([(1, "other text of the same id", 1), (4, texts[11], 1)], df.schema))
    again = {}
    for r in J.contract(twice.repartition(7)).collect():
        again.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in again.values())
    assert J.contract(df.limit(0)).count() == 0


def test_jaccard_on_documents(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.contract(d).collect()}
    assert got == brute_jaccard({r["doc_id"]: r["text"] for r in d.collect()})


def test_shingles_are_counted_in_all_documents(spark):
    rng = random.Random(9)
    d = spark.range(20_000).orderBy(F.xxhash64(F.lit("jaccard"), "id"))
    left_out = [r.id for r in d.collect()][16_000:16_020]  # a draw of 16,000 leaves their common passage out
    passage = " ".join(f"p{k}" for k in range(15))
    rows = [(i, " ".join(f"w{rng.getrandbits(40)}" for _ in range(25)) + (f" {passage}" if i in set(left_out) else "")) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    shared = spark.sparkContext.broadcast(J.common_shingles(docs))
    some = docs.where(F.col("id").isin(left_out)).select(J._describe(shared)("text").alias("d")).select("d.*")
    doc, h = J.shingles(next(chunks(pa.array([passage]))))
    assert len(h) == 12
    for r in some.collect():
        assert r.n == 37 and len(r.prefix) == 6 and not set(r.prefix) & set(h.view(np.int64).tolist())


def test_copies_count_once_and_counts_are_never_too_small(spark):
    texts = ["a b c d e", "A b c d  e", "b c d e f", "a b c d e", "x y", None, "", " ", "a b c d " * 50]
    one = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    blocks = {k: np.frombuffer(zlib.decompress(z), np.uint32) for b in J._counted(iter([one, one])) for k, z in zip(b["block"].to_pylist(), b["n"].to_pylist(), strict=True)}
    n = np.concatenate([blocks.get(k, np.zeros(J.COUNTS_BLOCK, np.uint32)) for k in range(J.BUCKETS // J.COUNTS_BLOCK)])
    of = lambda t: int(n[J._bucket(J.shingles(next(chunks(pa.array([t]))))[1])[0]])
    assert (of("a b c d"), of("b c d e"), of("c d e f"), of("x y"), int(n.sum())) == (2, 2, 1, 1, 9)
    ranks, hot = J.common_shingles(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1))
    assert (ranks == J._rank(n)).all() and hot == J._rank(np.array(J.HOT_LEAST))
    big = J._rank(np.array([0, 1, 2, 3, 1000, 2**31]))
    assert (np.diff(big.astype(int)) > 0).all() and big[0] == 0


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 900):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 1 << 62, n // 2).astype(np.uint64))))
        bits = int(J.sketch_bits(np.array([min(len(a), len(b))]))[0])
        s = [np.bincount((x & np.uint64(bits - 1)).astype(int), minlength=bits) & 1 for x in (a, b)]
        assert (s[0] != s[1]).sum() <= len(np.setxor1d(a, b))
    assert J.may_link(100, 100, 16) and not J.may_link(100, 100, 17)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base + 0, base[:30] + rng.normal(scale=0.01, size=(30, 32)), np.repeat(base[:2], 20, axis=0), base[3] + rng.normal(scale=0.02, size=(80, 32)), base[5:8] * 3])
    label = rng.integers(0, 2, len(x))
    rows = [(i * 2, v.tolist(), int(a), "z") for i, (v, a) in enumerate(zip(x, label, strict=True))]
    odd = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, []]
    rows += [(10_001 + i, v, 1, None) for i, v in enumerate(odd)] + [(20_001, x[0].tolist(), None, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(s, False)
    comp = groups([i * 2 for i in range(len(x))], [(int(i) * 2, int(j) * 2) for i, j in zip(*np.nonzero(np.triu(s)), strict=True)])
    old = E.LIST_BLOCK
    for size in (old, 8):
        E.LIST_BLOCK = size
        got = {r["vec_id"]: r for r in E.contract(df).collect()}
        assert len(got) == len(rows)
        assert sum(got[i * 2]["n_links"] for i in range(len(x))) >= 0.9 * s.sum()
        assert all(got[i * 2]["n_links"] <= s[i].sum() for i in range(len(x)))
        assert np.mean([got[k]["component_id"] == v for k, v in comp.items()]) > 0.97
        assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (*range(10_001, 10_007), 20_001))
    E.LIST_BLOCK = old
    assert E.contract(df.limit(0)).count() == 0 and E.contract(df.limit(1)).first()["kept"]


def brute_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
        prev = cur
    return min(prev)


def edits(p, t):
    prev = list(range(len(t) + 1))
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
        prev = cur
    return prev[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ([rng.randint(1, 5) for _ in range(rng.randint(lo, 40))] for lo in (1, 0))
        a, b = np.array(p, np.uint64), np.array(t, np.uint64)
        best, begin = D.locate(a, b)
        assert best == brute_distance(p, t) == D.distance(a, b)[0]
        assert brute_distance(p, t[begin:]) == best


def test_recall_of_edited_items(spark):
    items = table(spark, "/root/testdata/sf0.01", "benchmark")
    rng = random.Random(7)
    rows = [(r["item_id"], r["text"].split()) for r in items.collect()]
    vocab = sorted({w for _, t in rows for w in t})
    docs, want = [], []
    for i, t in rows:
        for _ in range(5):
            w = list(t)
            for _ in range(rng.randint(0, D.bound(len(D.item_words([" ".join(t)])[0])))):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + [rng.choice(vocab)] + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + [rng.choice(vocab)] + w[k:]])
            want.append((len(docs), i))
            docs.append(" ".join(rng.choices(vocab, k=50) + w + rng.choices(vocab, k=50)))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.query(df, items).collect()}
    assert len(got & set(want)) >= 0.95 * len(want)


def test_leaks_against_brute_force(spark):
    d, items = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    words = lambda t: [int(x) for x in D.item_words([t or ""])[0]]
    want = set()
    its = [(r["item_id"], words(r["text"])) for r in items.collect()]
    for r in d.collect():
        t = words(r["text"])
        here = set(t)
        for i, w in its:
            if w and sum(x not in here for x in w) <= D.bound(len(w)) and brute_distance(w, t) <= D.bound(len(w)):
                want.add((r["doc_id"], i, brute_distance(w, t)))
    got = D.query(d, items).collect()
    assert want and {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want
    texts, wanted = {r["doc_id"]: words(r["text"]) for r in d.collect()}, dict(its)
    for r in got:  # the place is right: the item's distance to the text from there on, at its beginning, is the one stated
        w = wanted[r["item_id"]]
        assert any(edits(w, texts[r["doc_id"]][r["first_word"] : r["first_word"] + n]) == r["distance"] for n in range(len(w) - r["distance"], len(w) + r["distance"] + 1))


def test_decontamination_odd_inputs(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven", "z"), (2, None, "z"), (3, "", "z"), (3, "ONE, two; three four five six", None)], "doc_id long, text string, leaks string")
    items = spark.createDataFrame([(7, "One two three four five six", 1), (7, "One two three four five six", 1), (8, "two", 1), (11, "Six seven", 1), (12, "six eight", 1), (13, " ,", 1), (None, "one two three four five", 1), (9, None, 1)], "item_id long, text string, doc_id int")
    got = D.query(df, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["first_word"]) for r in got) == [(1, 7, 0, 0), (1, 8, 0, 1), (1, 11, 0, 5), (3, 7, 0, 0), (3, 8, 0, 1)]
    assert D.query(df, items.limit(0)).count() == 0 and D.query(df.limit(0), items).count() == 0
    old, D.BLOCK_WORDS = D.BLOCK_WORDS, 5
    many = items.unionByName(spark.createDataFrame([(10, "two three four five six seven", 1)], items.schema))
    assert sorted((r["doc_id"], r["item_id"]) for r in D.query(df, many).collect()) == [(1, 7), (1, 8), (1, 10), (1, 11), (3, 7), (3, 8)]
    D.BLOCK_WORDS = old
    assert D.leaks(df, items, into="found").where(F.size("found") > 0).select("leaks").count() == 2


def leaked(items, docs):
    index = D.Index(list(enumerate(D.item_words(items))))
    return [{i for d, i, _, _ in index.search(c) if int(c.rows[d]) == k} for k in range(len(docs)) for c in D.chunks(pa.array(docs), D.WORDS_FOLD)]


def test_items_that_repeat_words():
    items = ["0 0 0 0 0 0 0", "0 0 0 0 0 1 0 0", "a b a b a b a b a b a b a b a b", "1 2 3 4 5 6 7 8"]
    docs = ["x y 0 0 0 0 0 0 0 z", "x 0 0 0 0 0 2 0 0 z", "0 0 0 0 1", "0 0 0 z z 0 0 0", "", "b " + "a b " * 7 + "c", "1 2 3 4 9 6 7 8", "0 0 0 0 0 1 0 0 " + "u v w " * 9]
    assert leaked(items, docs) == [{0, 1}, {0, 1}, set(), set(), set(), {2}, {3}, {0, 1}]
    rng = random.Random(5)
    for _ in range(300):
        item, text = rng.choices("aab", k=rng.randint(5, 16)), rng.choices("aabc", k=rng.randint(0, 40))
        index = D.Index([(0, D.item_words([" ".join(item)])[0])])
        if index.plain:
            assert leaked([" ".join(item)], [" ".join(text)]) == [{0} if brute_distance(item, text) <= D.bound(len(item)) else set()]


def test_recall_of_long_items_at_the_bound():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    for n in (60, 100, 150, 200, 300):
        items = [rng.choices(vocab, k=n) for _ in range(40)]
        for kinds in ((1,), (0, 1, 2)):
            docs = []
            for t in items:
                w = list(t)
                for _ in range(D.bound(n)):
                    k, kind = rng.randrange(len(w)), rng.choice(kinds)
                    w[k : k + (kind != 2)] = [rng.choice(vocab)] * (kind != 1)
                docs.append(" ".join(rng.choices(vocab, k=50) + w + rng.choices(vocab, k=50)))
            got = leaked([" ".join(t) for t in items], docs)
            assert sum(k in x for k, x in enumerate(got)) >= 39


def test_distances_of_random_items():
    """Items of 1 to 2000 words, repeated words included, against the exact edit distance."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    for n in (1, 2, 4, 5, 6, 7, 9, 14, 31, 33, 64, 100, 300, 700, 2000):
        items = [rng.choices(vocab[: rng.choice((3, 40, 400))], k=n) for _ in range(6)]
        docs = []
        for t in items:
            w = list(t)
            for _ in range(rng.randint(0, D.bound(n) + 1)):
                k, kind = rng.randrange(len(w) or 1), rng.randrange(3)
                w[k : k + (kind != 2)] = [rng.choice(vocab)] * (kind != 1)
            docs.append(" ".join(rng.choices(vocab, k=30) + w + rng.choices(vocab, k=30) + t[: n // 2]))
        index = D.Index(list(enumerate(D.item_words([" ".join(t) for t in items]))))
        got = {(int(c.rows[d]), i): (cost, at) for c in D.chunks(pa.array(docs), D.WORDS_FOLD) for d, i, cost, at in index.search(c)}
        exact = {(d, i): D.distance(index.words[i], D.item_words([t])[0])[0] for d, t in enumerate(docs) for i in range(len(items))}
        want = {k: v for k, v in exact.items() if v <= D.bound(n)}
        assert {k: v for k, (v, _) in got.items()} == want, n
        for (d, i), (cost, at) in got.items():
            assert D.distance(index.words[i], D.item_words([docs[d]])[0][at : at + n + cost])[0] == cost


def test_very_long_document(spark):
    item = [f"i{k}" for k in range(40)]
    long = " ".join(["filler words that repeat"] * 120_000 + item + ["more filler"] * 50_000)
    df = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["distance"], r["first_word"]) for r in D.query(df, items).collect()] == [(1, 0, 480_000)]


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(1, [1.0, 2.0], "a"), (2, [1.001, 2.0], "a"), (3, [1.0, 2.0], "a"), (4, [1.0, 2.0], "b"), (5, [1.0, 2.0, 0.0], "a"), (6, [1e-200, 2e-200], "a"), (7, [1e200, 2e200], "a"), (7, [1e200, 2e200], "a")]
    base = rng.normal(size=(300, 40))
    rows += [(100 + i, v.tolist(), "a") for i, v in enumerate(np.concatenate((base, base[:50] + rng.normal(scale=0.02, size=(50, 40)))))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.contract(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert {k: got[k] for k in range(1, 8)} == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (0, 4), 5: (0, 5), 6: (4, 1), 7: (4, 1)}
    assert all(got[400 + i] == (1, 100 + i) for i in range(50))


def test_recall_with_many_pivots():
    """Pairs at the threshold in tight clusters, by the number of pivots that so many vectors have."""
    rng = np.random.default_rng(3)
    centre = E._unit(rng.normal(size=(20, 64)))
    x = E._unit(np.sqrt(0.96) * centre[rng.integers(20, size=10_000)] + 0.2 * E._unit(rng.normal(size=(10_000, 64))))
    q = x[8000:]
    u = rng.normal(size=q.shape)
    u = E._unit(u - (u * q).sum(1, keepdims=True) * q)
    y = 0.9805 * q + np.sqrt(1 - 0.9805**2) * u
    for n in (4_000, 50_000, 10_000_000):
        p = E.choose_pivots(x[: E.SAMPLE], E.n_pivots(n))
        a, b = (np.argsort(-(v @ p.T), axis=1)[:, : E.NEAREST] for v in (q, y))
        assert ((a[:, :, None] == b[:, None, :]).sum((1, 2)) >= E.SHARED).mean() >= 0.95


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
