"""Language, toxicity and quality: exact figures on small models, held-out accuracy, odd inputs."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import langid, quality, toxicity
from lattica.llm.common import Chunk, hash_text, table

SF = "/root/testdata/sf0.01"


def accuracy(rows):
    return sum(a == b for a, b in rows) / len(rows)


def brute_bits(train: bytes, text: bytes, order: int, least: int) -> float:
    """PPM method C without exclusions, straight from its definition, for one language."""
    train, n = b"\n" * order + train, {}
    for i in range(order, len(train)):
        for k in range(order + 1):
            c = n.setdefault(train[i - k : i], {})
            c[train[i]] = c.get(train[i], 0) + 1
    size = len(set(train)) + 1
    padded, bits = b"\n" * order + text, 0.0
    for i in range(order, len(padded)):
        s = padded[i]
        for k in range(order, -1, -1):
            c = n.get(padded[i - k : i], {})
            total = sum(c.values())
            if not c or k and total < least:
                continue
            if s in c:
                bits += np.log2((total + len(c)) / c[s])
                break
            bits += np.log2((total + len(c)) / len(c))
        else:
            bits += np.log2(size)
    return bits


def test_code_lengths():
    a, b = b"the cat sat on the mat and that was that\n" * 6, b"le chat est sur le tapis et voila\n" * 5
    m = langid.Model.train({"en": [a], "fr": [b]})
    m1 = langid.Model.train({"en": [a]})
    m1 = langid.Model.from_bytes(m1.to_bytes())
    texts = ["the cat", "that tapis zz", "", "q", "le chat et the mat " * 20000]
    got = {i: x for rows, _, bits in m1.score(pa.array(texts)) for i, x in zip(rows.tolist(), bits[:, 0].tolist(), strict=True)}
    for i, t in enumerate(texts[:4]):
        assert got[i] == pytest.approx(brute_bits(a + b"\n", t.encode(), langid.ORDER, langid.MIN_CONTEXT), rel=1e-4, abs=1e-3)
    assert got[4] > 1000
    both = {i: x for rows, _, bits in m.score(pa.array(texts)) for i, x in zip(rows.tolist(), bits.tolist(), strict=True)}
    assert both[0][0] < both[0][1]


def test_language_query(spark):
    d = table(spark, SF, "documents")
    r = langid.contract(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").select("lang_pred", "lang").collect()
    assert accuracy([tuple(x) for x in r]) > 0.97


def test_language_odd_inputs(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en", "x"), (1, "the cat and the dog", "en", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, "123 !?", "fr", "x"), (6, "le chat et le chien", "fr", None), (None, "the the", "en", "x")], "doc_id long, text string, lang string, language string")
    got = {r["doc_id"]: r for r in langid.contract(df).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[3]["score"] == 0 and langid.contract(df).count() == 7
    assert langid.contract(df.limit(0)).count() == 0
    assert langid.predict(df, langid.Model.train({}), into="p").select("p.lang", "language").first()[0] == "und"


def test_pu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    text = lambda bad: np.unique(np.concatenate((rng.integers(1000, 60000, 80), rng.integers(0, 5, 2) if bad else [])).astype(np.int64))
    p, u = [text(True) for _ in range(200)], [text(k % 10 == 0) for k in range(2000)]
    m = toxicity.train(p, u, 0.1)
    g = lambda f: m.bias + m.weight[f].sum()
    assert np.mean([g(text(True)) > 0 for _ in range(300)]) > 0.95 and np.mean([g(text(False)) > 0 for _ in range(300)]) < 0.02
    assert toxicity.train([], u, 0.1).bias < 0 and toxicity.train(p, u, 0.0).bias < 0


def test_toxicity_query(spark):
    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    r = toxicity.contract(d, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert np.mean([x[0] for x in r if x[1] == 1]) > 0.75 and np.mean([x[0] for x in r if x[1] == 0]) < 0.02


def test_toxicity_odd_inputs(spark):
    df = spark.createDataFrame([(1, "you idiot", "s"), (2, None, "s"), (3, "", "s"), (3, "", None), (None, "x", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        r = toxicity.contract(df, lab).collect()
        assert len(r) == 5 and all(0 <= x["score"] <= 1 for x in r)
        assert toxicity.contract(df.limit(0), lab).count() == 0


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    m = quality.Model(rng.normal(size=3), rng.normal(size=(2, 2)))
    x, first = rng.normal(size=(11, 3)), np.array([0, 4, 5])
    p = m.marginals(x, first)
    for lo, hi in ((0, 4), (4, 5), (5, 11)):
        total, ones = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=hi - lo):
            w = np.exp(sum(x[lo + t] @ m.weight for t in range(hi - lo) if y[t]) + sum(m.turn[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            ones += w * np.array(y)
        assert np.allclose(p[lo:hi], ones / total)


def test_quality_query(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    r = quality.contract(d, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert accuracy([tuple(x) for x in r]) > 0.93


def test_quality_odd_inputs(spark):
    df = spark.createDataFrame([(1, "A fine line.\nAnother one.", "s"), (2, None, "s"), (3, "", "s"), (3, "\n\n\n", None), (4, "x" * 200_000, "s"), (None, "y\n" * 30_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        r = quality.contract(df, lab).collect()
        assert len(r) == 6 and all(0 <= x["score"] <= 1 for x in r)
        assert quality.contract(df.limit(0), lab).count() == 0
    assert quality.score(df, quality.Model(np.zeros(3 * quality.WIDTH), np.zeros((2, 2)))).select("score", F.col("quality_score")).count() == 6


def test_line_features_stay_in_documents():
    x, lens, first = quality.line_features(Chunk(np.arange(3), [b"a b\nc", b"", b"c\nc"]))
    assert first.tolist() == [0, 2, 3] and lens.tolist() == [4, 2, 1, 2, 2] and x[4, 12] == 1 and x[3, 12] == 0


def test_whole_texts_train(spark):
    """The last words of long texts are learned as the first ones are."""
    late = " ".join(["der hund und die katze laufen"] * 9000 + ["zebra yacht xylophon"] * 400)
    docs = spark.createDataFrame([(1, "the cat sat on the mat and ran " * 50, "en"), (2, late, "de"), (None, "le chat", "fr"), (3, "x", None), (4, "", "it")], "doc_id long, text string, lang string")
    m = langid.fit(docs)
    assert m.langs == ["de", "en"]  # a row without an id is not learned from
    got = langid.predict(spark.createDataFrame([(1, "zebra yacht xylophon"), (2, "the cat")], "id long, text string"), m).select("language.lang").collect()
    assert [r[0] for r in got] == ["de", "en"]


def test_training_documents_of_a_language(spark, monkeypatch):
    """The first ones by hash, as many as there may be, of each language."""
    monkeypatch.setattr(langid, "TRAIN_DOCS", 20)
    rows = [(i, f"{'abc'[i % 3]}{i} ", "abc"[i % 3]) for i in range(900)] + [(1000, "d1000 ", "d")]
    seen = {}
    monkeypatch.setattr(langid.Model, "of_counts", staticmethod(lambda c: seen.update(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(df)
    order = df.select("doc_id", "lang", "text", F.abs(F.xxhash64(F.lit("langid"), "doc_id") % langid.RANGE).alias("o")).collect()
    for k in "abcd":
        texts = [r["text"] for r in sorted((r for r in order if r["lang"] == k), key=lambda r: (r["o"], r["doc_id"]))[:20]]
        g, n = langid.count_grams([t.encode() for t in texts])
        mine = dict(zip(*(x.tolist() for x in seen[k]), strict=True))
        assert mine == dict(zip(g.tolist(), n.tolist(), strict=True))


def test_training_lines_are_drawn_from_all_of_a_text():
    n = 5000
    c = Chunk(np.arange(2), ["\n".join(f"line {i}" for i in range(n)).encode(), b"a\nb"])
    long, short = quality.training_lines(c)
    x = quality.line_features(c)[0]
    assert len(long.x) == quality.RUNS * quality.RUN_LINES and len(short.x) == 2 and short.first.tolist() == [0]
    places = [next(i for i in range(0, n, quality.RUN_LINES) if np.array_equal(x[i : i + quality.RUN_LINES], long.x[f : f + quality.RUN_LINES])) for f in long.first]
    assert len(places) == quality.RUNS and max(places) > quality.RUNS * quality.RUN_LINES


def test_gradient_of_the_field():
    rng = np.random.default_rng(4)
    x, first, y = rng.normal(size=(9, 3)), np.array([0, 4, 5]), rng.integers(0, 2, 9)
    weight = np.repeat([1.0, 2.5, 0.5], [4, 1, 4])

    def loss(w):
        out = 0.0
        for (lo, hi), k in zip(((0, 4), (4, 5), (5, 9)), (1.0, 2.5, 0.5), strict=True):
            say = lambda s: sum(x[lo + t] @ w[:3] for t in range(hi - lo) if s[t]) + sum(w[3 + 2 * a + b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023,E731
            out -= k * (say(y[lo:hi].tolist()) - np.log(sum(np.exp(say(s)) for s in itertools.product((0, 1), repeat=hi - lo))))
        return out

    w = rng.normal(size=7)
    got = quality.gradient(quality.Model(w[:3], w[3:].reshape(2, 2)), x, first, y, weight)
    want = [(loss(w + 1e-5 * e) - loss(w - 1e-5 * e)) / 2e-5 for e in np.eye(7)]
    assert np.allclose(got, want, atol=1e-6)


def test_risk_and_its_gradient():
    rng = np.random.default_rng(6)
    is_p = np.arange(40) < 15
    signs = set()
    for scale, prior in ((0.5, 0.1), (2.0, 0.4), (5.0, 0.9)):
        for _ in range(20):
            g = rng.normal(size=40) * scale
            log_loss = lambda z: np.log1p(np.exp(-z))
            negative = log_loss(-g[~is_p]).mean() - prior * log_loss(-g[is_p]).mean()
            signs.add(negative > 0)
            assert np.isclose(toxicity.risk(g, is_p, prior)[0], prior * log_loss(g[is_p]).mean() + max(0, negative))
            if abs(negative) > 1e-3:
                want = [(toxicity.risk(g + 1e-5 * e, is_p, prior)[0] - toxicity.risk(g - 1e-5 * e, is_p, prior)[0]) / 2e-5 for e in np.eye(40)]
                assert np.allclose(toxicity.risk(g, is_p, prior)[1], want, atol=1e-6)
    assert signs == {True, False}


def test_scores_against_brute_force(spark):
    """A score is the logistic curve of the bias and the weights of the distinct words of the whole text."""
    rng = np.random.default_rng(7)
    m = toxicity.Model(rng.normal(size=1 << toxicity.BITS), -0.3)
    texts = ["You IDIOT you", "", None, "été 12 x", "a b c " * 60_000 + "last"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, m).collect():
        words = set(re.findall(r"[a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in r["text"] or "")))
        g = -0.3 + sum(m.weight[i] for i in {hash_text(w) >> 64 - toxicity.BITS for w in words})
        assert r["toxicity"] == pytest.approx(1 / (1 + np.exp(-g)))
