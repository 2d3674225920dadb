"""Licence scans, token counts and packing: brute force and round trips."""

import random
import re
import zlib

import numpy as np
import pytest

from lattica.llm import license_scan as L
from lattica.llm import packing as P
from lattica.llm import token_counts as T
from lattica.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    at = [(i, label) for p, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_against_brute_force(spark):
    texts = ["CC BY cc-by cc  by, CC\nBY", "the General Public\tLicense. general public license", "All rights reserved" * 3, "acc by cc bya ccby", "é cc by É", "", None, "cc by cc by cc by", "İ CC BY", "x" * 100_000 + " cc by"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string").union(table(spark, SF, "documents").selectExpr("doc_id + 1000", "text", "lang"))
    got = {r["doc_id"]: tuple(r)[1:6] for r in L.contract(df).collect()}
    for r in df.collect():
        assert got[r["doc_id"]] == base(r["text"] or "")
    assert L.contract(df.limit(0)).count() == 0


def test_expressions():
    assert L.postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert L.postfix("(MIT OR Apache-2.0) AND BSD-3-Clause") == ["mit", "apache-2.0", "or", "bsd-3-clause", "and"]
    assert L.evaluate("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT") == (["gpl-2.0-only-with-classpath-exception-2.0", "mit"], True)
    assert L.evaluate("GPL-2.0 AND MIT") == (["gpl-2.0", "mit"], False)
    for bad in ("", "AND", "MIT OR", "(MIT", "MIT)", "MIT MIT", "()", "(MIT OR BSD) WITH x"):
        assert L.evaluate(bad) is None
    assert L.longest_expression(" (MIT OR ISC), which more words follow") == (["isc", "mit"], True)
    a = L._automaton()
    r = L.scan_text(b"# SPDX-License-Identifier: GPL-3.0-or-later AND MIT */\nAll rights reserved. SPDX-License-Identifier:", a)
    assert r["labels"] == "gpl-3.0-or-later,mit,reserved" and r["base_labels"] == "reserved" and r["permissive"] is False and 0 < r["score"] <= 1


def test_token_counts(spark):
    text = "One line here.\n\nAnother, with é and 日本語.\n  indented\n"
    df = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (2, "", "s"), (3, "\n\n\n", None), (4, "word " * 40_000, "s")], "doc_id long, text string, section string")
    encoding, lens = T.load()
    rows = T.query(df).collect()
    for i, t in ((1, text), (3, "\n\n\n"), (4, "word " * 40_000)):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in mine) == len(encoding.encode_ordinary(t))
        assert "".join(t[r["char_start"] : r["char_end"]] for r in mine) == t
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 2] == [0, 0] and T.query(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        T.count_by_line(df, rule="none")


def test_attribution_rules():
    ends, cuts = np.array([3, 8, 10, 17, 18]), np.array([0, 5, 9, 12, 14])
    spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    sections = list(zip(cuts.tolist(), [*cuts[1:].tolist(), 18], strict=True))
    overlap = lambda s, t: max(0, min(s[1], t[1]) - max(s[0], t[0]))
    share = [sum(overlap(s, t) / (t[1] - t[0]) for t in spans) for s in sections]
    first = [sum(s[0] <= t[0] < s[1] for t in spans) for s in sections]
    most = [0] * len(sections)
    for t in spans:
        most[max(range(len(sections)), key=lambda k: (overlap(sections[k], t), -k))] += 1
    for rule, want in (("share", share), ("first", first), ("majority", most)):
        assert np.allclose(T.attribute(ends, cuts, rule)[0], want)


def test_plans():
    rng = random.Random(5)
    for _ in range(300):
        cap = rng.choice([7, 50, 4096])
        n = {rng.randint(1, cap): rng.randint(1, 9) for _ in range(rng.randint(1, 50))}
        used: dict = {}
        plan = P.plan(n, cap)
        for m, held in plan:
            assert m > 0 and sum(s * q for s, q in held) <= cap
            for s, q in held:
                used[s] = used.get(s, 0) + m * q
        assert used == n
        bins: list = []
        for s in sorted((s for s, c in n.items() for _ in range(c)), reverse=True):  # plain best-fit decreasing
            fits = [i for i, r in enumerate(bins) if r >= s]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= s
            else:
                bins.append(cap - s)
        assert sum(m for m, _ in plan) <= len(bins)


def optimum(items, cap):
    best = len(items)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= items[k]:
                put(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, cap - items[k]])

    put(0, [])
    return best


def test_fixed_sets_keep_the_optimum():
    rng = random.Random(6)
    for _ in range(120):
        items = sorted((rng.randint(3, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        n = np.bincount(items, minlength=21)
        fixed = P.reduce_dominated(n, 20)
        rest = [s for s in range(20, 0, -1) for _ in range(n[s])]
        assert sum(m for m, _ in fixed) + optimum(rest, 20) == optimum(items, 20)


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    odd = ["Don't we'll I'VE 12ab x<|endoftext|>y <|ENDOFTEXT|> é é  z\x85q r $$$'s''t tab\tnew", None, "", "", "many words " * 5000, "İstanbul ΣΑΣ ﬁne ½x 日本語"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(odd)], "doc_id long, text string, length int").union(table(spark, SF, "documents").selectExpr("doc_id + 100", "text", "1"))
    r = P.contract(df).toPandas()
    for x in df.collect():
        ids = [*tok.encode(x["text"] or "", add_special_tokens=False).ids, 1]
        mine = r[r.doc_id == x["doc_id"]].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[:-1] == 4096).all()
        for p in mine.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for _, g in r.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1].tolist()] and g.length.sum() <= 4096
    assert r.sequence_id.nunique() <= 1.01 * r.length.sum() / 4096 + 1
    assert P.contract(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", T.RULES)
def test_sections_of_whole_documents(spark, rule):
    """Every token of a document, one by one, put to the lines that its bytes lie in."""
    texts = [r["text"] or "" for r in table(spark, SF, "documents").collect()][:60] + ["a\n\n\n  b\r\n\r\nc é\n日本", "\n" * 9 + "x", "  \n  \n"]
    encoding, _ = T.load()
    got = T.count_by_line(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), rule=rule).collect()
    for r in got:
        b = texts[r["id"]].encode()
        lines = b.splitlines(keepends=True) if b"\r" not in b else [x + b"\n" for x in b.split(b"\n")]
        if b"\r" in b:
            lines = [*lines[:-1], lines[-1][:-1]]
        lines = [x for x in lines if x] or [b""]
        line_of = [k for k, x in enumerate(lines) for _ in x]
        want, at = [0.0] * len(lines), 0
        for token in encoding.encode_ordinary(b.decode()):
            size = len(encoding.decode_single_token_bytes(token))
            own = line_of[at : at + size]
            at += size
            if rule == "first":
                want[own[0]] += 1
            elif rule == "majority":
                want[max(sorted(set(own)), key=lambda k: (own.count(k), -k))] += 1
            else:
                for k in own:
                    want[k] += 1 / size
        assert np.allclose([s["n_tokens"] for s in r["sections"]], want) and at == len(b)


def test_licence_odd_rows(spark):
    df = spark.createDataFrame([(1, "CC BY\nSPDX-License-Identifier: MIT", "x"), (1, "CC BY\nSPDX-License-Identifier: MIT", "x"), (None, None, None)], "doc_id long, text string, licence string")
    got = L.contract(df).collect()
    assert len(got) == 3 and got[0] == got[1] or got[0]["labels"] == "cc-by,mit"
    assert L.scan(df, into="found").select("licence", "found.labels").count() == 3 and L.scan(df).select("licence.labels").count() == 3


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (None, "x", 2), (2, "word " * 300_000, 3)], "doc_id long, text string, piece int")
    r = P.contract(df).toPandas()
    assert (r.doc_id == 1).sum() == 2 and r.doc_id.isna().sum() == 1 and r[r.doc_id == 2].length.sum() == 300_001
