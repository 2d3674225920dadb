"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

An item is a sequence of words; a document leaks it where some run of its words
is within ``floor(EDIT_SHARE * length)`` word edits of the item.

The CGK embedding walks over a sequence for three times its length; at each step
it puts out the current word and then moves on or stays, as a random bit for
(step, word) says. Sequences at a small edit distance walk in step again after
each edit, so the embedded sequences have a small Hamming distance. A key is the
words at ``SAMPLED`` random places of the embedding; ``REPEATS`` walks and keys give
each pair within the bound a chance of at least the target recall to share one
(``tests/llm`` measure it). Windows have the length of an item; a window that
shares a key with an item is verified by the edit distance of the item to the
best run of words around it.

Before walks, a window must pass a counting test that no leak can fail: k edits
destroy at most 2k of the item's pairs of neighbouring words, so the others must
be there. Pairs of equal words are left out on both sides, since a text that
repeats one word would have any number of them. An item of which the test would
ask for no pair is not indexed, but compared by edit distance wherever a document
has enough of its words close together. Items too short for a walk, of fewer than
``WALK_WORDS`` words, have the bound 0 and are found by the hash of all their words.

The walks of long sequences drift apart, so an item is indexed by parts of at most
``PART`` words: k edits leave one of them within its own bound. A part's hit is
verified with the whole item.

Items are matched in blocks of about ``BLOCK_WORDS`` words, one pass over the documents
each. A worker holds the index of one block; between passes the rows are written to
the shared folder, so memory does not grow with the number of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Chunk, chunks, cut, mix, small_batches, tidy
from .license_scan import WORDS

EDIT_SHARE = 0.15
WALK_WORDS = 5
PART = 32
REPEATS = 32
SAMPLED = 4
BLOCK_WORDS = 250_000
#: Windows that are embedded at a time; one step of a walk takes REPEATS * 8 bytes for each.
WINDOWS = 500
FILTER_BITS = 20
INSIDE = WORDS != 32
PAD = np.uint64(0)
SCHEMA = "array<struct<item_id:long,distance:long,n_words:long,first_word:long>>"


def bound(n_words: int) -> int:
    return math.floor(EDIT_SHARE * n_words)


def pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xD6E8FEB86659FD93))


def embed(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """CGK embeddings: words [n, longest] padded with PAD, bits [repeats, steps] -> [steps, repeats, n]."""
    n, longest = words.shape
    padded = np.concatenate((words, np.zeros((n, 1), np.uint64)), axis=1).ravel()
    row = np.arange(n) * (longest + 1)
    at = np.zeros((bits.shape[0], n), np.int64)
    out = np.empty((bits.shape[1], bits.shape[0], n), np.uint64)
    for j in range(bits.shape[1]):
        w = padded[row + at]
        out[j] = w
        at += ((w * bits[:, j, None]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, longest, out=at)
    return out


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to a run of text words, and where that run ends (Myers' bit vectors)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        peq[w] = peq.get(w, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = ones, 0, m
    best, end = m, 0
    for j, w in enumerate(text.tolist()):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & ones  # the first row stays 0: a run may begin anywhere
        pv = (mh << 1 & ones) | ~(xv | ph) & ones
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def locate(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance and where the best run begins."""
    best, end = distance(item, text)
    _, back = distance(item[::-1], text[:end][::-1])
    return best, end - back


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def cuts(n_words: int) -> list[int]:
    """Where the parts of an item begin, and its end: as few parts of at most PART words as there can be, of near equal length."""
    parts = -(-n_words // PART)
    return [n_words * j // parts for j in range(parts + 1)]


def lasting(part: np.ndarray) -> int:
    """Pairs of neighbouring unequal words that stay after as many edits as may be, at least."""
    return int((part[1:] != part[:-1]).sum()) - 2 * bound(len(part))


class Index:
    """Parts of items by the keys of their embeddings."""

    def __init__(self, items: list[tuple[int, np.ndarray]], seed: int = 7):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.plain: list[int] = []  # items that the counting test would say nothing of
        short: dict[int, list[int]] = {}
        parts: list[np.ndarray] = []
        of_item, offset = [], []
        for i, w in enumerate(self.words):
            if len(w) < WALK_WORDS:
                short.setdefault(len(w), []).append(i)
                continue
            c = cuts(len(w))
            here = [w[a:z] for a, z in zip(c[:-1], c[1:], strict=True)]
            if min(map(lasting, here)) < 1:
                self.plain.append(i)
                continue
            parts += here
            of_item += [i] * len(here)
            offset += c[:-1]
        # by number of words: hashes of whole short items, sorted, and their items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, which in short.items():
            code = np.array([runs_of(self.words[i], n)[0] for i in which])
            o = np.argsort(code, kind="stable")
            self.short[n] = code[o], np.array(which)[o]
        self.of_item, self.offset = np.array(of_item, np.int64), np.array(offset, np.int64)
        self.plain_words = np.unique(np.concatenate([self.words[i] for i in self.plain])) if self.plain else np.zeros(0, np.uint64)
        self.lengths = sorted({len(w) for w in parts})
        if not parts:
            return
        longest = self.lengths[-1]
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(1, 1 << 63, (REPEATS, 3 * longest), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = {n: np.stack([rng.choice(3 * n, min(SAMPLED, 3 * n), replace=False) for _ in range(REPEATS)]) for n in self.lengths}
        grid = np.zeros((len(parts), longest), np.uint64)
        for k, w in enumerate(parts):
            grid[k, : len(w)] = w
        n_words = np.array([len(w) for w in parts])
        some = [(lo, *self.keys(grid[lo : lo + WINDOWS], n_words[lo : lo + WINDOWS])) for lo in range(0, len(parts), WINDOWS)]
        keys, of = np.concatenate([k for _, k, _ in some]), np.concatenate([lo + i for lo, _, i in some])
        o = np.argsort(keys, kind="stable")
        self.sorted, self.part = keys[o], of[o]
        # for each pair of words the lengths of the parts that have it, as bits
        self.filter = np.zeros(1 << FILTER_BITS, np.uint64)
        self.need = dict.fromkeys(self.lengths, longest)  # pairs that stay after as many edits as may be
        for w in parts:
            p = pairs(w)[w[1:] != w[:-1]]
            self.need[len(w)] = min(self.need[len(w)], lasting(w))
            self.filter[(p >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] |= np.uint64(1 << len(w) % 64)

    def keys(self, grid: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of sequences, and the sequence each belongs to."""
        out = embed(grid, self.bits[:, : 3 * grid.shape[1]])
        keys, of = [], []
        for n in np.unique(n_words).tolist():
            rows = np.flatnonzero(n_words == n)
            for r in range(REPEATS):
                k = np.full(len(rows), n * REPEATS + r, np.uint64)
                some = np.zeros(len(rows), np.int8)  # where all places but one lie after the end, too many sequences would share the key
                for p in self.places[n][r]:
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) ^ out[p, r, rows])
                    some += out[p, r, rows] != PAD
                keys.append(k[some > 1])
                of.append(rows[some > 1])
        return np.concatenate(keys), np.concatenate(of)

    def windows(self, h: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the windows that pass the counting test; room: words from each to its document's end."""
        starts, lens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(h) > 1 and self.lengths:
            mask = self.filter[(pairs(h) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            some = np.flatnonzero((mask != 0) & (room[:-1] > 1) & (h[1:] != h[:-1]))
            mask = mask[some]
            for n in self.lengths:
                at = some[(mask >> np.uint64(n % 64)) & np.uint64(1) != 0]
                need, reach = self.need[n], n + bound(n) - 1
                if len(at) < need:
                    continue
                first, last = at[: len(at) - need + 1], at[need - 1 :]  # of each run of `need` known pairs
                ok = last - first < reach
                lo, hi = np.maximum(last[ok] - reach + 1, 0), first[ok]
                size = hi - lo + 1
                s = np.unique(np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
                s = s[room[s] >= n - bound(n)]
                starts.append(s)
                lens.append(np.full(len(s), n))
        return np.concatenate(starts), np.concatenate(lens)

    def without_index(self, h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, distance, word) for the items of few unequal pairs, by edit distance wherever enough words are the item's."""
        known = np.flatnonzero(np.isin(h, self.plain_words)) if self.plain else np.zeros(0, np.int64)
        for i in self.plain:
            w = self.words[i]
            n, k = len(w), bound(len(w))
            at = known[np.isin(h[known], w)]
            # a leak holds n - k of the item's words among n + k words of one document
            a, z = at[: max(0, len(at) - (n - k) + 1)], at[n - k - 1 :]
            ok = (z - a < n + k) & (doc[a] == doc[z])
            a, z = a[ok], z[ok]
            if not len(a):
                continue
            lo, hi = np.maximum(z - (n + k) + 1, first[doc[a]]), np.minimum(a + n + k, first[doc[a] + 1])
            new = np.flatnonzero(np.r_[True, (lo[1:] > hi[:-1]) | (doc[a[1:]] != doc[a[:-1]])])
            for left, right in zip(lo[new].tolist(), hi[np.r_[new[1:] - 1, len(hi) - 1]].tolist(), strict=True):
                cost, begin = locate(w, h[left:right])
                if cost <= k:
                    yield int(doc[left]), i, cost, left + begin

    def whole(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, 0, word) for the short items: the first place that each stands at in a document."""
        for n, (code, which) in self.short.items():
            run = runs_of(h, n)
            a, z = np.searchsorted(code, run, "left"), np.searchsorted(code, run, "right")
            at = np.flatnonzero(z > a)
            at = at[doc[at] == doc[at + n - 1]]
            reps = (z - a)[at]
            item = which[np.repeat(a[at] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))]
            at = np.repeat(at, reps)
            _, first = np.unique(doc[at] * len(self.words) + item, return_index=True)
            yield from ((d, i, 0, w) for d, i, w in zip(doc[at[first]].tolist(), item[first].tolist(), at[first].tolist(), strict=True))

    def search(self, c: Chunk) -> list[tuple[int, int, int, int]]:
        """(document, item, distance, first word) for each document and item that it leaks, at the best place."""
        ws, we = c.runs(INSIDE)
        if not len(ws):
            return []
        doc = c.doc_of(ws)
        first = np.searchsorted(doc, np.arange(len(c.rows) + 1))
        h = c.word_hashes(ws, we)
        stop = first[doc + 1]
        s, n = self.windows(h, stop - np.arange(len(h)))
        hits = [np.zeros((0, 3), np.int64)]
        for lo in range(0, len(s), WINDOWS):
            s_, n_ = s[lo : lo + WINDOWS], n[lo : lo + WINDOWS]
            at = s_[:, None] + np.arange(int(n_.max()))
            ok = np.arange(at.shape[1]) < np.minimum(n_, stop[s_] - s_)[:, None]
            grid = np.where(ok, h[np.minimum(at, len(h) - 1)], PAD)
            keys, of = self.keys(grid, n_)
            a, z = np.searchsorted(self.sorted, keys, "left"), np.searchsorted(self.sorted, keys, "right")
            hit = np.flatnonzero(z > a)
            reps = (z - a)[hit]
            flat = np.repeat(a[hit] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
            part = self.part[flat]
            both = np.unique(np.stack((s_[np.repeat(of[hit], reps)], part), axis=1), axis=0)
            # where the item would begin; its document is that of the part
            item = self.of_item[both[:, 1]]
            hits.append(np.stack((doc[both[:, 0]], item, both[:, 0] - self.offset[both[:, 1]]), axis=1))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        d, item, start = np.unique(np.concatenate(hits), axis=0).T
        n = np.array([len(w) for w in self.words])[item]
        k = np.array([bound(len(w)) for w in self.words])[item]
        lo, hi = np.maximum(start - k, first[d]), np.minimum(start + n + k, first[d + 1])
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])][: len(d)])
        last = np.r_[new[1:] - 1, len(d) - 1][: len(new)]
        for d_, i, left, right in zip(d[new].tolist(), item[new].tolist(), lo[new].tolist(), hi[last].tolist(), strict=True):
            w = self.words[i]
            cost, begin = locate(w, h[left:right])
            if cost <= bound(len(w)) and ((d_, i) not in found or cost < found[d_, i][0]):
                found[d_, i] = cost, left + begin
        for d, i, cost, begin in (*self.without_index(h, doc, first), *self.whole(h, doc)):
            if (d, i) not in found or cost < found[d, i][0]:
                found[d, i] = cost, begin
        return [(d, i, cost, begin - int(first[d])) for (d, i), (cost, begin) in sorted(found.items())]


def item_words(texts: list[str]) -> list[np.ndarray]:
    c = Chunk(np.arange(len(texts)), [t.encode() for t in texts], WORDS_FOLD)
    s, e = c.runs(INSIDE)
    h, d = c.word_hashes(s, e), c.doc_of(s)
    cuts = np.searchsorted(d, np.arange(len(texts) + 1))
    return [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


#: Words are compared with A-Z lowered; other characters split words and may be anything.
WORDS_FOLD = np.where(WORDS == 32, 32, WORDS).astype(np.uint8)


def _matcher(shared):
    """shared: a broadcast list of (item id, text)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = shared.value
        index = Index([(i, w) for (i, _), w in zip(items, item_words([t for _, t in items]), strict=True) if len(w)])
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("n_words", pa.int64()), ("first_word", pa.int64())]))
        for arr in batches:
            out: list = [[] for _ in range(len(arr))]
            if index.ids:
                for c in chunks(arr, WORDS_FOLD):
                    for d, item, cost, begin in index.search(c):
                        out[int(c.rows[d])].append({"item_id": index.ids[item], "distance": cost, "n_words": len(index.words[item]), "first_word": begin})
            yield pa.array(out, kind)

    return arrow_udf(tidy(run), SCHEMA)


def leaks(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "leaks") -> DataFrame:
    """Add the array column ``into``: the items a document leaks, each at its best place, by item_id.

    Of places at the same distance the first counts whose run ends first. Items
    without id, text or words leak nothing; those of up to six words leak where they
    stand unchanged. A null or empty document leaks nothing, and nothing leaks from an
    empty table of items. Repeated items are matched once for each distinct text.
    Documents are kept as they are, repeated ones included, at any length; other columns
    pass through, one of the name ``into`` is replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).dropna().distinct()
    words = known.agg(F.sum(F.length("t") / 6 + 1)).first()[0] or 0  # a word has about five letters and a space
    blocks = max(1, -(-int(words) // BLOCK_WORDS))
    found: Column | None = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else known
        rows = sorted((r["i"], r["t"]) for r in part.collect())  # about BLOCK_WORDS words
        here = _matcher(spark.sparkContext.broadcast(rows))(F.col(text))
        if blocks == 1:
            return df.withColumn(into, F.array_sort(here))
        df = cut(df.withColumn("__leaks", here if found is None else F.concat("__leaks", here)))
        found = F.col("__leaks")
    return df.withColumn(into, F.array_sort("__leaks")).drop("__leaks")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    r = leaks(docs.select("doc_id", "text"), items, into="r").select("doc_id", F.explode("r").alias("r"))
    return r.select("doc_id", "r.*", (1 - F.col("r.distance") / F.col("r.n_words")).alias("score"))
