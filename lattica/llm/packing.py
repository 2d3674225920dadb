"""Best-fit packing of token pieces into sequences, after dominance reduction.

The lengths are whole numbers up to the capacity, so the packing problem is
fully described by how many pieces have each length: at most 4096 numbers,
whatever the size of the corpus. ``plan`` solves it on that histogram:

1. Dominance reduction: a set that holds a piece and dominates every other
   feasible set with that piece is fixed for good. Here these are a piece that
   nothing fits beside; a pair that fills the sequence, or whose second member is
   the largest that fits where at most one fits, or where at most two fit and
   none of these pairs is longer. As the remaining pieces only get fewer, a
   fixed set can be repeated as often as its lengths last.
2. Best-fit decreasing on the rest, whole classes of equal sequences at a time.

Each step uses up a length or a class of sequences, so the plan has a bounded
number of patterns. A piece finds its place by its rank among the pieces of its
length; ranks come from counts by (partition, length), so no length is ever
gathered in one task.
"""

from __future__ import annotations

import bisect
import codecs
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Chunk, as_bytes, cut, small_batches, tidy

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words kept with their ids by each worker: about 40 bytes each.
MAX_WORDS = 600_000
WORD_END = "</w>"
#: The tokenizer's own parts of a word; it lowers case, so that A-Z can be lowered before.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+", re.I)
#: The letters that stand for the bytes 127 to 160 and 173 in byte-level tokenizers.
_BYTE_LETTERS = {b: 289 + k for k, b in enumerate([*range(127, 161), 173])}
_AS_LETTERS = "".join(chr(_BYTE_LETTERS.get(b, b)) for b in range(256))
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: ASCII characters other than letters, digits and white space, and those letters and digits.
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[33:127] = True
_PLAIN[[*range(48, 58), *range(97, 123)]] = True
_MARK[[*range(65, 91), *range(97, 123), *range(48, 58)]] = False
GROUP_BYTES = 1 << 19

Pattern = tuple[int, list[tuple[int, int]]]  # how many sequences; lengths with their counts in each


class WordTokenizer:
    """Ids of whole texts, from the ids of their words between ASCII white space.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its words' ids in order. Words are found in one numpy pass over the bytes and
    known by 64-bit hashes; those not met before are encoded and kept, until there are too many.
    Texts that may hold a special token's string keep their case, which it depends on.
    """

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        del vocab
        # the model is used without its normalizer for words that are prepared here
        self._ways = {True: (None, pre_tokenizers.WhitespaceSplit()), False: (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)}
        probe = ["plain", "été", "größe", "niño", "øre", "ćwiek"]
        if self._bare(probe).tolist() != self.tokenizer.encode(" ".join(probe), add_special_tokens=False).ids:
            raise ValueError(f"{name} is not a tokenizer of lower-cased words")
        self._clear()

    def _clear(self) -> None:
        self.keys: np.ndarray = np.zeros(0, np.uint64)  # hashes of known words, sorted
        self.row: np.ndarray = np.zeros(0, np.int64)  # of each, its place in starts and lens
        self.starts: np.ndarray = np.zeros(0, np.int64)
        self.lens: np.ndarray = np.zeros(0, np.int64)
        self.ids: np.ndarray = np.zeros(0, np.uint32)

    def _bare(self, words: list[str]) -> np.ndarray:
        """Ids of words of letters up to U+02FF, where lower case and composition are a matter of single characters."""
        text = codecs.charmap_decode(" ".join(words).lower().encode(), "strict", _AS_LETTERS)[0]
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self._ways[True]
        try:
            return self._many([text])
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self._ways[False]

    def _many(self, words: list[str]) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters up to U+02FF are encoded many at a time as one text, whose ids are cut where words end.

        U+0130 is left out: in lower case it has a mark that splits the word.
        """
        texts = [w.decode() for w in words]
        simple = np.fromiter((w.isalpha() or t.isalpha() and max(t) < "\u0300" and "\u0130" not in t for w, t in zip(words, texts, strict=True)), bool, len(texts))
        # others in parts by the whole tokenizer, ASCII ones many at a time as well
        parts = np.fromiter((len(_PARTS.findall(t)) if not k and t.isascii() and t.isprintable() and "<|" not in t else 0 for k, t in zip(simple.tolist(), texts, strict=True)), np.int64, len(texts))
        plain, ascii_, odd = np.flatnonzero(simple), np.flatnonzero(parts), np.flatnonzero(~simple & (parts == 0))
        ids, more = self._bare([texts[i] for i in plain.tolist()]), self._many([texts[i] for i in ascii_.tolist()])
        ends, part_ends = np.flatnonzero(self.is_end[ids]) + 1, np.flatnonzero(self.is_end[more]) + 1
        if len(ends) != len(plain) or len(part_ends) != parts.sum():  # not as foreseen: word by word
            plain, ascii_, odd = plain[:0], ascii_[:0], np.arange(len(words))
            ids, more, ends, part_ends = ids[:0], more[:0], ends[:0], part_ends[:0]
        lens = np.zeros(len(words), np.int64)
        lens[plain] = np.diff(ends, prepend=0)
        lens[ascii_] = np.diff(part_ends[np.cumsum(parts[ascii_]) - 1] if len(ascii_) else part_ends, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in odd.tolist()], add_special_tokens=False)]
        lens[odd] = np.fromiter(map(len, found), np.int64, len(found))
        rest = np.concatenate((ascii_, odd))
        order = np.concatenate((plain, rest))  # in which the ids stand
        starts = np.empty(len(words), np.int64)
        starts[order] = len(self.ids) + np.cumsum(lens[order]) - lens[order]
        self.starts = np.concatenate((self.starts, starts))
        self.lens = np.concatenate((self.lens, lens))
        self.ids = np.concatenate((self.ids, ids.astype(np.uint32), more.astype(np.uint32), np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))))

    def _rows(self, c: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word in starts and lens, learning the words not met before."""
        h, first, back = np.unique(c.word_hashes(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, h)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == h if len(self.keys) else np.zeros(len(h), bool)
        if not known.all() and len(self.keys) + int((~known).sum()) > MAX_WORDS:
            self._clear()
            at, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = c.buf.tobytes()
            here = len(self.lens)
            self._learn([raw[i:j] for i, j in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.keys = np.insert(self.keys, at[new], h[new])
            self.row = np.insert(self.row, at[new], here + np.arange(len(new)))
            at = np.searchsorted(self.keys, h)
        return self.row[at][back]

    def _without_marks(self, c: Chunk, starts: np.ndarray, ends: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks at a word's end, after an ASCII letter or digit, as words of their own: so the tokenizer takes them, but in special tokens."""
        plain = np.where(_MARK[c.buf], 0, np.arange(len(c.buf)))
        cut = np.maximum.accumulate(plain)[ends - 1] + 1
        some = (cut < ends) & (cut > starts)
        some &= _PLAIN[c.buf[np.maximum(cut - 1, 0)]] & ~special[c.doc_of(starts)]
        return np.sort(np.concatenate((starts, cut[some]))), np.sort(np.concatenate((ends, cut[some])))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        c = Chunk(np.arange(len(texts)), [t if b"<|" in t else t.translate(_LOWER) for t in texts])
        starts, ends = c.runs(_WORD)
        if not len(starts):
            return [self.ids[:0]] * len(texts)
        starts, ends = self._without_marks(c, starts, ends, np.array([b"<|" in t for t in texts]))
        row = self._rows(c, starts, ends)
        lens = self.lens[row]
        stop = np.cumsum(lens)
        ids = self.ids[np.repeat(self.starts[row] - (stop - lens), lens) + np.arange(int(stop[-1]))]
        cuts = np.concatenate(([0], stop))[np.searchsorted(starts, np.concatenate((c.starts, c.ends[-1:])))].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _groups(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    held = 0
    for t in texts:
        t = t or b""
        if part and held + len(t) > GROUP_BYTES:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def pieces(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32, and the place among equals in its partition.

    A null or empty text has the end id alone. Repeated rows are packed as often as they occur.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(tokenizer)  # for this task alone: workers outlive it, and an executor may have many
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, at = batch.column(0), 0
            for group in _groups(as_bytes(batch.column(1))):
                row, piece, start, length, crc, place = [], [], [], [], [], []
                for ids in tok.encode(group):
                    full = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for k, s in enumerate(range(0, len(full), capacity)):
                        part = full[s : s + capacity]
                        row.append(at)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        place.append(int(seen[len(part)]))
                        seen[len(part)] += 1
                    at += 1
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([chunk] * len(row), pa.int32()), pa.array(place, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "place"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, place long")


def reduce_dominated(n: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix dominating sets, taking their pieces out of the histogram n (by length)."""
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(n)[::-1].tolist():
            while n[a]:
                rest = capacity - a
                n[a] -= 1  # the piece in hand is not its own partner
                there = np.flatnonzero(n[: rest + 1])
                n[a] += 1
                if not len(there):
                    fixed.append((int(n[a]), [(a, 1)]))
                    n[a] = 0
                    changed = True
                    break
                b = int(there[-1])
                if b != rest and _fits(n, a, there, rest, 2) and (_fits(n, a, there, rest, 3) or b < _best_pair(n, a, there, rest)):
                    break
                if a == b:
                    m = int(n[a]) // 2
                    fixed.append((m, [(a, 2)]))
                    n[a] -= 2 * m
                else:
                    m = int(min(n[a], n[b]))
                    fixed.append((m, [(a, 1), (b, 1)]))
                    n[a] -= m
                    n[b] -= m
                changed = True
    return fixed


def _fits(n: np.ndarray, a: int, there: np.ndarray, rest: int, k: int) -> bool:
    """Whether some k pieces fit together: whether the k shortest do."""
    left, held = k, 0
    for s in there[:k].tolist():
        take = min(left, int(n[s]) - (s == a))
        held += take * s
        left -= take
        if not left:
            break
    return not left and held <= rest


def _best_pair(n: np.ndarray, a: int, there: np.ndarray, rest: int) -> int:
    """The longest two pieces together that fit."""
    k = np.searchsorted(there, rest - there, side="right") - 1
    ok = k >= 0
    c, k = there[ok], k[ok]
    d = there[k]
    alone = (c == d) & (n[c] - (c == a) < 2)
    d = np.where(alone, np.where(k > 0, there[np.maximum(k - 1, 0)], -c - 1), d)
    return int(np.max(c + d, initial=0))


def best_fit(n: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing for a histogram; sequences that were filled alike stay one class."""
    rooms: list[int] = []  # sorted, those with classes
    classes: dict[int, list[tuple[int, tuple]]] = {}

    def put(room: int, m: int, held: tuple) -> None:
        if m:
            if room not in classes:
                classes[room] = []
                bisect.insort(rooms, room)
            classes[room].append((m, held))

    for s in np.flatnonzero(n)[::-1].tolist():
        left = int(n[s])
        while left:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                m, held = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(i)
            else:
                room, held = capacity, ()
                m = -(-left // (capacity // s))
            q = room // s
            full = min(m, left // q)
            put(room - q * s, full, (*held, (s, q)))
            left -= full * q
            if full < m and left:
                put(room - left * s, 1, (*held, (s, left)))
                full, left = full + 1, 0
            put(room, m - full, held)
    return [(m, list(held)) for v in classes.values() for m, held in v]


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    n = np.zeros(capacity + 1, np.int64)
    for k, v in lengths.items():
        n[k] = v
    return reduce_dominated(n, capacity) + best_fit(n, capacity)


def intervals(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length the ranks that a pattern takes, sorted by (length, first rank)."""
    rows, taken, sequence = [], {}, 0
    for m, held in patterns:
        offset = 0
        for s, q in held:
            lo = taken.get(s, 0)
            rows.append((s, lo, sequence, q, offset))
            taken[s] = lo + m * q
            offset += s * q
        sequence += m
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "lo": a[:, 1], "sequence": a[:, 2], "each": a[:, 3], "offset": a[:, 4]}


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each piece with its sequence_id and its offset there.

    Texts of any length are encoded as a whole; null and empty ones have the end id alone.
    Repeated rows and rows without an id are packed as often as they occur; equal lengths
    are packed in any order. Other columns are not read. An empty table has no pieces.
    """
    p = cut(pieces(df, text, key, capacity, tokenizer))
    by_chunk = p.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    base = by_chunk.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    shared = df.sparkSession.sparkContext.broadcast(intervals(plan(lengths, capacity)))

    @arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        x = shared.value
        s, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(x["key"], (s << 44) + r, side="right") - 1
        copy, slot = np.divmod(r - x["lo"][at], x["each"][at])
        return pa.StructArray.from_arrays([pa.array(x["sequence"][at] + copy), pa.array(x["offset"][at] + slot * s)], names=["sequence_id", "offset"])

    return p.join(base, ["chunk", "length"]).withColumn("at", place("length", F.col("base") + F.col("place"))).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def contract(docs: DataFrame) -> DataFrame:
    return pack(docs)
