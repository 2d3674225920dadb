"""N-gram Jaccard self-join of whole documents by a grouped prefix join.

A document is the set of its distinct word 4-shingles (64-bit hashes). Two sets
link when ``100 * intersection >= 85 * union``. The steps:

1. Documents with equal sets form one class, of which the smallest id goes on.
2. Sets are ordered by a global order, rare shingles first. Sets that link share a
   shingle within the first ``n - ceil(0.85 n) + 1`` of either, its prefix. How
   common a shingle is comes from all documents, counted in ``BUCKETS`` of hashes; any order
   gives the same links, the counts only make lists short.
3. Classes with equal prefixes and sizes are one group, which is posted once. Prefix
   shingles with one and the same list of groups are one list. Shingles whose bucket a share
   of ``HOT_SHARE`` of the documents has are counted by an aggregate that combines on the
   map side, the others in a window.
4. In a list, group pairs are filtered by size, then expanded to members. Each set has a
   parity sketch (a bit for each hash bucket, set if the bucket holds an odd number of
   shingles); two sketches never differ in more bits than the sets in shingles,
   so a pair whose sketches differ in too many cannot link.
5. Only components are asked for, so the pairs are verified in two rounds: first each
   document's likeliest partner in each list (in a long list, within each of two random
   blocks), then every remaining pair whose documents the links so far do not connect, in
   the first list that both are in. In the second round documents of a list's largest
   component meet the others of the list alone. Verification intersects the whole sets.

Long lists are split into blocks, so no list is ever gathered in one task.
Sets are compared by shingle hashes; a false link would need colliding 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Chunk, chunks, cut, fold_ascii, mix, release, small_batches, tidy
from .components import apart, components, each_group, hot_join

SHINGLE = 4
PERCENT = 85
#: Shingles are counted by the first bits of their hashes; a count is never too small.
BUCKET_BITS = 22
BUCKETS = 1 << BUCKET_BITS
COUNTS_BLOCK = 1 << 16
HOT_SHARE = 0.004
HOT_LEAST = 16
LIST_BLOCK = 2048
#: So many ids are broadcast at most; more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000
FOLD = fold_ascii()
WORD = np.ones(256, bool)
WORD[[32, *range(9, 14)]] = False
_STEP = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every shingle, repeated ones included, in order of documents."""
    s, e = c.runs(WORD)
    h = c.word_hashes(s, e)
    doc = c.doc_of(s)
    if not len(h):
        return doc, h
    n = np.bincount(doc, minlength=len(c.rows))
    code = np.zeros(len(h), np.uint64)
    last = np.arange(len(h))
    end = np.cumsum(n)[doc]
    for k in range(SHINGLE):
        at = last + k
        ok = at < end  # a short document is one shingle: its whole sequence
        code[ok] += (h[at[ok]] + np.uint64(k)) * _STEP[k]
    first = np.cumsum(n)[doc] - n[doc] == last
    keep = (last + SHINGLE <= end) | (first & (n[doc] < SHINGLE))
    code += np.minimum(n[doc], SHINGLE).astype(np.uint64)
    return doc[keep], mix(code[keep])


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, by hash."""
    o = np.lexsort((h, doc))
    doc, h = doc[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - -(-PERCENT * n // 100) + (n > 0)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """A power of two, the set's size at least."""
    return 1 << np.maximum(7, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        out: list = [[]] * len(arr)
        for c in chunks(arr, FOLD):
            d, h = _distinct(*shingles(c))
            cuts = np.searchsorted(d, np.arange(len(c.rows) + 1))
            for i, r in enumerate(c.rows.tolist()):
                out[r] = h[cuts[i] : cuts[i + 1]].view(np.int64)
        yield pa.array(out, pa.list_(pa.int64()))


def _sums(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: sums over its shingles."""
    full = np.diff(cuts) > 0
    h1, h2 = np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64)
    if len(h):
        h1[full], h2[full] = np.add.reduceat(h, cuts[:-1][full]), np.add.reduceat(_other(h), cuts[:-1][full])
    return h1, h2


def _other(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0x5851F42D4C957F2D))


def _whole_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for s in _sets(batches):
        h1, h2 = _sums(s.flatten().to_numpy().view(np.uint64), s.offsets.to_numpy())
        yield pa.StructArray.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), s], names=["h1", "h2", "s"])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _rank(n: np.ndarray) -> np.ndarray:
    """Counts in steps of a ninth, so that one takes a byte; a larger count never has a smaller rank."""
    return (8 * np.log2(1.0 + n)).astype(np.uint8)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each bucket has a shingle, in blocks; of copies within a task one counts."""
    n = np.zeros(BUCKETS, np.uint32)
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        for c in chunks(batch.column(0), FOLD):
            d, h = shingles(c)
            if not len(h):
                continue
            first = np.flatnonzero(np.diff(d, prepend=-1))
            own, at = np.unique(np.add.reduceat(h, first), return_index=True)
            place = np.searchsorted(seen, own)
            new = np.ones(len(own), bool)
            inside = place < len(seen)
            new[inside] = seen[place[inside]] != own[inside]
            seen = np.insert(seen, place[new], own[new])
            keep = np.zeros(len(c.rows), bool)
            keep[d[first[at[new]]]] = True
            keep = keep[d]
            np.add.at(n, np.unique(d[keep] << BUCKET_BITS | _bucket(h[keep])) & (BUCKETS - 1), np.uint32(1))
    blocks = n.reshape(-1, COUNTS_BLOCK)
    some = np.flatnonzero(blocks.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in some.tolist()], pa.binary())], names=["block", "n"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(k, np.zeros(COUNTS_BLOCK, np.int64))
            held[k] += np.frombuffer(zlib.decompress(z.as_py()), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([_rank(n).tobytes() for n in held.values()], pa.binary())], names=["block", "rank"])


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, int]:
    """By bucket the rank of its count over all documents; and the rank from which on shingles are hot."""
    ranks = docs.select("text").mapInArrow(tidy(_counted), "block long, n binary").repartition("block").mapInArrow(tidy(_ranked), "block long, rank binary").toArrow()
    out = np.zeros((BUCKETS // COUNTS_BLOCK, COUNTS_BLOCK), np.uint8)
    for k, r in zip(ranks["block"].to_pylist(), ranks["rank"].to_pylist(), strict=True):
        out[k] = np.frombuffer(r, np.uint8)
    return out.ravel(), int(_rank(np.array(max(HOT_LEAST, HOT_SHARE * docs.count()))))


def _describe(common):
    kind = "struct<n:long,h1:long,h2:long,prefix_key:long,hot:long,prefix:array<long>,sketch:binary>"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, hot_rank = common.value
        for arr in batches:
            rows: list = [{"n": 0, "h1": 0, "h2": 0, "prefix_key": 0, "hot": 0, "prefix": [], "sketch": b""}] * len(arr)
            for c in chunks(arr, FOLD):
                d, h = shingles(c)
                d, h = _distinct(d << 8 | ranks[_bucket(h)], h)  # by rank, then hash
                hot = (d & 255) >= hot_rank
                d = d >> 8
                n = np.bincount(d, minlength=len(c.rows))
                cuts = np.concatenate(([0], np.cumsum(n)))
                p, bits = prefix_size(n), sketch_bits(n)
                base = np.concatenate(([0], np.cumsum(bits)))
                odd = np.bincount(base[d] + (h & (bits[d] - 1).astype(np.uint64)).astype(np.int64), minlength=int(base[-1])) & 1
                packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
                other = _other(h)
                h1, h2 = _sums(h, cuts)
                for i, r in enumerate(c.rows.tolist()):
                    if n[i]:
                        pre = h[cuts[i] : cuts[i] + p[i]]
                        rows[r] = {"n": int(n[i]), "h1": int(h1[i].view(np.int64)), "h2": int(h2[i].view(np.int64)), "prefix_key": int(other[cuts[i] : cuts[i] + p[i]].sum().view(np.int64)), "hot": int(hot[cuts[i] : cuts[i] + p[i]].sum()), "prefix": pre.view(np.int64), "sketch": packed[base[i] // 8 : base[i + 1] // 8]}
            yield pa.StructArray.from_arrays(
                [*(pa.array([r[k] for r in rows], pa.int64()) for k in ("n", "h1", "h2", "prefix_key", "hot")), pa.array([r["prefix"] for r in rows], pa.list_(pa.int64())), pa.array([r["sketch"] for r in rows], pa.binary())],
                names=["n", "h1", "h2", "prefix_key", "hot", "prefix", "sketch"],
            )

    return arrow_udf(tidy(run), kind)


def may_link(n_a, n_b, differing):
    """Whether sets of these sizes link if they differ in so many shingles: (S - D) / (S + D) >= 85 %."""
    s = n_a + n_b
    return 100 * (s - differing) >= PERCENT * (s + differing)


class _List:
    """A list's documents, by size, with their sketches ready for comparison."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        n = t["n"].to_numpy()
        key = t["prefix_key"].to_numpy()
        o = np.lexsort((key, n))
        self.n, self.key, self.ids, self.own = n[o], key[o], t["id"].to_numpy()[o], t["own"].to_numpy()[o]
        self.component = t["component"].to_numpy()[o] if "component" in t.column_names else None
        self.lo, self.hi, self.name = t["lo"][0].as_py(), t["hi"][0].as_py(), t["list"][0].as_py()
        self.order, self.lists = o, t["lists"] if "lists" in t.column_names else None
        self.bits = sketch_bits(self.n)
        sketches = t["sketch"].to_pylist()
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in np.unique(self.bits).tolist():
            at = np.flatnonzero((self.bits == m) | (self.bits == 2 * m))
            grid = np.empty((len(at), m // 64), np.uint64)
            for k, i in enumerate(at.tolist()):
                s = np.frombuffer(sketches[o[i]], np.uint64)
                grid[k] = s if len(s) == m // 64 else s[: m // 64] ^ s[m // 64 :]
            self.level[m] = at, grid
        # groups: equal prefix and size
        new = np.ones(len(o), bool)
        new[1:] = (self.n[1:] != self.n[:-1]) | (self.key[1:] != self.key[:-1])
        self.group = np.cumsum(new) - 1
        self.group_first = np.flatnonzero(new)
        self.group_n = self.n[self.group_first]
        self._first: dict[tuple[int, int], bool] = {}

    def pairs(self, apart: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each document the later ones it may link with, and in how many bits their sketches differ."""
        ends = np.append(self.group_first, len(self.n))
        reach = ends[np.searchsorted(self.group_n, 100 * self.group_n // PERCENT, side="right")]  # by group: sizes that may link
        for i in range(len(self.n)):
            at, grid = self.level[int(self.bits[i])]
            lo, hi = np.searchsorted(at, (i + 1, reach[self.group[i]]))
            if hi <= lo:
                continue
            j = at[lo:hi]
            ok = np.ones(len(j), bool) if self.lo == self.hi else self.own[j] != self.own[i]
            if apart:
                ok &= self.component[j] != self.component[i]
            if not ok.any():
                continue
            k = np.flatnonzero(ok)
            differ = np.bitwise_count(grid[lo + k] ^ grid[np.searchsorted(at, i)]).sum(1, dtype=np.int64)
            fine = may_link(self.n[i], self.n[j[k]], differ)
            if fine.any():
                yield i, j[k[fine]], differ[fine]

    def first_list(self, i: int, j: int) -> bool:
        """Whether this is the first list that both documents are in; groups answer for their members."""
        g = int(self.group[i]), int(self.group[j])
        if g not in self._first:
            a, b = (set(self.lists[int(self.order[x])].as_py()) for x in (i, j))
            self._first[g] = min(a & b) == self.name
        return self._first[g]


def _batch(a: list[int], b: list[int | None]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None


def _likeliest(t: pa.Table) -> pa.RecordBatch | None:
    """Each document's likeliest later partner; and, with no partner given, every document that has one."""
    x = _List(t)
    a, b, some = [], [], np.zeros(len(x.n), bool)
    for i, j, differ in x.pairs(apart=False):
        some[i] = True
        some[j] = True
        k = int(np.argmin(differ / (x.n[i] + x.n[j])))
        a.append(int(x.ids[i]))
        b.append(int(x.ids[j[k]]))
    alone = x.ids[some].tolist()
    return _batch(a + alone, b + [None] * len(alone))


def _remaining(t: pa.Table) -> pa.RecordBatch | None:
    x = _List(t)
    a, b = [], []
    if (x.component == x.component[0]).all():
        return None
    for i, j, _ in x.pairs(apart=True):
        for q in j.tolist():
            if x.first_list(i, q):
                a.append(int(x.ids[i]))
                b.append(int(x.ids[q]))
    return _batch(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    p = p.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    p = p.withColumn("i", F.size(F.array_intersect("sa", "sb"))).withColumn("u", F.size("sa") + F.size("sb") - F.col("i"))
    return cut(p.where(F.col("i") * 100 >= F.col("u") * PERCENT).select("a", "b"))


def _own_blocks(member: DataFrame) -> DataFrame:
    """Rows of (list, lo, hi): whole short lists; of long ones two random blocks for each member."""
    d = member.withColumn("x", F.explode("sized")).withColumn("b", F.ceil(F.col("x.size") / LIST_BLOCK).cast("int"))
    of = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.col("b")).cast("int")
    d = d.withColumn("lo", F.explode(F.when(F.col("b") == 1, F.array(F.lit(0))).otherwise(F.array(of(1), of(2) + F.col("b")))))
    return d.select("*", F.col("x.list").alias("list"), F.col("lo").alias("hi"), F.col("lo").alias("own")).drop("x", "b", "sized")


def join(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row with an id.

    A null or empty text, or one without words, has no shingles and links with
    nothing. Repeated rows are kept; rows that share an id are one document: of unequal
    texts the one with the smallest set hash is compared, texts without words last, and
    all rows of the id get its component. Texts of any length are compared as a whole.
    An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    shared = spark.sparkContext.broadcast(common_shingles(docs))
    base = cut(docs.select("id", _describe(shared)("text").alias("d")).select("id", "d.*"))
    one = base.groupBy("id").agg(F.min(F.struct(F.col("n") == 0, "h1", "h2", "n", "prefix_key")).alias("r")).select("id", "r.h1", "r.h2", "r.n", "r.prefix_key")
    one = cut(one)
    classes = cut(one.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min("prefix_key").alias("prefix_key"), F.count(F.lit(1)).alias("copies")))
    of_group = classes.groupBy("n", "prefix_key").agg(F.min("rep").alias("gid"))
    reps = classes.join(of_group, ["n", "prefix_key"]).select(F.col("rep").alias("id"), "h1", "h2", "gid")
    rep = cut(base.join(reps, ["id", "h1", "h2"]).select("id", "gid", "n", "prefix_key", "hot", "prefix", "sketch"))
    rows = cut(base.select("id", "n"))
    del base, of_group, reps
    release(spark)

    xors = [F.bit_xor(F.xxhash64(F.lit(k), "gid")) for k in (1, 2)]
    same = Window.partitionBy("shingle")
    own = rep.where("id = gid").withColumn("least", F.size("prefix") - F.col("hot"))
    cold = own.select("gid", F.explode(F.expr("slice(prefix, 1, least)")).alias("shingle")).select("gid", F.count(F.lit(1)).over(same).alias("c"), *[x.over(same).alias(f"x{k}") for k, x in enumerate(xors, 1)])
    warm = own.select("gid", F.explode(F.expr("slice(prefix, least + 1, hot)")).alias("shingle"))  # hot shingles are a prefix's last
    warm = hot_join(warm, warm.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), *[x.alias(f"x{k}") for k, x in enumerate(xors, 1)]), ["shingle"], "c", warm.count())
    posted = cold.unionByName(warm.drop("shingle"))
    # a list of one group joins the group's members, which all groups do below
    lists = posted.where("c > 1").select("gid", F.xxhash64("c", "x1", "x2").alias("list")).unionByName(rep.where("id <> gid").select("gid", F.xxhash64(F.lit("group"), "gid").alias("list"))).distinct()
    lists = cut(lists)
    of_group = rep.groupBy("gid").agg(F.count(F.lit(1)).alias("members"))
    size = lists.join(of_group, "gid").groupBy("list").agg(F.sum("members").alias("size"), F.count(F.lit(1)).alias("groups"))
    sized = hot_join(lists, cut(size), ["list"], "groups", lists.count()).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("list", "size"))).alias("sized"))
    member = cut(rep.select("id", "gid", "n", "prefix_key", "sketch").join(sized, "gid").drop("gid"))
    del rep, own, posted, cold, warm, lists, of_group, size, sized
    release(spark)

    group = ["list", "lo", "hi"]
    narrow = ["id", "n", "prefix_key", "sketch"]
    first = cut(each_group(_own_blocks(member).select(*group, "own", *narrow), group, _likeliest, "a long, b long"))
    long = member.where(F.exists("sized", lambda x: x["size"] > LIST_BLOCK)).select("id")
    wanted = cut(first.where("b is null").select(F.col("a").alias("id")).union(long).distinct())
    few = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda d: d
    sets = docs.join(few(wanted), "id", "left_semi").select("id", arrow_udf(tidy(_whole_set), "struct<h1:long,h2:long,s:array<long>>")("text").alias("r"))
    sets = cut(sets.groupBy("id").agg(F.min_by("r.s", F.struct(F.size("r.s") == 0, "r.h1", "r.h2")).alias("s")))
    release(spark)
    links = _verified(first.where("b is not null"), sets)
    comp = components(links)
    left = cut(member.join(wanted, "id", "left_semi").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")))
    met = apart(left.select("id", "component", F.explode("sized.list").alias("list")), "list", "component", "id", LIST_BLOCK)
    met = met.join(left.withColumn("lists", F.col("sized.list")).drop("sized", "component"), "id")
    rest = cut(each_group(met.select(*group, "own", *narrow, "component", "lists"), group, _remaining, "a long, b long"))
    links = links.union(_verified(rest, sets))
    comp = components(links).withColumnRenamed("id", "rep")
    release(spark)

    of_class = cut(classes.join(comp, "rep", "left").select("h1", "h2", "n", "copies", F.coalesce("component", "rep").alias("component")))
    of_id = hot_join(one.select("id", "h1", "h2", "n").where("n > 0"), of_class, ["h1", "h2", "n"], "copies", one.count()).select("id", "component")
    of_id = cut(of_id.union(one.where("n = 0").select("id", "id")))
    del one, of_class, classes, comp, links, first, rest, met, left, member, wanted, long, sets
    release(spark)
    return rows.join(of_id, "id").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def contract(docs: DataFrame) -> DataFrame:
    return join(docs)
