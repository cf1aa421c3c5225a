"""Near duplicates by Order MinHash.

A text is a sequence of k-mers (shingles of five words), each labelled with its occurrence number.
A sketch takes the few k-mers with the least hashes and keeps them in text order, so equal sketches
need the same k-mers in the same order, as texts at a small edit distance have.  Texts that share a
sketch are candidates; a banded alignment of their k-mer sequences decides.

Groups are never expanded into pairs.  Equal texts are one node.  In a bucket (the nodes that share a
sketch) all are compared with the bucket's centre, the node with the most bucket companions overall;
those that stay apart from it choose a second centre.  Buckets that still hold several components are
settled by what their nodes have beside the centre: of two texts that are alike, the one is unlike the
centre, and neither is shorter than it, so they have k-mers in common that the centre lacks; with none, they
would share no more than the one shares with the centre.  So all nodes meet a centre once more and are dealt
anew by the least of these k-mers, and in the new buckets, which hold texts that share something that
sets them apart, the nodes of other components are compared with one of them.  All this is linear in the
nodes, and leaves apart alike texts that are both unlike the centre and shorter, or that no centre of their
new buckets brings together.  So all pairs of other components of what is still divided are settled exactly:
the k-mers of each node are put in one order, the rare ones first.  From the place of the first k-mer that
two nodes share follows how many they can share at most; where that is enough they are aligned, and
elsewhere they are surely not alike.  No two nodes that share a sketch and align end in different classes.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import sliced, small_batches, stored
from versionlog.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Sketches of a text, and k-mers of a sketch.  Texts of similarity s share a sketch with a probability
#: of about s**4, so at 0.8 none of 24 with 3 in a million.
SKETCHES, KMERS = 24, 4
#: Rows of a bucket that meet in one task.
TOGETHER = 2000
#: Of the k-mers that a node has beside its centre, so many times the inverse of the share that must recur in
#: what is like it are kept, the least: all are missed with a probability of exp(-14).
SURE = 14
#: Numbers by which k-mers are counted to tell rare ones; nodes of a k-mer that meet as many others in one
#: task; rows that are searched for pairs together; pairs with a node that are aligned in one task.
BINS, BLOCK, SEARCHED, ALIGNED = 1 << 24, 400, 16_000, 100
#: Words whose hashes a worker remembers, and k-mers up to which all sketches are taken at once.
MEMORY, AT_ONCE = 200_000, 1 << 16

_ODD = np.random.default_rng(20).integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_XOR = np.random.default_rng(21).integers(0, 1 << 63, 64, dtype=np.uint64)
_POWERS = np.random.default_rng(22).integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hash_of = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def split(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case."""
    return (text or "").encode().lower().split()


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def kmers(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles in text order, told apart by occurrence; a shorter text is one k-mer."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(h))
    x = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        x += h[i : i + len(x)] * _POWERS[i]
    x = _mix(x)
    order = np.argsort(x, kind="stable")
    s = x[order]
    same = s[1:] == s[:-1]
    if same.any():
        at = np.arange(len(s))
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
        number = np.empty_like(s)
        number[order] = (at - begin).astype(np.uint64)
        x = _mix(x + number * _ODD[0])
    return x


def sketch(x: np.ndarray, sketches: int = SKETCHES, size: int = KMERS) -> np.ndarray:
    """A hash of each sketch: the ``size`` k-mers of least hash, in text order."""
    out = np.zeros(sketches, dtype=np.uint64)
    if not len(x):
        return out[:0]
    step = sketches if len(x) <= AT_ONCE else 1
    for a in range(0, sketches, step):
        v = _mix((x[None, :] ^ _XOR[a : a + step, None]) * _ODD[a : a + step, None])
        at = np.argpartition(v, size - 1, axis=1)[:, :size] if len(x) > size else np.broadcast_to(np.arange(len(x)), v.shape)
        picked = x[np.sort(at, axis=1)]
        out[a : a + step] = _mix((picked * _POWERS[: picked.shape[1]]).sum(axis=1, dtype=np.uint64) + _XOR[a : a + step])
    return out


def common_in_order(at: np.ndarray, to: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence along alignments that stray at most ``band`` places.

    ``at`` and ``to`` are the places in one sequence and the other of their equal elements, in the order
    of ``to`` and, of one place there, from the last to the first.  The places of one sequence along an alignment
    rise, so only the least place at which a subsequence of each length can end is kept: memory is that
    of the subsequence, and what lies outside the band is never looked at.
    """
    ends: list[int] = []
    for i in at[np.abs(at - to) <= band].tolist():
        if not ends or i > ends[-1]:
            ends.append(i)
        else:
            ends[bisect_left(ends, i)] = i
    return len(ends)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shared k-mers of the best alignment over all k-mers of either text; 0 if surely below ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return _aligned(ia, ib, n, m, least)


def _aligned(ia: np.ndarray, ib: np.ndarray, n: int, m: int, least: float) -> float:
    """``similarity`` of texts of n and m k-mers whose shared ones stand at ``ia`` and ``ib``."""
    c = len(ia)
    if c < least * (n + m - c):
        return 0.0
    order = np.argsort(ib)
    ia, ib = ia[order], ib[order]
    if (np.diff(ia) > 0).all():
        return c / (n + m - c)  # all that is shared stands in one order
    # At the least similarity, n + m - 2 * common edits are allowed; no such alignment strays further.
    common = common_in_order(ia, ib, int((n + m) * (1 - least) / (1 + least)) + 1)
    return common / (n + m - common)


def beside(x: np.ndarray, centre: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """(similarity with the centre, the least k-mers that the centre lacks).

    Whatever is like ``x``, and no shorter than the centre, shares so many k-mers with it that some of these
    recur; as many are given as surely have one of them.
    """
    n, m = len(x), len(centre)
    _, ia, ib = np.intersect1d(x, centre, assume_unique=True, return_indices=True)
    own = np.ones(n, dtype=bool)
    own[ia] = False
    keys = np.sort(x[own])
    recur = max(1, math.ceil(least / (1 + least) * (n + m)) - len(ia))
    s = _aligned(ia, ib, n, m, least)
    return s, keys[: 2 * SURE if s >= least else max(1, SURE * len(keys) // recur)]


def rarest(x: np.ndarray, often: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers, the rare ones first, how many k-mers a text may have whose first shared one with ``x`` this is, if it is like ``x``).

    ``often`` is an order of the BINS numbers of k-mers, 0 for those that no other text has.  If the first
    k-mer that two texts share stands at place p of the n of one, they share n - p at most, which
    is too few for the other if it is longer than given here.  All that is left out is too late for any text.
    """
    n, rank = len(x), often[x >> np.uint64(40)]
    order = np.lexsort((x, rank))
    most = np.floor((n - np.arange(n)) * ((1 + least) / least) - n + 1e-6).astype(np.int64)
    kept = (most >= least * n - 1e-6) & (rank[order] > 0)
    return x[order[kept]], most[kept]


def pairs_within(cell: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of one cell that have other roots, other sides (or -1) and no more k-mers than either allows.

    Rows of a cell stand together.
    """
    end = np.searchsorted(cell, cell, side="right")
    at, d, us, vs = np.arange(len(cell)), 1, [], []
    while len(at := at[at + d < end[at]]):
        to = at + d
        ok = (n[to] <= most[at]) & (n[at] <= most[to]) & (root[at] != root[to]) & ((side[at] < 0) | (side[at] != side[to]))
        us.append(at[ok])
        vs.append(to[ok])
        d += 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, node, n_kmers, keys)``: a digest of the words, and the sketch hashes of every whole text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            node, size, keys = [], [], []
            for text in b.column(2).to_pylist():
                w = split(text)
                x = kmers(w)
                node.append(digest(w))
                size.append(len(x))
                keys.append(sketch(x).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=[id_col, "text_hash", "node", "n_kmers", "keys"])
        _hash_of.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(text_col), text_col).mapInArrow(batches, f"`{id_col}` {kind}, text_hash long, node binary, n_kmers long, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, rest: bool = False) -> DataFrame:
    """The ``(u, v, alike, rest)`` of ``pairs(u, v, size)`` that align at ``least`` or more; ``size`` is that of a bucket of centre v.

    ``texts`` has (node, kmers).  If ``rest`` is asked for, all pairs are given, with the k-mers of u ``beside`` v.
    """
    tasks = F.ceil(F.col("size") / TOGETHER)
    centres = pairs.groupBy("v").agg(F.max("size").alias("size")).join(texts.select(F.col("node").alias("v"), F.col("kmers").alias("b")), "v")
    centres = centres.select("v", "b", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task"))
    met = pairs.withColumn("task", F.pmod(F.xxhash64("u"), tasks)).join(texts.select(F.col("node").alias("u"), F.col("kmers").alias("a")), "u").join(centres, ["v", "task"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 200):  # k-mers of long texts are large
            got = []
            for x, y in zip(*(b.column(k).to_pylist() for k in (2, 3)), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                got.append(beside(x, y, least) if rest else (similarity(x, y, least), x[:0]))
            alike = pa.array([s >= least for s, _ in got], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), alike, pa.array([k.view(np.int64) for _, k in got], pa.list_(pa.int64()))], names=["u", "v", "alike", "rest"])
            yield out if rest else out.filter(alike)

    return met.select("u", "v", "a", "b").mapInArrow(batches, "u binary, v binary, alike boolean, rest array<long>")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, is_first, text_hash)`` of every row of ``docs``: the least id among its near duplicates.

    Texts are linked if their k-mer sequences align at ``least`` or more; classes are the connected
    components.  Texts with the same words are one node whatever their number.  A text without words
    (null, empty) is like no other: its class is its own id.  ``is_first`` marks the rows whose id is
    the class id; ids that are null are first only in classes without any other id.  ``text_hash``
    tells texts of one id apart.  Repeated rows get the same class.  Empty tables give no rows; other columns are not read.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, least, id_col, text_col)


def _classes(docs: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    worded = rows.filter(F.col("n_kmers") > 0)
    nodes = stored(worded.groupBy("node").agg(F.min(id_col).alias("first"), F.any_value("n_kmers").alias("n_kmers"), F.any_value("keys").alias("keys")), "nodes")
    flat = nodes.select("node", F.explode("keys").alias("key"))  # a key holds the number of its sketch
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = stored(flat.join(shared, "key"), "buckets")
    rank = members.groupBy("node").agg(F.struct(F.sum("size").alias("n"), F.col("node").alias("node")).alias("rank"))
    todo = stored(members.join(rank, "node"), "ranked")
    # The words of a node are those of any of its documents; only nodes in buckets are ever compared.
    sources = nodes.join(rank, "node", "left_semi").select("node", F.col("first").alias("__id"))
    texts = stored(_texts(docs, sources, id_col, text_col), "texts")
    links = root_of = None
    for _ in range(2):  # most groups come together here
        met = stored(_met(todo, _centres(todo)), "met")
        pairs = stored(_pairs(met), "pairs")
        found = verify(pairs, texts, least).select("u", "v")
        links = stored(found if links is None else links.unionByName(found), "found")
        root_of = components(links)
        apart = _rooted(_rooted(met, root_of, "node"), root_of, "c").filter(F.col("node_root") != F.col("c_root"))
        todo = stored(apart.select("node", "rank", "key", "size"), "apart")
    root_of = _settle(members, texts, links, root_of, least)
    roots = _rooted(nodes.select("node", "first"), root_of, "node")
    least_of = roots.groupBy("node_root").agg(F.min("first").alias("class_id"))
    classes = stored(roots.join(least_of, "node_root").select("node", "class_id"), "classes")
    out = rows.select(id_col, "text_hash", "node", "n_kmers").join(classes, "node", "left")
    class_id = F.when(F.col("n_kmers") > 0, F.col("class_id")).otherwise(F.col(id_col))
    return out.select(id_col, class_id.alias("class_id"), F.col(id_col).eqNullSafe(class_id).alias("is_first"), "text_hash")


def _settle(members: DataFrame, texts: DataFrame, links: DataFrame, root_of: DataFrame, least: float) -> DataFrame:
    """Components after the buckets of ``members(key, node, size)`` that hold several are dealt anew and compared."""
    divided = level = stored(_divided(members, root_of), "divided")
    if level.isEmpty():
        return root_of
    texts = stored(texts.join(level.select("node").distinct(), "node", "left_semi"), "texts")
    rank = level.groupBy("node").agg(F.struct(F.sum("size").alias("n"), F.col("node").alias("node")).alias("rank"))
    pairs = stored(_pairs(_met(level, _centres(level.join(rank, "node")))), "pairs")
    seen = stored(verify(pairs, texts, least, rest=True), "seen")
    links = stored(links.unionByName(seen.filter("alike").select("u", "v")), "found")
    root_of = components(links)
    dealt = seen.select(F.col("u").alias("node"), "v", F.explode("rest").alias("r")).select("node", F.xxhash64("v", "r").alias("key"))
    size = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "dealt-sizes")
    level = stored(_divided(dealt.join(size, "key"), root_of), "divided")
    drawn = F.struct(F.xxhash64("key", "node").alias("by"), F.col("node"), F.col("node_root").alias("root"))
    centres = level.groupBy("key").agg(F.max(drawn).alias("of"), F.max("size").alias("size")).select("key", "size", F.col("of.node").alias("c"), F.col("of.root").alias("c_root"))
    pairs = stored(_pairs(_met(level, centres).filter(F.col("node_root") != F.col("c_root"))), "pairs")
    links = stored(links.unionByName(verify(pairs, texts, least).select("u", "v")), "found")
    return _settle_rest(divided, texts, links, components(links), least)


def _settle_rest(divided: DataFrame, texts: DataFrame, links: DataFrame, root_of: DataFrame, least: float) -> DataFrame:
    """Components after all nodes of different ones in the buckets of ``divided`` have been compared, or are surely not alike."""
    apart = _divided(divided, root_of).select("node", F.xxhash64("node_root").alias("root")).distinct()
    nodes = stored(apart.join(texts, "node").select("node", "root", "kmers"), "rest")
    if nodes.isEmpty():
        return root_of
    pairs = stored(_possible(nodes, least), "possible")
    both = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    n = stored(both.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "possible-sizes")
    met = pairs.join(n.select(F.col("node").alias("u"), F.struct("n", "node").alias("a")), "u").join(n.select(F.col("node").alias("v"), F.struct("n", "node").alias("b")), "v")
    few, many = F.least("a", "b"), F.greatest("a", "b")  # the one of more pairs as centre
    pairs = met.select(few["node"].alias("u"), many["node"].alias("v"), (many["n"] * (TOGETHER // ALIGNED)).alias("size"))
    return components(stored(links.unionByName(verify(pairs, texts, least).select("u", "v")), "found"))


def _frequencies(nodes: DataFrame) -> np.ndarray:
    """How often k-mers of ``nodes`` fall into each of BINS numbers, as eight times the logarithm to base 2."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint64)
            k, n = np.unique((x >> np.uint64(40)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int32))], names=["bin", "n"])

    counts = nodes.select("kmers").mapInArrow(batches, "bin int, n int").groupBy("bin").agg(F.sum("n").alias("n")).filter("n > 1")
    got = counts.select("bin", F.least(F.lit(255), F.ceil(8 * F.log2("n"))).cast("short").alias("often")).toArrow()
    often = np.zeros(BINS, dtype=np.uint8)
    often[got.column("bin").to_numpy()] = got.column("often").to_numpy()
    return often


def _possible(nodes: DataFrame, least: float) -> DataFrame:
    """``(u, v)``: all pairs of ``nodes(node, root, kmers)`` of different roots that may be alike by the first k-mer that they share.

    The nodes of a frequent k-mer are dealt to blocks of BLOCK, of which each two meet in a task.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(_frequencies(nodes))

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            x = [np.frombuffer(k, dtype=np.uint64) for k in b.column(2).to_pylist()]
            got = [rarest(k, shared.value, least) for k in x]
            of = np.repeat(np.arange(len(x)), [len(k) for k, _ in got])
            n = np.fromiter(map(len, x), dtype=np.int64, count=len(x))
            keys, most = (np.concatenate(c) for c in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(n[of]), pa.array(most)], names=["key", "node", "root", "n", "most"])

    rows = stored(nodes.mapInArrow(first, "key long, node binary, root long, n long, most long"), "rarest")
    shared.unpersist()
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1).cast("long"))
    dealt = rows.join(F.broadcast(large), "key", "left").withColumn("side", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    among = F.when(F.col("side") == F.col("other"), F.lit(-1)).otherwise(F.col("side")).alias("side")
    cells = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), among, "node", "root", "n", "most")
    ordered = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def found(b: pa.RecordBatch, cell: np.ndarray) -> pa.RecordBatch:
        u, v = pairs_within(cell, *(b.column(c).to_numpy() for c in ("side", "root", "n", "most")))
        return pa.RecordBatch.from_arrays([b.column("node").take(pa.array(x)) for x in (u, v)], names=["u", "v"])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in sliced(it):
            held.append(b)
            if sum(x.num_rows for x in held) >= SEARCHED:
                b = pa.concat_batches(held)
                cell = _cells(b)
                last = int(np.searchsorted(cell, cell[-1]))  # more of the last cell may come
                if last:
                    yield found(b.slice(0, last), cell[:last])
                held = [b.slice(last)]
        if held:
            b = pa.concat_batches(held)
            yield found(b, _cells(b))

    pairs = ordered.mapInArrow(search, "u binary, v binary")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _cells(b: pa.RecordBatch) -> np.ndarray:
    """The number of each row's cell among those of the rows."""
    new = np.zeros(b.num_rows, dtype=bool)
    for c in ("key", "i", "j"):
        x = b.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _pairs(met: DataFrame) -> DataFrame:
    """``(u, v, size)``: each node with each of its centres once."""
    return met.filter(F.col("node") != F.col("c")).groupBy(F.col("node").alias("u"), F.col("c").alias("v")).agg(F.max("size").alias("size"))


def _divided(members: DataFrame, root_of: DataFrame) -> DataFrame:
    """The rows of buckets with more than one component, with ``node_root``."""
    placed = stored(_rooted(members.drop("node_root"), root_of, "node"), "placed")
    many = placed.groupBy("key").agg(F.min("node_root").alias("a"), F.max("node_root").alias("b"), F.max("size").alias("size")).filter(F.col("a") != F.col("b"))
    return _met(placed, many.select("key", "size"))


def _centres(todo: DataFrame) -> DataFrame:
    """``(key, size, c)``: the node of greatest rank of each bucket with more than one row."""
    best = todo.groupBy("key").agg(F.max("rank").alias("centre"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return best.filter("n > 1").select("key", "size", F.col("centre.node").alias("c"))


def _met(many: DataFrame, few: DataFrame, node: str = "node") -> DataFrame:
    """``many`` joined with ``few`` by ``key``, where both know the bucket's ``size``.

    Rows of a large bucket are dealt to a task for every TOGETHER of them, each with a copy of the
    bucket's few rows.
    """
    tasks = F.ceil(F.col("size") / TOGETHER)
    dealt = many.withColumn("__task", F.pmod(F.xxhash64(node), tasks))
    return dealt.join(few.withColumn("__task", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("size"), ["key", "__task"]).drop("__task")


def _rooted(df: DataFrame, root_of: DataFrame, name: str) -> DataFrame:
    """``df`` with the component root of its node column ``name`` (itself, if it has no link)."""
    roots = root_of.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    return df.join(roots, name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))


def _texts(docs: DataFrame, sources: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, kmers)`` of the nodes of ``sources(node, __id)``; rows with the id of another text are passed over."""
    rows = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    met = rows.join(sources, F.col("__d").eqNullSafe(F.col("__id"))).select("node", "text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            every = [(n, split(t)) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            own = {n: w for n, w in every if n == digest(w)}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([kmers(w).tobytes() for w in own.values()], pa.binary())], names=["node", "kmers"])

    return met.mapInArrow(batches, "node binary, kmers binary").groupBy("node").agg(F.any_value("kmers").alias("kmers"))
