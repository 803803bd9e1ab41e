"""N-gram Jaccard join: a prefix-tree join of shingle sets, with the classes it links.

1. Each text becomes the set of its k-word shingle hashes, in one global order: by level, a
   measure of the number of different sets that hold a hash, then by hash. Levels are kept in
   a map of fixed size by slots of hashes; they are a function of the hash, so any content of
   the map gives a valid order. They come from exact counts of (hash, set) pairs, over all documents, of the
   lowest quarter of the hash space, where prefixes lie; other hashes come last.
2. Equal sets collapse to one; from here on a group of copies is one row.
3. Two sets above the threshold share a hash among each one's prefix, its first
   n - ceil(t n) + 1 hashes. Hashes counted in one set alone tie nothing and are left out,
   which leaves most documents none. Sets sharing a prefix hash at compatible lengths are
   tied to one of their run (a star, not all pairs): sets of one length to the least of them by an
   aggregate, and only lengths meet in a window. Sets of one hash and length are dealt over
   ``SALTS`` keys, so that a very common hash is no single task. Components of ties are families.
4. The sets of each family of two or more meet in a task, which inserts them in a prefix tree
   per class. A set walks the trees of the classes it shares a prefix hash with; overlap is
   counted once for a shared path, and a subtree is left when its remaining length can't
   reach the bound. Only classes with a member that can be similar are walked: by the places of the first
   hash that both share, and by a map of bits of each set. Sets already known to be linked are not compared again, so a family of
   near copies costs about one comparison each. Overlaps are counted exactly on the sets.
5. A family of more than ``block_sets`` sets, or ``block_hashes`` hashes in them, is dealt into blocks; every two
   blocks meet in a task of bounded size, and the links are joined by components again. Most such families hold together
   by chance, so their sets are tied anew first: only two sets of one prefix hash that can be similar by size and by maps of bits stay tied.
   What blocks still meet do so in waves, so that the copies of sets that lie on disk at once are bounded.

Hashes of 64 bits stand for shingles and for sets. Nothing of all documents reaches the
driver but two maps of bounded size: that of levels grows with the text, up to ``most_bits``.

Defined results: a null or empty text, or one of white space, has an empty set: 0 shingles,
linked with nothing, its own class. A null id takes no part in links and has a null class.
Repeated rows are copies: each row appears in the result with the same class. Rows of one id
with different texts are separate sets that may be in different classes. An empty table gives
no rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import discard, materialize, quoted, shuffles_end, unused
from threadloom.llm.components import SALTS, components, salt_rows, salts_of, with_least
from threadloom.llm.textvec import mix, release, shingle_sets, slices, texts_of

U = np.uint64
MAP_BITS = 25  # slots of the map of members: 4 MB of bits
LEAST_BITS = 18  # slots of the smallest map of levels, of a byte each
LOW = 1 << 62  # hashes below are counted
UNCOUNTED = 255
PIECE = 500_000  # pairs counted at once, about
HELD = 250_000  # pairs held before they are dealt
MARK_WORDS = 16  # of 64 bits, which bound the overlap of two sets
CROWD = 4_000  # sets with one prefix hash in a block, of which two meet in a task
COPIES = 2  # copies of sets that are dealt to blocks at once, for each set
TIE_BYTES = 75  # shuffled for a prefix hash (measured)
TIES_AT_ONCE = 1 << 28  # bytes of ties that are shuffled at once, or a quarter of the text's


class Threshold:
    """Similarity num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """Least size of, and overlap with, a set that is similar to one of size n."""
        return -(-self.num * n // self.den)

    def overlap(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n):
        return n + 1 + (-self.num * n) // self.den


def set_key(s: np.ndarray) -> int:
    """Identity of a sorted set."""
    with np.errstate(over="ignore"):
        return int(mix(np.asarray([np.bitwise_xor.reduce(mix(s)) + np.add.reduce(s) * U(0x9E3779B97F4A7C15) + U(len(s))], U)).view(np.int64)[0])


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h >> U(4)) & U(slots - 1)).astype(np.int64)


def _marked(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 6] >> (slot & 63).astype(U)) & U(1) == U(1)


def _level(n: np.ndarray) -> np.ndarray:
    """Level of a hash held by n sets: exact to 128, then sixteen steps for each doubling."""
    steep = 127 + np.floor(16 * np.log2(np.maximum(n, 128) / 128))
    return np.minimum(np.where(n <= 128, n - 1, steep), UNCOUNTED - 1).astype(np.int64)


def _levels_of(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return np.where(s < U(LOW), levels[_slot(s, len(levels))], np.uint8(UNCOUNTED))


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A sorted set in the global order; hashes that aren't counted come last."""
    return s[np.argsort(_levels_of(s, levels), kind="stable")]


def _shared_head(s: np.ndarray, levels: np.ndarray, t: Threshold) -> np.ndarray:
    """The prefix of a sorted set, less the hashes known to be in no other set."""
    if not len(s):
        return s
    head = _ordered(s, levels)[: t.prefix(len(s))]
    return head[_levels_of(head, levels) > 0]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray]]]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                yield part.column("doc_id"), part.column("mark"), shingle_sets(texts_of(part.column("text")), k)
    release()


def _bit_map(words: DataFrame) -> np.ndarray:
    """Dense bit map from rows (word, bits); their number is bounded by the map's size."""
    with shuffles_end(words.sparkSession):
        held = words.select("*").toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), U)
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(U)
    return out


def _pairs(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of hash and set."""
    with np.errstate(over="ignore"):
        first = np.unique(mix(mix(key) + h * U(0x9E3779B97F4A7C15)), return_index=True)[1]
    return h[first], key[first]


def level_map(docs: DataFrame, k: int, bits: int, size: int = 0) -> np.ndarray:
    """Level of each slot, from the greatest number of sets that hold one of its hashes below LOW; copies of a set count once.

    The slots are dealt into parts, whose number follows the bytes of text, ``size``, so that a part holds
    about ``PIECE`` pairs; a task counts its parts one after another.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = 1 << bits
    parts = min(slots, max(tasks, size // 24 // PIECE))  # a quarter of the words, of some six bytes each

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            h, key = _pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            to = _slot(h, slots) * parts >> bits
            order = np.argsort(to, kind="stable")
            h, key, cut = h[order], key[order], np.searchsorted(to[order], np.arange(parts + 1))
            rows = [r for r in range(parts) if cut[r] < cut[r + 1]]
            if rows:
                blobs = [pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in rows], pa.binary()) for x in (h, key)]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(rows, np.int64)), *blobs], ["part", "hashes", "keys"])
            held.clear()

        for _, _, sets in _sets(batches, k):
            for s in sets:
                few = s[: np.searchsorted(s, U(LOW))]
                if len(few):
                    held.append((few, np.full(len(few), set_key(s), np.int64).view(U)))
            if sum(len(h) for h, _ in held) > HELD:
                yield from dealt()
        if held:
            yield from dealt()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of one part after another; a part has the same slots in all tasks."""
        for _, held in _groups(batches):
            h = np.sort(_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))[0])
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            slot, level = _slot(h[first], slots), _level(n)
            slot, level = slot[level > 0], level[level > 0]
            order = np.lexsort((level, slot))
            slot, level = slot[order], level[order]
            last = np.append(slot[1:] != slot[:-1], True) if len(slot) else np.empty(0, bool)
            slot, level = slot[last], level[last]
            word, at = np.unique(slot >> 3, return_index=True)
            if len(word):
                packed = np.bitwise_or.reduceat(level.astype(U) << (8 * (slot & 7)).astype(U), at)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(packed.view(np.int64))], ["word", "packed"])
        release()

    dealt = docs.select("doc_id", "text", "mark").mapInArrow(low, "part long, hashes binary, keys binary")
    blobs = dealt.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(count, "word long, packed long")
    with shuffles_end(docs.sparkSession):
        rows = blobs.groupBy("word").agg(F.bit_or("packed").alias("packed")).toArrow()  # slots / 8 rows at most
    out = np.zeros(slots >> 3, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("packed").to_numpy()
    return out.view(np.uint8)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Hashes and keys of each part, in a task whose rows come sorted by part."""
    part, held = None, []
    for b in batches:
        for i, r in enumerate(b.column("part").to_pylist()):
            if r != part and held:
                yield part, held
                held = []
            part = r
            held.append(tuple(np.frombuffer(b.column(c)[i].as_buffer(), U).copy() for c in ("hashes", "keys")))
    if held:
        yield part, held


def signatures(docs: DataFrame, k: int, t: Threshold, held: Broadcast) -> DataFrame:
    """(doc_id, mark, n, key, prefix, bits) of every document; ``held`` is the map of levels. Bits are null without a prefix."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, sets in _sets(batches, k):
            n = [len(s) for s in sets]
            heads = [_shared_head(s, held.value, t) for s in sets]
            bits = [_bits(s).tobytes() if len(head) else None for s, head in zip(sets, heads, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(np.asarray(n, np.int64)), pa.array(np.asarray([set_key(s) for s in sets], np.int64)), _lists(heads), pa.array(bits, pa.binary())], ["doc_id", "mark", "n", "key", "prefix", "bits"])

    return docs.select("doc_id", "text", "mark").mapInArrow(sign, "doc_id long, mark long, n long, key long, prefix array<long>, bits binary")


def _ties(sets: DataFrame, t: Threshold, wave: int = 0, waves: int = 1) -> DataFrame:
    """(a, b): each set and one of its run among those with the same prefix hash, where lengths in a run leave no gap; of the hashes of one wave."""
    own = "prefix" if waves == 1 else F.filter("prefix", lambda h: F.pmod(h, F.lit(waves)) == wave)
    rows = sets.select(F.explode(own).alias("h"), "n", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    by = Window.partitionBy("h").orderBy("n")
    before = F.lag("n").over(by)
    lengths = rows.groupBy("h", "n").agg(F.min("key").alias("least"), salts_of("key").alias("salts"))
    opens = lengths.withColumn("opens", F.when(before.isNull() | (before * t.den < F.col("n") * t.num), F.col("least")))
    runs = opens.select("h", "n", "salts", F.last("opens", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("a"))
    return rows.join(runs.select("h", "n", "a", salt_rows("salts").alias("salt")), ["h", "n", "salt"]).select("a", F.col("key").alias("b")).filter("a <> b").distinct()


class _Node:
    __slots__ = ("children", "high", "leaf", "low", "path")

    def __init__(self, path: np.ndarray, n: int):
        self.path, self.low, self.high, self.children, self.leaf = path, n, n, {}, False


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    m = min(len(x), len(y))
    other = np.flatnonzero(x[:m] != y[:m])
    return int(other[0]) if len(other) else m


class PrefixTree:
    """Sets in global order, stored by shared prefixes."""

    def __init__(self):
        self.children: dict[int, _Node] = {}

    def insert(self, s: np.ndarray) -> None:
        level, n, rest = self.children, len(s), s
        while True:
            first = int(rest[0])
            node = level.get(first)
            if node is None:
                level[first] = node = _Node(rest, n)
                node.leaf = True
                return
            m = _shared(node.path, rest)
            if m < len(node.path):
                lower = _Node(node.path[m:], n)
                lower.low, lower.high, lower.children, lower.leaf = node.low, node.high, node.children, node.leaf
                node.path, node.children, node.leaf = node.path[:m], {int(lower.path[0]): lower}, False
            node.low, node.high = min(node.low, n), max(node.high, n)
            if m == len(rest):
                node.leaf = True
                return
            level, rest = node.children, rest[m:]

    def finds(self, members: np.ndarray, n: int, t: Threshold) -> bool:
        """Is a stored set of at most n hashes similar to the sorted set ``members`` of n?"""
        least, stack = t.least(n), [(c, 0, 0) for c in self.children.values()]
        while stack:
            node, depth, shared = stack.pop()
            high = min(node.high, n)
            if node.high < least or node.low > n or shared + high - depth < t.overlap(n, high):
                continue
            at = np.searchsorted(members, node.path)
            shared += int(np.count_nonzero(members[np.minimum(at, n - 1)] == node.path))
            depth += len(node.path)
            if node.leaf and least <= depth <= n and shared >= t.overlap(n, depth):
                return True
            if node.children and shared + high - depth >= t.overlap(n, high):
                stack += [(c, depth, shared) for c in node.children.values()]
        return False


class _Holders:
    """Sets with one hash in their prefix: index, size, and the number of hashes from it on."""

    def __init__(self):
        self.rows, self.used = np.empty((4, 3), np.int64), 0

    def add(self, i: int, n: int, rest: int) -> None:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.used] = i, n, rest
        self.used += 1

    def near(self, n: int, rest: int, t: Threshold) -> np.ndarray:
        """Those that can be similar to a set of n hashes, ``rest`` of them from this one on, if this is the first that both share."""
        i, m, other = self.rows[: self.used].T
        return i[np.minimum(other, rest) * (t.num + t.den) >= t.num * (m + n)]


def _possible(mark: np.ndarray, n: int, marks: np.ndarray, m: np.ndarray, t: Threshold) -> np.ndarray:
    """Which sets can be similar to one of n hashes: each bit that the other lacks is a hash that isn't shared."""
    shared = np.minimum(n - np.bitwise_count(mark & ~marks).sum(1, dtype=np.int64), m - np.bitwise_count(marks & ~mark).sum(1, dtype=np.int64))
    return shared * (t.num + t.den) >= t.num * (m + n)


def _bits(s: np.ndarray) -> np.ndarray:
    """Map of bits of a set."""
    out = np.zeros(MARK_WORDS, U)
    np.bitwise_or.at(out, (s >> U(6)).astype(np.int64) & (MARK_WORDS - 1), U(1) << (s & U(63)))
    return out


def tied(n: np.ndarray, bits: np.ndarray, t: Threshold) -> np.ndarray:
    """Class of each set (the place of one member): sets of sizes n, in ascending order, are tied where they can be similar by size and bits."""
    own = np.arange(len(n))
    for i in range(1, len(n)):
        first = int(np.searchsorted(n[:i], t.least(int(n[i]))))
        near = first + np.flatnonzero(_possible(bits[i], int(n[i]), bits[first:i], n[first:i], t))
        for c in np.unique(own[near]).tolist():
            own[own == c] = i
    return own


def _narrow_ties(sets: DataFrame, crowded: DataFrame, t: Threshold) -> DataFrame:
    """(a, b): ties of the ``crowded`` sets (key) that join any two of them that share a prefix hash and can be similar by size and bits.

    The sets of a hash meet in blocks of about ``CROWD``, every two of them in a task.
    """
    spark = sets.sparkSession
    rows = sets.join(crowded, "key").select("key", "n", "bits", F.explode("prefix").alias("h"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    totals = rows.groupBy("h").agg(F.count("*").alias("sets"), salts_of("key").alias("salts")).filter("sets > 1")
    sized = totals.select("h", F.ceil(F.col("sets") / CROWD).cast("int").alias("blocks"), salt_rows("salts").alias("salt"))
    placed = rows.join(sized, ["h", "salt"]).select("h", "n", "key", "bits", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("at"), "blocks")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, n, bits = None, [], [], []

        def done() -> pa.RecordBatch:
            own = tied(np.asarray(n), np.frombuffer(b"".join(bits), U).reshape(-1, MARK_WORDS), t)
            at = np.asarray(keys, np.int64)
            apart = np.flatnonzero(own != np.arange(len(own)))
            return pa.RecordBatch.from_arrays([pa.array(at[own[apart]]), pa.array(at[apart])], ["a", "b"])

        for batch in batches:
            for *name, key, size, mark in zip(*(batch.column(c).to_pylist() for c in ("h", "i", "j", "key", "n", "bits")), strict=True):
                if name != group:
                    if len(keys) > 1:
                        yield done()
                    group, keys, n, bits = name, [], [], []
                keys.append(key)
                n.append(size)
                bits.append(mark)
        if len(keys) > 1:
            yield done()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = _every_two(placed, "h", "n", "key", "bits").repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "key")
    return met.select("h", "i", "j", "key", "n", "bits").mapInArrow(tie, "a long, b long")


def _every_two(rows: DataFrame, *names: str, wave: int = 0, waves: int = 1) -> DataFrame:
    """``names`` and (i, j) of ``rows``, in the block ``at`` of ``blocks``, for every two blocks of a wave (a lone block meets itself)."""
    first = F.pmod(F.lit(wave) - F.col("at"), F.lit(waves))
    others = F.when(first < F.col("blocks"), F.sequence(first, F.col("blocks") - 1, F.lit(waves)))
    other = F.explode(F.when(F.col("blocks") > 1, others).otherwise(F.array(F.lit(0)) if wave == 0 else F.array().cast("array<int>")))
    met = rows.select(*names, "at", "blocks", other.alias("other")).filter("at <> other or blocks = 1")
    return met.select(*names, F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))


def link_family(sets: list[np.ndarray], t: Threshold) -> list[int]:
    """Class of each set (the index of one member) by exact similarity; sets come in global order, by size."""
    own, sizes = np.arange(len(sets)), np.asarray([len(s) for s in sets])  # own: class of each set
    marks = np.zeros((len(sets), MARK_WORDS), U)
    for i, s in enumerate(sets):
        marks[i] = _bits(s)
    trees: dict[int, list[PrefixTree]] = {}
    holders: dict[int, _Holders] = {}
    for i, s in enumerate(sets):
        n = len(s)
        head = s[: t.prefix(n)].tolist()
        near = [holders[h].near(n, n - p, t) for p, h in enumerate(head) if h in holders]
        members, same = np.sort(s), []
        if near:
            near = np.unique(np.concatenate(near))
            classes = np.unique(own[near[_possible(marks[i], n, marks[near], sizes[near], t)]]).tolist()
            same = [c for c in classes if any(tree.finds(members, n, t) for tree in trees[c])]
        root = max(same, key=lambda c: len(trees[c]), default=i)
        for c in same:
            if c != root:
                own[own == c] = root
                trees[root] += trees.pop(c)
        own[i] = root
        trees.setdefault(root, [PrefixTree()])[0].insert(s)
        for p, h in enumerate(head[: n - t.overlap(n, n) + 1]):  # a set at least as large that is similar shares one of these
            holders.setdefault(h, _Holders()).add(i, n, n - p)
    return own.tolist()


def _linked(rows: DataFrame, t: Threshold) -> DataFrame:
    """(a, b): each set of a task's family block and its class; rows come sorted by (group, n, key)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sets = None, [], []

        def done() -> pa.RecordBatch:
            roots = link_family(sets, t)
            pairs = [(keys[r], keys[i]) for i, r in enumerate(roots)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column("s")
            values, at = lists.values.to_numpy().view(U), lists.offsets.to_numpy()
            names = zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True)
            for r, (name, key) in enumerate(zip(names, batch.column("key").to_pylist(), strict=True)):
                if name != group:
                    if keys:
                        yield done()
                    group, keys, sets = name, [], []
                if not keys or keys[-1] != key:
                    keys.append(key)
                    sets.append(values[at[r] : at[r + 1]].copy())
        if keys:
            yield done()

    return rows.mapInArrow(link, "a long, b long")


def similarity_classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; documents link when den * overlap >= num * union.

    Options: ``block_hashes`` and ``block_sets`` of a family's block, of which two meet in a task, and ``most_bits`` of the map of levels.
    """
    return _classes(docs, k, num, den, id_col, text, **options)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, k: int, num: int, den: int, id_col: str, text: str, block_hashes: int = 1_000_000, block_sets: int = 2_000, most_bits: int = 26) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, mark, n, key, root, component_id) of every document, and the written frames that it reads.

    Mark is a hash of the text, root the key of one set of its class.
    """
    spark: SparkSession = docs.sparkSession
    t = Threshold(num, den)
    held = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = level_map(held, k, min(most_bits, max(LEAST_BITS, (size // 32).bit_length())), size)
    sent = spark.sparkContext.broadcast(levels)
    signed = materialize(signatures(held, k, t, sent), "signatures")
    sent.unpersist()
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    sets = signed.filter("n > 0 and doc_id is not null").groupBy("key", "n").agg(F.min("doc_id").alias("least_id"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.collect_set(salt).alias("salts"))  # SALTS at most
    sets = materialize(sets, "sets")  # used four times: written, the plans stay small and so does the driver
    rows = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    waves = -(-rows * TIE_BYTES // max(TIES_AT_ONCE, size // 4)) or 1
    ties = [materialize(_ties(sets, t, i, waves), "ties") for i in range(waves)]
    families = components(reduce(DataFrame.unionByName, ties))
    discard(*ties)

    def with_blocks(families: DataFrame) -> tuple[DataFrame, int | None]:
        """(component, node, n, blocks) of the sets in families, and the most blocks of one."""
        owned = materialize(families.join(sets.select(F.col("key").alias("node"), "n"), "node"), "families")
        dealt = owned.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        totals = dealt.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("sets"), salts_of("node").alias("salts"))
        sized = totals.select("component", F.ceil(F.greatest(F.col("total") / block_hashes, F.col("sets") / block_sets)).cast("int").alias("blocks"), salt_rows("salts").alias("salt"))
        out = materialize(dealt.join(sized, ["component", "salt"]).select("component", "node", "n", "blocks"), "blocks")
        discard(owned)
        return out, out.agg(F.max("blocks")).first()[0]

    blocks, most = with_blocks(families)
    discard(families)
    if (most or 0) > 1:
        near = materialize(_narrow_ties(sets, blocks.filter("blocks > 1").select(F.col("node").alias("key")), t), "near")
        narrow, wide = components(near), blocks
        discard(near)
        blocks, most = with_blocks(wide.filter("blocks = 1").select("node", "component").unionByName(narrow.select("node", "component")))
        discard(narrow, wide)
    if most is None:
        linked = None
    else:
        maps = spark.sparkContext.broadcast((levels, _members(blocks)))
        parts = _family_links(spark, held, k, t, maps, blocks)
        maps.unpersist()
        linked = parts[0]
        if most > 1:
            joined = components(reduce(DataFrame.unionByName, parts))
            discard(*parts)
            linked = joined.select(F.col("component").alias("a"), F.col("node").alias("b"))
            linked.written_to = joined.written_to
    discard(blocks)
    flat = sets.select("key", "n", "least_id", "salts")
    if linked is None:
        classes = flat.select("key", "n", "salts", F.col("key").alias("root"), F.col("least_id").alias("component_id"))
    else:
        rooted = materialize(flat.join(linked.select(F.col("a").alias("root"), F.col("b").alias("key")), "key", "left").withColumn("root", F.coalesce("root", "key")), "roots")
        discard(linked, sets)
        classes = materialize(with_least(rooted, "root", "least_id", "key").select("key", "n", "salts", "root", F.col("least").alias("component_id")), "classes")
        discard(rooted)
    named = classes.select("key", "n", "root", "component_id", F.explode("salts").alias("salt"))  # copies, and texts without words, are dealt by id
    out = signed.select("doc_id", "mark", "n", "key", salt.alias("salt")).join(named, ["key", "n", "salt"], "left")
    out = out.select("doc_id", "mark", "n", "key", F.coalesce("root", "key").alias("root"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out, [signed, sets if linked is None else classes]


def _members(blocks: DataFrame) -> np.ndarray:
    """Bit map, of fixed size, of the sets in families."""
    return _slot_map(blocks.select(F.col("node").bitwiseAND((1 << MAP_BITS) - 1).alias("slot")))


def _slot_map(rows: DataFrame) -> np.ndarray:
    """Bit map, of fixed size, of slots."""
    return _bit_map(rows.select(F.shiftright("slot", 6).alias("word"), F.expr(f"shiftleft(1L, cast(slot & {63} as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")))


def _family_links(spark: SparkSession, docs: DataFrame, k: int, t: Threshold, maps: Broadcast, blocks: DataFrame) -> list[DataFrame]:
    """Meet the sets of each family (or each two of its blocks), in waves. ``maps``: levels, and the bit map that keeps most other texts' sets at home."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, wanted = maps.value
        seen: set[int] = set()
        for _, _, sets in _sets(batches, k):
            keys = np.asarray([set_key(s) for s in sets], np.int64)
            hit = np.flatnonzero(_marked(wanted, keys & ((1 << MAP_BITS) - 1)) & np.asarray([len(s) > 0 for s in sets], bool))
            fresh = [i for i in hit.tolist() if keys[i] not in seen and not seen.add(keys[i])]
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(keys[fresh]), _lists([_ordered(sets[i], order) for i in fresh])], ["key", "s"])

    full = docs.filter("doc_id is not null").select("doc_id", "text", "mark").mapInArrow(emit, "key long, s array<long>")
    at = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = full.join(blocks.select(F.col("node").alias("key"), F.col("component").alias("family"), "blocks", "n"), "key").withColumn("at", at)
    once, copies = blocks.agg(F.sum("n"), F.sum(F.col("n") * F.greatest(F.col("blocks") - 1, F.lit(1)))).first()
    waves = max(1, -(-copies // (COPIES * once)))
    if waves > 1:
        placed = materialize(placed, "placed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = []
    for wave in range(waves):
        dealt = _every_two(placed, "family", "n", "key", "s", wave=wave, waves=waves)
        met = dealt.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "n", "key")
        out.append(materialize(_linked(met.select("family", "i", "j", "key", "s"), t), "links"))
    if waves > 1:
        discard(placed)
    return out


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without near duplicates: of each class one row with the smallest id stays.

    Rows with a null id can't be told apart and all stay. Rows of one id with different texts are judged
    each by its own class; of rows that repeat both id and text the one whose columns' hash is least stays.
    """
    classes, read = _classes(docs, k, num, den, id_col, text, **options)
    found = materialize(classes.select("doc_id", "mark", "root", "component_id"), "found")
    discard(*read)
    keep = found.filter("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("mark").alias("mark"))
    keep = materialize(keep.select("doc_id", "mark").distinct(), "keep")
    once = found.filter("doc_id is not null").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).join(keep.withColumn("kept", F.lit(True)), ["doc_id", "mark"], "left")
    slot = lambda *c: F.xxhash64(*c).bitwiseAND((1 << MAP_BITS) - 1)
    doubt = docs.sparkSession.sparkContext.broadcast(_slot_map(once.filter("n > 1 or kept is null").select(slot("doc_id", "mark").alias("slot"))))
    discard(found)

    @F.pandas_udf("boolean")
    def doubtful(at: pd.Series) -> pd.Series:
        return pd.Series(_marked(doubt.value, at.to_numpy()))

    names = [unused(docs, f"_{c}") for c in ("doc_id", "mark")]
    keep = keep.select(*(F.col(c).alias(name) for c, name in zip(("doc_id", "mark"), names, strict=True)))
    own, key = [F.col(quoted(c)) for c in docs.columns], F.col(quoted(id_col))
    marked = docs.filter(key.isNotNull()).withColumns({names[0]: key.cast("long"), names[1]: F.xxhash64(F.col(quoted(text)).cast("string"))})
    unsure = F.col(names[0]).isNull() | doubtful(slot(*names))  # only rows that may be dropped or repeated are shuffled
    kept = marked.filter(unsure).join(keep.hint("merge"), names, "left_semi").groupBy(*names).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("row"))
    return marked.filter(~unsure).select(*own).unionByName(kept.select("row.*")).unionByName(docs.filter(key.isNull()))
