"""Language-model scoring by online logistic context mixing over running text.

Every token of a text is coded as binary decisions, and the model's probability of the text is
the product of the probabilities of all decisions. A frequent word (at most ``hot_words`` of
them) or the end is a path in a tree of training counts; any other word is the tree's escape
leaf and then either a repeat of an earlier such word of its document or its bytes, eight
decisions each. The tree's top halves the words again and again by the very frequent words they
follow (the main axis of these counts), so its first decisions tell languages and kinds of words;
below it is a Huffman tree. Every decision of every token is predicted by the mixer, learned from and counted.

Each decision has several predictors. Those of the tree look up counts of zeros and ones under
a hash of the decision with a context: the word before, the two words before, the last of
the ``FUNCTION`` most frequent words in the text so far; the fourth has the counts of that
decision earlier in the same document, and so adapts to the text decision by decision. Those of
bytes have the bytes before in the word as contexts, one of them with the last frequent word.
A gate, chosen by how much evidence the predictors have, selects the weights by which their log
odds are added, and an adaptive probability map refines the sum.

Tables, weights and map are learned online over all running training text: each decision is
predicted from what came before it in the partition, the weights and the map take a step
against the error, and only then do the counts take it up. Partitions' counts are added and their
weights averaged.

At scale: texts are read four times (counts of words, of their companions, learning, scoring) and never shuffled.
The tables grow with the training tokens up to ``most_bits``; a task that learns passes them on
once, for about six partitions of input. Exact counts of rare words are met in blocks: one row
of packed 64-bit hashes for each task and part of the vocabulary, there and back, so no row is
made for a word or for a document in a part.

Defined results: null text counts as empty, and an empty text is the end alone; a null id is
in the fold of the empty text; each input row gives one row, repeated rows included; with
nothing to learn from, all counts are zero and the score comes from the untrained mixer; other
columns are ignored; an empty table gives no rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, split_side
from threadloom.llm.textvec import joined, mix, release, slices, texts_of, word_ranges, words

U = np.uint64
A, B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
END_HASH = U(1)  # stands for the end among the words' hashes
END, ESCAPE = 0, 1  # symbols; frequent words come after them
FUNCTION = 64
ORDERS = (2, 3, 5)  # of bytes within a word
COMPANIONS, CLUSTER_DEPTH = 32, 5
TREE, SPELL = 3, len(ORDERS) + 1  # hashed contexts of a tree's and of a byte's decision
STEPS, LIMIT = 33, 8  # of the map, over log odds between -LIMIT and LIMIT
RANGES = 128  # pieces in which each table is added up
FLUSH = 1_000_000
LEARN_BYTES = 1 << 18
REPEATS = 16  # classes of the number of rare words so far, for the repeat decision


class Mixer(NamedTuple):
    """weights[predictor, gate] with a bias last, and map[gate, step] of probabilities."""

    weights: np.ndarray
    apm: np.ndarray

    @classmethod
    def start(cls, gates: int, predictors: int) -> Mixer:
        grid = 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, STEPS)))
        first = np.concatenate([np.full((predictors, gates), 1.2 / predictors), np.zeros((1, gates))])
        return cls(first.astype(np.float32), np.tile(grid, (gates, 1)).astype(np.float32))

    def odds(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.weights[-1].take(gate)
        for w, row in zip(self.weights, x, strict=False):
            part = w.take(gate)
            part *= row
            z += part
        return np.clip(z, -7.999, 7.999, out=z)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Probability of a one, refined."""
        z = self.odds(x, gate)
        p = _squash(z)
        z += LIMIT
        z *= (STEPS - 1) / (2 * LIMIT)
        cell = z.astype(np.int32)
        z -= cell.astype(np.float32)
        cell += gate.astype(np.int32) * STEPS
        flat = self.apm.reshape(-1)
        refined = flat.take(cell)
        cell += 1
        upper = flat.take(cell)
        upper -= refined
        upper *= z
        refined += upper
        refined += p
        refined *= 0.5
        return np.clip(refined, 1e-5, 1 - 1e-5, out=refined)

    def learn(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, rate: float = 0.008) -> None:
        """A step against the error of each gate's weights, scaled by their curvature, and of the map's nearest steps."""
        z = self.odds(x, gate)
        p = _squash(z)
        gates, error = self.weights.shape[1], bit.astype(np.float32) - p
        curve = p - p * p
        for k, row in enumerate(x):
            slope = np.bincount(gate, weights=error * row, minlength=gates)
            row = row * row
            row *= curve
            self.weights[k] += rate * slope / (np.bincount(gate, weights=row, minlength=gates) + 8)
        self.weights[-1] += rate * np.bincount(gate, weights=error, minlength=gates) / (np.bincount(gate, weights=curve, minlength=gates) + 8)
        z += LIMIT
        z *= (STEPS - 1) / (2 * LIMIT)
        z += 0.5
        cell = gate * STEPS
        cell += z.astype(np.int32)
        cell *= 2
        cell += bit
        flat = self.apm.reshape(-1)
        seen = np.bincount(cell, minlength=2 * flat.size).reshape(-1, 2)
        mass = seen.sum(1)
        flat += ((seen[:, 1] - mass * flat) / (mass + 64) * 0.5).astype(np.float32)


def _squash(z: np.ndarray) -> np.ndarray:
    p = np.negative(z)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


TREE_GATES, SPELL_GATES = 48, 25


class Code(NamedTuple):
    """Frequent words by hash and the tree's paths: bits from the top of a 64-bit number."""

    hashes: np.ndarray  # sorted
    symbol: np.ndarray
    counts: np.ndarray  # by symbol; that of ESCAPE is the number of rare training tokens
    paths: np.ndarray
    lengths: np.ndarray
    total: int  # training tokens
    distinct: int

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, ends: int, total: int, distinct: int) -> Code:
        """From frequent words; symbols are in order of falling counts, and one cluster holds all."""
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        sizes = np.concatenate([[ends, total - ends - int(counts.sum())], counts]).astype(np.int64)
        by_hash = np.argsort(hashes)
        return cls(hashes[by_hash], by_hash + 2, sizes, *_paths(sizes, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)), total, distinct)

    def clustered(self, pairs: np.ndarray, counts: np.ndarray) -> Code:
        """With words that follow the same frequent words near each other in the tree; a pair is symbol * COMPANIONS + companion."""
        seen = np.zeros((len(self.counts), COMPANIONS))
        seen.reshape(-1)[pairs] = counts
        top, depth = np.zeros(len(self.counts), np.int64), np.zeros(len(self.counts), np.int64)

        def halve(members: np.ndarray, path: int, at: int) -> None:
            top[members], depth[members] = path, at
            mass = seen[members].sum(1)
            if at == CLUSTER_DEPTH or np.count_nonzero(mass) < 2:
                return
            rows = np.sqrt((seen[members] + 0.2 * seen[members].sum(0) / max(1.0, mass.sum())) / (mass[:, None] + 0.2))
            mean = np.average(rows, axis=0, weights=mass)
            _, axes = np.linalg.eigh((rows - mean).T @ ((rows - mean) * mass[:, None]))
            side = (rows - mean) @ axes[:, -1] > 0
            if side.any() and not side.all():
                for b in (0, 1):
                    halve(members[side == b], path << 1 | b, at + 1)

        halve(np.arange(len(self.counts)), 0, 0)
        paths, lengths = _paths(self.counts, top, depth)
        return self._replace(paths=paths, lengths=lengths)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbol of each word, by its hash."""
        if not len(self.hashes):
            return np.full(len(h), ESCAPE)
        some, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        return np.where(self.hashes[at] == some, self.symbol[at], ESCAPE)[back]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _huffman(sizes: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code; sizes are raised so that no path exceeds about 44 decisions."""
    least = max(1, int(sizes.sum()) >> 40)
    heap = [(max(int(n), least), i) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    parent, n = np.zeros(2 * len(sizes) - 1, np.int64), len(sizes)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = n
        heapq.heappush(heap, (a + b, n))
        n += 1
    depth = np.zeros(n, np.int64)
    for i in range(n - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return depth[: len(sizes)]


def _paths(sizes: np.ndarray, top: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths and lengths: the cluster's path (depth bits), then a Huffman code within the cluster."""
    paths, lengths = np.zeros(len(sizes), U), np.zeros(len(sizes), np.int64)
    cluster = top | (1 << depth)
    for k in np.unique(cluster).tolist():
        members = np.flatnonzero(cluster == k)
        above = int(depth[members[0]])
        inner = _huffman(np.maximum(sizes[members], 1))
        at, last = 0, 0
        for s in np.lexsort((members, inner)).tolist():
            at, last = at << (int(inner[s]) - last), int(inner[s])
            path = int(top[members[s]]) << last | at
            paths[members[s]] = U(path << (64 - above - last) if above + last else 0)
            at += 1
        lengths[members] = above + inner
    return paths, lengths


class Text:
    """Tokens of a batch of texts: symbols, hashes and contexts, each text closed by its end."""

    def __init__(self, texts: list[bytes], code: Code):
        self.data, starts = joined(texts)
        begin, end, h = words(self.data)
        first = word_ranges(begin, starts)
        n_words = np.diff(first)
        self.n_docs, n = len(texts), len(begin) + len(texts)
        self.doc = np.repeat(np.arange(len(texts)), n_words + 1)
        is_word = np.ones(n, bool)
        self.ends = np.cumsum(n_words + 1) - 1
        is_word[self.ends] = False
        self.n_tokens = n_words + 1
        self.n_bytes = np.bincount(self.doc[is_word], weights=end - begin, minlength=len(texts)).astype(np.int64) + self.n_tokens
        self.hash, self.symbol = np.full(n, END_HASH), np.full(n, END)
        self.hash[is_word] = h
        self.symbol[is_word] = code.symbols(h)
        self.begin, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.begin[is_word], self.size[is_word] = begin, end - begin
        self.path, self.length = code.paths[self.symbol], code.lengths[self.symbol]
        self.place = place = np.arange(n) - np.repeat(self.ends + 1 - self.n_tokens, self.n_tokens)
        frequent = (self.symbol > ESCAPE) & (self.symbol < FUNCTION + 2)
        last = np.roll(np.maximum.accumulate(np.where(frequent, np.arange(n), -1)), 1)
        last = np.where((place >= 1) & (last >= np.arange(n) - place), last, -1)
        self.last = np.where(last >= 0, self.symbol[last], 0).astype(U)

    def contexts(self) -> list[np.ndarray]:
        """Hashes of each token's contexts in the tree."""
        one = np.where(self.place >= 1, np.roll(self.hash, 1), U(2))
        two = np.where(self.place >= 2, np.roll(self.hash, 2), U(3))
        return [mix(one * A), mix((two * B + one) * A), mix((self.last + U(7)) * B)]

    def companions(self) -> np.ndarray:
        """symbol * COMPANIONS + the last frequent word before, of tokens that have one among the most frequent."""
        some = (self.last >= 2) & (self.last < COMPANIONS + 2)
        return self.symbol[some] * COMPANIONS + self.last[some].astype(np.int64) - 2

    def decisions(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth of the tree: the tokens that decide there, hashed node, bit, and the zeros and ones of that
        decision earlier in the text.

        Tokens are kept in groups of one text and node, in order of place; a depth's groups are split by its
        bits. A token alone in its group stays so, and nothing of it is sorted or counted any more.
        """
        at, opens, depth = np.arange(len(self.doc)), np.ones(len(self.doc), bool), 0
        opens[1:] = self.doc[1:] != self.doc[:-1]
        alone = at[:0]
        length = self.length.astype(np.int8)
        while True:
            more = length.take(at) > depth  # a node's tokens all end at it or all go on
            if not more.all():
                at, opens = at[more], opens[more]
            lone = opens & np.append(opens[1:], True)
            if len(alone):
                alone = alone[length.take(alone) > depth]
            if lone.any():
                alone, at, opens = np.concatenate([alone, at[lone]]), at[~lone], opens[~lone]
            n = len(at)
            if not n + len(alone):
                return
            path = self.path.take(np.concatenate([at, alone]))
            bit = ((path >> U(63 - depth)) & U(1)).astype(np.int32)
            if depth:
                path >>= U(64 - depth)
                path |= U(1 << depth)
            else:
                path[:] = 1
            path *= A
            both = bit[:n]
            start = np.flatnonzero(opens).astype(np.int32)
            size = np.diff(start, append=np.int32(n))
            ones = np.cumsum(both, dtype=np.int32)
            ones -= both
            first = ones[start]
            n_one = np.diff(first, append=np.int32(both.sum()))
            before = ones
            before -= np.repeat(first, size)
            zeros_before = np.arange(n, dtype=np.int32)
            begin = np.repeat(start, size)
            zeros_before -= begin
            zeros_before -= before
            yield np.concatenate([at, alone]), path, bit, zeros_before, before
            zeros = size - n_one
            to = np.where(both == 1, np.repeat(zeros, size) + before, zeros_before)
            to += begin
            moved = np.empty_like(at)
            moved[to] = at
            opens = np.zeros(n, bool)
            opens[start] = True
            opens[(start + zeros)[n_one > 0]] = True
            at, depth = moved, depth + 1

    def rare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of rare words in order; whether each repeats one of its text, how often that occurred, and the rare words so far."""
        at = np.flatnonzero(self.symbol == ESCAPE)
        doc, h = self.doc[at], self.hash[at]
        order = np.lexsort((at, h, doc))
        new = np.ones(len(at), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        run = np.flatnonzero(new)
        times = np.empty(len(at), np.int64)
        times[order] = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        return at, times > 0, times, np.arange(len(at)) - np.searchsorted(doc, doc)

    def spelt(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Owner, value and contexts of each byte of the words at these places, with a closing space each."""
        size = self.size[at] + 1
        owner = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        value = self.data[np.repeat(self.begin[at], size) + place].astype(np.int64)
        value[np.cumsum(size) - 1] = 32
        contexts = []
        for order in ORDERS:
            h = np.full(len(value), order + 1, U)
            for back in range(1, order + 1):
                h = h * A + np.where(place >= back, np.roll(value, back) + 1, 0).astype(U)
            contexts.append(mix(h))
        return owner, value, [*contexts, mix(contexts[0] + self.last[at][owner] * B)]


def _sizes(bits: int) -> tuple[list[int], list[int]]:
    """Slots of each context, in bits: those of the tree (the last one has few contexts), and those of bytes."""
    return [*[bits] * (TREE - 1), min(bits, 17)], [max(14, bits - 2)] * SPELL


def _slots(contexts: list[np.ndarray], key: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, base = [], 0
    for c, bits in zip(contexts, sizes, strict=True):
        out.append(((c + key) * B >> U(64 - bits)).astype(np.int64) + base)
        base += 1 << bits
    return out


def _byte_keys(value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The eight decisions of bytes: hash of the bits so far, and the bit."""
    for b in range(8):
        yield ((value >> (8 - b)) | (1 << b)).astype(U) * A, (value >> (7 - b)) & 1


LEVELS = (1, 4, 32)
SPELL_LEVELS = (1, 4, 16, 64)
#: Level of evidence and log of small counts.
LEVEL, SPELL_LEVEL = (np.searchsorted(x, np.arange(65), "right") for x in (LEVELS, SPELL_LEVELS))
LOGS = np.log(np.arange(4096) + 0.35).astype(np.float32)
UNIT = 1 / 2048  # of log odds as they are stored, above three bits of level


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    out = LOGS.take(ones, mode="clip")
    out -= LOGS.take(zeros, mode="clip")
    return out


def _own(zeros: np.ndarray, ones: np.ndarray, n: int) -> np.ndarray:
    """Log odds of the text's own counts; those after the first ones are of tokens alone in their group, which have none."""
    out = np.zeros(n, np.float32)
    out[: len(ones)] = _odds(zeros, ones)
    return out


def _states(counts: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Log odds and level of evidence of (zeros, ones) in 16 bits."""
    odds = np.log((counts[:, 1] + 0.35) / (counts[:, 0] + 0.35))
    fixed = np.clip(np.rint(odds / UNIT / 8), -2047, 2047).astype(np.int16) * np.int16(8)
    return fixed + level[np.minimum(counts.sum(1), 64).astype(np.int64)].astype(np.int16)


def _tree_gate(local: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Gate of decisions; ``local`` is of the first ones, the others have no evidence in their text."""
    gate = np.minimum(two, 2).astype(np.int64)
    gate += one * 3
    gate[: len(local)] += LEVEL.take(local, mode="clip") * 12
    return gate


class Model:
    """Tables of counts (zeros and ones by slot) and mixers that learn from running text, at every decision."""

    def __init__(self, code: Code, bits: int):
        self.code, self.bits, self.sizes = code, bits, _sizes(bits)
        self.tree, self.spell = (np.zeros((sum(1 << b for b in x), 2), np.int32) for x in self.sizes)
        self.repeats = np.zeros((REPEATS, 2))
        self.tree_mixer, self.spell_mixer = Mixer.start(TREE_GATES, TREE + 1), Mixer.start(SPELL_GATES, SPELL)

    def learn(self, texts: list[bytes]) -> int:
        """Predict, take a step, count; returns the number of tokens."""
        text = Text(texts, self.code)
        contexts = text.contexts()
        for at, key, bit, zeros, ones in text.decisions():
            slots = _slots([c.take(at) for c in contexts], key, self.sizes[0])
            x, n = self._inputs(self.tree, slots)
            x.append(_own(zeros, ones, len(at)))
            self.tree_mixer.learn(x, _tree_gate(zeros + ones, LEVEL.take(n[0]), LEVEL.take(n[1])), bit)
            self._count(self.tree, slots, bit)
        at, again, _, so_far = text.rare()
        np.add.at(self.repeats, (_class(so_far), again.astype(np.int64)), 1)
        _, value, spelling = text.spelt(at[~again])
        for key, bit in _byte_keys(value):
            slots = _slots(spelling, key, self.sizes[1])
            x, n = self._inputs(self.spell, slots)
            self.spell_mixer.learn(x, SPELL_LEVEL.take(n[1]) * 5 + SPELL_LEVEL.take(n[2]), bit)
            self._count(self.spell, slots, bit)
        return len(text.doc)

    @staticmethod
    def _inputs(table: np.ndarray, slots: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        held = [table.reshape(-1).view(np.int64).take(s) for s in slots]  # both counts at once
        held = [(x & 0xFFFFFFFF, x >> 32) for x in held]
        return [_odds(*x) for x in held], [np.minimum(x[0] + x[1], 64) for x in held[:3]]

    @staticmethod
    def _count(table: np.ndarray, slots: list[np.ndarray], bit: np.ndarray) -> None:
        flat = table.reshape(-1)
        for s in slots:
            np.add.at(flat, 2 * s + bit, np.int32(1))

    def vectors(self) -> np.ndarray:
        """Weights and maps in one row."""
        return np.concatenate([x.ravel() for m in (self.tree_mixer, self.spell_mixer) for x in m]).astype(np.float64)


def _class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1).astype(np.int64), REPEATS - 1)


class Frozen(NamedTuple):
    """A model as it scores: log odds with levels of evidence by slot."""

    code: Code
    bits: int
    tree: np.ndarray
    spell: np.ndarray
    repeats: np.ndarray
    tree_mixer: Mixer
    spell_mixer: Mixer

    @classmethod
    def of(cls, m: Model) -> Frozen:
        return cls(m.code, m.bits, _states(m.tree, LEVEL), _states(m.spell, SPELL_LEVEL), m.repeats, m.tree_mixer, m.spell_mixer)

    def score(self, texts: list[bytes]) -> tuple[Text, np.ndarray]:
        """log2 probability of each token."""
        text, sizes = Text(texts, self.code), _sizes(self.bits)
        contexts = text.contexts()
        out = np.zeros(len(text.doc))
        for at, key, bit, zeros, ones in text.decisions():
            held = [self.tree.take(s) for s in _slots([c.take(at) for c in contexts], key, sizes[0])]
            x = [v * np.float32(UNIT) for v in held]
            x.append(_own(zeros, ones, len(at)))
            p = self.tree_mixer.mixed(x, _tree_gate(zeros + ones, *(v & 7 for v in held[:2])))
            out[at] += _cost(p, bit)
        at, again, times, so_far = text.rare()
        share = np.log2((self.repeats + 0.5) / (self.repeats.sum(1, keepdims=True) + 1))
        out[at] += share[_class(so_far), again.astype(np.int64)]
        out[at[again]] += np.log2(times[again] / so_far[again])
        first = at[~again]
        owner, value, spelling = text.spelt(first)
        total = np.zeros(len(value))
        for key, bit in _byte_keys(value):
            held = [self.spell.take(s) for s in _slots(spelling, key, sizes[1])]
            p = self.spell_mixer.mixed([v * np.float32(UNIT) for v in held], (held[1] & 7).astype(np.int64) * 5 + (held[2] & 7))
            total += _cost(p, bit)
        out[first] += np.bincount(owner, weights=total, minlength=len(first))
        return text, out


def _cost(p: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """log2 of the probability of the bit."""
    return np.log(np.abs(p - (1 - bit).astype(np.float32))) * np.float32(1 / math.log(2))


# ---- distribution

def _part_keys(spark, parts: int) -> list[int]:
    """For each of ``parts`` partitions a number that is dealt to it."""
    rows = spark.range(40 * parts).groupBy(F.pmod(F.hash(F.col("id")), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()  # a row for each partition
    found = {r["p"]: r["id"] for r in rows}
    return [found.get(p, p) for p in range(parts)]


def _dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of hashes by part, and where each part starts."""
    to = (h % U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(parts + 1))


def _growing(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts in batches that double from LEARN_BYTES / 32, so that a small corpus gives enough steps too."""
    most = LEARN_BYTES >> 5
    for batch in batches:
        i, size = 0, [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")]
        while i < batch.num_rows:
            j, n = i, 0
            while j < batch.num_rows and (j == i or n + size[j] <= most):
                n, j = n + size[j], j + 1
            yield texts_of(batch.column("text").slice(i, j - i))
            i, most = j, min(LEARN_BYTES, 2 * most)


def _tokens(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for i, j in slices(batch, "text", most):
            part = batch.slice(i, j - i)
            yield part, texts_of(part.column("text"))


def _vocabulary(train: DataFrame, parts: int, keys: list[int]) -> DataFrame:
    """(part, hashes, counts): all training tokens, a row for each part, hashes sorted."""
    schema = "part long, hashes binary, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            h, c = _merged([*held, (np.array([END_HASH]), np.array([ends]))])
            order, cut = _dealt(h, parts)
            h, c = h[order], c[order]
            rows = [r for r in range(parts) if cut[r] < cut[r + 1]]
            yield _packed([[keys[r] for r in rows], [h[cut[r] : cut[r + 1]] for r in rows], [c[cut[r] : cut[r + 1]] for r in rows]], ("part", "hashes", "counts"))
            held.clear()

        with np.errstate(over="ignore"):
            for _, texts in _tokens(batches, 1 << 20):
                data, _ = joined(texts)
                held.append(np.unique(words(data)[2], return_counts=True))
                ends += len(texts)
                if sum(len(h) for h, _ in held) > 2 * FLUSH:
                    held[:] = [_merged(held)]
                if len(held) == 1 and len(held[0][0]) > FLUSH:
                    yield from dealt()
                    ends = 0
            if held:
                yield from dealt()
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches, "part"):
            h, c = _merged([(np.frombuffer(r["hashes"], U), np.frombuffer(r["counts"], np.int64)) for r in rows])
            yield _packed([[part], [h], [c]], ("part", "hashes", "counts"))

    return train.select("text").mapInArrow(count, schema).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add, schema)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with the sums of their counts."""
    h, c = (np.concatenate(x) for x in zip(*held, strict=True))
    if not len(h):
        return h, c
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first).astype(np.int64)


def _packed(columns: list[list], names: tuple[str, ...]) -> pa.RecordBatch:
    """Arrays as binary values, numbers as longs."""
    out = [pa.array([x.tobytes() for x in c], pa.binary()) if c and isinstance(c[0], np.ndarray) else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(out, list(names))


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that come sorted, by key."""
    key, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if row[by] != key and rows:
                yield key, rows
                rows = []
            key = row[by]
            rows.append(row)
    if rows:
        yield key, rows


def _code(vocabulary: DataFrame, hot_words: int) -> Code:
    """Total, distinct and the most frequent words: those above the least count that keeps at most ``hot_words``."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                h, c = np.frombuffer(h, U), np.frombuffer(c, np.int64)
                ends = int(c[h == END_HASH].sum())
                step, n = np.unique(_step(c), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n), pa.array(np.where(np.arange(len(n)) == 0, c.sum(), 0)), pa.array(np.where(np.arange(len(n)) == 0, ends, 0))], ["step", "n", "total", "ends"])

    rows = vocabulary.mapInArrow(sizes, "step long, n long, total long, ends long").groupBy("step").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("ends").alias("ends")).collect()  # a few thousand steps at most
    least, kept = None, 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        kept += r["n"]
        if kept > hot_words or r["step"] < 2:
            break
        least = r["step"]

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                h, c = np.frombuffer(h, U), np.frombuffer(c, np.int64)
                hit = (_step(c) >= least) & (h != END_HASH)
                yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array(c[hit])], ["h", "c"])

    hashes, counts = np.empty(0, U), np.empty(0, np.int64)
    if least is not None:
        held = vocabulary.mapInArrow(frequent, "h long, c long").toArrow()  # hot_words rows at most
        hashes, counts = held.column("h").to_numpy().view(U), held.column("c").to_numpy()
    return Code.of(hashes, counts, sum(r["ends"] for r in rows), sum(r["total"] for r in rows), sum(r["n"] for r in rows))


def _step(c: np.ndarray) -> np.ndarray:
    """Counts up to 4096 as they are, then 64 steps for each doubling."""
    return np.where(c <= 4096, c, 4096 + np.floor(64 * np.log2(np.maximum(c, 4096) / 4096))).astype(np.int64)


def _small(held: np.ndarray) -> np.ndarray:
    """Counts scaled to at most 255; a pair keeps its ratio, and zero stays zero."""
    scaled = held * np.minimum(1, 255 / np.maximum(held.max(axis=1, keepdims=True), 1))
    return np.clip(np.rint(scaled), held > 0, 255).astype(np.uint8)


def _companions(train: DataFrame, code, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a frequent word and its companion with counts: COMPANIONS for each frequent word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(code.value.counts) * COMPANIONS, np.int32)
        with np.errstate(over="ignore"):
            for _, texts in _tokens(batches, LEARN_BYTES):
                np.add.at(seen, Text(texts, code.value).companions(), np.int32(1))
        pair = np.flatnonzero(seen)
        order, cut = _dealt(pair.astype(U), parts)
        for r in range(parts):
            some = pair[order[cut[r] : cut[r + 1]]]
            if len(some):
                yield _packed([[r], [some], [seen[some].astype(np.int64)]], ("part", "pairs", "counts"))
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held += [(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)) for x, n in zip(b.column("pairs"), b.column("counts"), strict=True)]
            if sum(len(x) for x, _ in held) > 4 * FLUSH:
                held[:] = [_merged(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], ["pair", "n"])
        release()

    rows = train.select("text").mapInArrow(count, "part long, pairs binary, counts binary").repartition(parts, "part").mapInArrow(add, "pair long, n long").toArrow()
    return rows.column("pair").to_numpy(), rows.column("n").to_numpy()


def _learned(train: DataFrame, code, bits: int, mappers: int) -> Frozen:
    """Tables added up and mixers averaged over the partitions."""
    frozen = Frozen.of(Model(code.value, bits))
    whole = (len(frozen.tree), len(frozen.spell))
    cuts = [np.linspace(0, n, RANGES + 1).astype(np.int64) for n in whole]
    schema = "part long, counts binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = Model(code.value, bits), 0
        with np.errstate(over="ignore"):
            for texts in _growing(batches):
                n += m.learn(texts)
        if n:
            for k, table in enumerate((m.tree, m.spell)):
                for r in range(RANGES):
                    yield _packed([[2 * r + k], [_small(table[cuts[k][r] : cuts[k][r + 1]])]], ("part", "counts"))
            yield _packed([[-1], [np.concatenate([[n], n * m.vectors(), m.repeats.ravel()])]], ("part", "counts"))
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r, x in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                new = np.frombuffer(x.as_buffer(), np.uint8 if r >= 0 else np.float64)
                if r in held:
                    held[r] += new
                else:
                    held[r] = new.astype(np.float32 if r >= 0 else np.float64)
        for r, x in held.items():
            yield _packed([[r], [x if r < 0 else _states(x.reshape(-1, 2), (LEVEL, SPELL_LEVEL)[r % 2])]], ("part", "counts"))
        release()

    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = train.select("text").coalesce(mappers).mapInArrow(learn, schema).repartition(parts, "part").mapInArrow(add, schema).toArrow()  # tables of a bounded size
    for r, x in zip(rows.column("part").to_pylist(), rows.column("counts"), strict=True):
        if r < 0:
            flat = np.frombuffer(x.as_buffer(), np.float64)
            n, flat = flat[0], flat[1:]
            for m in (frozen.tree_mixer, frozen.spell_mixer):
                for target in m:
                    target[...] = (flat[: target.size] / n).reshape(target.shape)
                    flat = flat[target.size :]
            frozen.repeats[...] = flat.reshape(frozen.repeats.shape)
        else:
            table = (frozen.tree, frozen.spell)[r % 2]
            table[cuts[r % 2][r // 2] : cuts[r % 2][r // 2 + 1]] = np.frombuffer(x.as_buffer(), np.int16)
    return frozen


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1, hot_words: int = 1 << 18, most_bits: int = 21, mappers: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``mappers`` is the number of tasks that learn (a sixth of the shuffle partitions, 6 at least).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.col(id_col).cast("long")
    held = docs.select(ids.alias("doc_id"), F.col(text).cast("string").alias("text"), (split_side(ids, folds) == held_fold).alias("held_out"))
    train, keys = held.filter("not held_out"), _part_keys(spark, parts)
    vocabulary = materialize(_vocabulary(train, parts, keys), "vocabulary")
    code = _code(vocabulary, hot_words)
    code = code.clustered(*_companions(train, spark.sparkContext.broadcast(code), parts))
    bits = min(most_bits, max(14, math.ceil(math.log2(code.total + 1)) - 2))
    model = _learned(train, spark.sparkContext.broadcast(code), bits, mappers or max(6, parts // 6))
    return _documents(held, vocabulary, spark.sparkContext.broadcast(model), parts, keys)


SUMS = (("doc_id", np.int64), ("id_null", np.bool_), ("held_out", np.bool_), ("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64), ("score", np.float64), ("n_bytes", np.int64))


def _documents(held: DataFrame, vocabulary: DataFrame, frozen, parts: int, keys: list[int]) -> DataFrame:
    """Scores of documents, with the counts of their rare words from the vocabulary.

    A task packs the rare words of its documents by part of the vocabulary and keeps what it
    knows of the documents in one row; both are named by their home, a number of the task's own. A part
    sends back to each home the sums over its words.
    """
    schema = "part long, tag int, home long, a binary, b binary, c binary"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def row(part: int, tag: int, home: int, *packed: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tag], pa.int32()), pa.array([home], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows, rare, n_docs = frozen.value, [], [], 0
        counts = model.code.counts
        base = model.code.base(counts)
        home = (TaskContext.get().partitionId() << 24) - 1

        def flushed() -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(x) for x in zip(*rows, strict=True)]
            yield row(keys[home % parts], 2, home, b"".join(x.astype(t).tobytes() for x, (_, t) in zip(whole, SUMS, strict=True)), b"", b"")
            h, doc, n = (np.concatenate(x) for x in zip(*rare, strict=True))
            order, cut = _dealt(h, parts)
            h, doc, n = h[order], doc[order].astype(np.int32), n[order].astype(np.int32)
            for r in range(parts):
                a, b = cut[r], cut[r + 1]
                if a < b:
                    yield row(keys[r], 1, home, h[a:b].tobytes(), doc[a:b].tobytes(), n[a:b].tobytes())
            rows.clear()
            rare.clear()

        with np.errstate(over="ignore"):
            for batch, texts in _tokens(batches, LEARN_BYTES):
                if not rows:
                    home, n_docs = home + 1, 0
                text, logs = model.score(texts)
                known = text.symbol != ESCAPE
                doc, symbol = text.doc[known], text.symbol[known]
                n_known = np.bincount(doc, minlength=text.n_docs) - (counts[END] == 0)
                ids, out = batch.column("doc_id"), batch.column("held_out")
                logs = np.bincount(text.doc, weights=logs, minlength=text.n_docs) * math.log10(2)
                rows.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), out.to_numpy(zero_copy_only=False), text.n_tokens, n_known, np.bincount(doc, weights=base[symbol], minlength=text.n_docs), logs, text.n_bytes))
                at = np.flatnonzero(~known)
                h, doc = text.hash[at], text.doc[at]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)])
                rare.append((h[first], doc[first] + n_docs, np.diff(np.append(first, len(h)))))
                n_docs += text.n_docs
                if sum(len(x[0]) for x in rare) > FLUSH or n_docs > FLUSH:
                    yield from flushed()
            if rows:
                yield from flushed()
        release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, vocabulary, code = None, (np.empty(0, U), np.empty(0, np.int64)), frozen.value.code
        for batch in batches:
            for i in range(batch.num_rows):
                at, tag, home = (batch.column(x)[i].as_py() for x in ("part", "tag", "home"))
                a, b, c = (batch.column(x)[i].as_buffer() for x in ("a", "b", "c"))
                if at != part:
                    part, vocabulary = at, (np.empty(0, U), np.empty(0, np.int64))
                if tag == 0:
                    vocabulary = np.frombuffer(a, U).copy(), np.frombuffer(b, np.int64).copy()
                elif tag == 2:
                    yield row(0, 2, home, a.to_pybytes(), b"", b"")
                else:
                    h, doc, n = np.frombuffer(a, U), np.frombuffer(b, np.int32), np.frombuffer(c, np.int32)
                    slot = np.minimum(np.searchsorted(vocabulary[0], h), max(0, len(vocabulary[0]) - 1))
                    count = np.where(vocabulary[0][slot] == h, vocabulary[1][slot], 0) if len(vocabulary[0]) else np.zeros(len(h), np.int64)
                    some, back = np.unique(doc, return_inverse=True)
                    known, base = np.bincount(back, weights=n * (count > 0)), np.bincount(back, weights=n * code.base(count))
                    yield row(0, 1, home, some.tobytes(), known.astype(np.int32).tobytes(), base.tobytes())

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, "home"):
            whole = next(r for r in group if r["tag"] == 2)["a"]
            n = len(whole) // sum(np.dtype(t).itemsize for _, t in SUMS)
            doc, at = {}, 0
            for name, t in SUMS:
                doc[name] = np.frombuffer(whole, t, n, at).copy()
                at += n * np.dtype(t).itemsize
            for r in group:
                if r["tag"] == 1:
                    some = np.frombuffer(r["a"], np.int32)
                    doc["n_known"][some] += np.frombuffer(r["b"], np.int32)
                    doc["base"][some] += np.frombuffer(r["c"], np.float64)
            ids = pa.array(doc["doc_id"], mask=doc["id_null"])
            for i in range(0, n, 10_000):
                cut = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([ids[cut], *(pa.array(doc[name][cut]) for name, _ in SUMS[2:])], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    known = vocabulary.select("part", F.lit(0).alias("tag"), F.lit(0).cast("long").alias("home"), F.col("hashes").alias("a"), F.col("counts").alias("b"), F.lit(b"").alias("c"))
    asked = held.mapInArrow(score, schema)
    met = known.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "tag").mapInArrow(meet, schema)
    closed = met.repartition(parts, "home").sortWithinPartitions("home").mapInArrow(close, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    total = frozen.value.code.total
    return closed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
