"""Benchmark decontamination by the q-gram lemma, with banded alignment as the verifier.

Texts are folded: lower case (ASCII and Latin-1), and one space for a run of ASCII characters
other than letters and digits, so that neither line ends nor decoration hide a passage. Each benchmark item
is covered by windows of ``window`` bytes, half a window apart (an item that is shorter is
one window). A document is contaminated by an item when some region of it is within the
window's edit budget, ``rate`` of its length.

By the lemma such a region shares at least w + 1 - q (budget + 1) of the window's q-grams,
and they lie on diagonals (place in the document less place in the item) no further apart
than the budget. So all shared q-grams are put in overlapping bands of diagonals, bands in
which enough of them lie within one window's length are kept, and each window there is
aligned inside its band by dynamic programming. Items under ``shortest`` bytes once folded must
occur as they are, from word border to word border; how many there are is logged.

The benchmark is dealt into blocks of about ``block_bytes`` by a hash of its ids; each block
is broadcast in turn and all documents are scanned against it, without a shuffle, so neither
a hot source nor a hot item changes a task's size.

Defined results: null and empty texts match nothing; an item without text, or of
which nothing is left once folded, is ignored; each row is judged by itself, so repeated rows
and null ids need nothing special; other columns are kept by ``clean``; empty tables on
either side give no matches.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize
from threadloom.llm.textvec import LOWER, slices, texts_of

GAP = np.array([not (c >= 0x80 or chr(c).isalnum()) for c in range(256)])
Q = 8
U = np.uint64
FILTER_BITS = 22
ZERO = 1 << 31  # added to diagonals, so that none is negative: places are below 2 GiB
log = logging.getLogger(__name__)


class Settings(NamedTuple):
    window: int = 100
    rate: float = 0.08
    shortest: int = 40
    block_bytes: int = 4 << 20


def fold(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and the place of each in ``text``."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][capital] += 0x20
    gap = GAP[data]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    at = np.flatnonzero(keep)
    out = np.where(gap, np.uint8(32), data)[at]
    return out, at


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each place, as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.empty(n, U)
    for off in range(min(Q, n)):
        m = (n - off + Q - 1) // Q
        out[off::Q] = np.frombuffer(data[off : off + Q * m].tobytes(), "<u8")
    return out


def _hash(g: np.ndarray) -> np.ndarray:
    return ((g * U(0x9E3779B97F4A7C15)) >> U(64 - FILTER_BITS)).astype(np.int64)


def within(window: bytes, region: bytes, budget: int) -> bool:
    """Is ``window`` at most ``budget`` edits from some part of ``region``?

    A column of the alignment's table is held as two whole numbers of a bit per row, the places
    where costs rise and fall, so a byte of the region takes a few operations on them.
    """
    m = len(window)
    if m <= budget:
        return True
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = {}
    for i, c in enumerate(window):
        equal[c] = equal.get(c, 0) | 1 << i
    rise, fall, cost, left = full, 0, m, len(region)
    for c in region:
        same = equal.get(c, 0)
        across = (((same & rise) + rise) ^ rise) | same
        up, down = fall | (full & ~(across | rise)), rise & across
        left -= 1
        if up & top:
            cost += 1
        elif down & top:
            cost -= 1
            if cost <= budget:
                return True
        if cost - left > budget:
            return False
        up, down, held = up << 1 & full, down << 1 & full, same | fall
        rise, fall = down | (full & ~(held | up)), up & held
    return False


def aligned(window: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Least edit distance of ``window`` to any part of ``region`` as (edits, start, end), None above ``budget``.

    ``region`` is the band's part of the document. Where the window stands as it is, or nothing is
    within the budget, no table is made; else each row of it is one vector operation, and a
    running minimum carries insertions along it.
    """
    m = len(region)
    as_is = region.tobytes().find(window.tobytes())
    if as_is >= 0:
        return 0, as_is, as_is + len(window)
    if not within(window.tobytes(), region.tobytes(), budget):
        return None
    place = np.arange(m + 1)
    cost, start = np.zeros(m + 1, np.int64), place.copy()
    for c in window:
        diagonal = cost[:-1] + (region != c)
        up = cost[1:] + 1
        best = np.concatenate([[cost[0] + 1], np.minimum(diagonal, up)])
        origin = np.concatenate([[start[0]], np.where(diagonal <= up, start[:-1], start[1:])])
        lead = best - place
        low = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == low, place, 0))
        cost, start = low + place, origin[source]
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(start[end]), end) if cost[end] <= budget else None


class Index:
    """q-grams of one block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], s: Settings):
        self.s = s
        self.ids, self.data, self.windows = [], [], []
        self.short: dict[bytes, dict[int, dict[bytes, list[int]]]] = {}  # by first word and length, each with a closing space
        self.n_short = 0
        keys, owner, place = [], [], []
        for item_id, text in items:
            data = fold(text)[0]
            data = data[int(data[:1].tobytes() == b" ") : len(data) - int(data[-1:].tobytes() == b" ")]
            if len(data) < max(s.shortest, Q):
                if len(data):
                    item = data.tobytes() + b" "
                    self.short.setdefault(item.split(b" ")[0], {}).setdefault(len(item), {}).setdefault(item, []).append(item_id)
                    self.n_short += 1
                continue
            w = min(s.window, len(data))
            starts = sorted({*range(0, len(data) - w + 1, max(1, w // 2)), len(data) - w})
            g = grams(data)
            self.windows.append((w, starts))
            keys.append(g)
            owner.append(np.full(len(g), len(self.ids)))
            place.append(np.arange(len(g)))
            self.ids.append(item_id)
            self.data.append(data)
        g = np.concatenate(keys) if keys else np.empty(0, U)
        order = np.argsort(g, kind="stable")
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g))
        self.owner, self.place = (np.concatenate(x)[order] if x else np.empty(0, np.int64) for x in (owner, place))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        with np.errstate(over="ignore"):
            self.filter[_hash(self.grams)] = True
        self.budget = [int(s.rate * w) for w, _ in self.windows]
        self.need = [max(1, w + 1 - Q * (b + 1)) for (w, _), b in zip(self.windows, self.budget, strict=True)]
        self.least, self.span = min(self.need, default=1), max((w + b - Q for (w, _), b in zip(self.windows, self.budget, strict=True)), default=0)

    def _dense(self, at: np.ndarray) -> np.ndarray:
        """Places in stretches no longer than a matching region that hold as many shared q-grams as one must."""
        k = self.least
        if len(at) < k:
            return at[:0]
        opens = at[k - 1 :] - at[: len(at) - k + 1] <= self.span
        if not opens.any():
            return at[:0]
        inside = np.zeros(len(at) + 1, np.int64)
        inside[: len(opens)] += opens
        inside[k : k + len(opens)] -= opens
        return at[np.cumsum(inside[:-1]) > 0]

    def matches(self, text: bytes) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, end, edits) of each item found; places are bytes of the text, edits those of the best window."""
        if not text or not (self.ids or self.short):
            return []
        data, back = fold(text)
        return self._exact(data, back) + self._edited(data, back)

    def _exact(self, data: np.ndarray, back: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Matches of the short items."""
        if not self.short:
            return []
        folded, at = data.tobytes() + b" ", 0
        found: dict[bytes, tuple[int, int]] = {}
        for word in folded.split(b" "):
            for n, items in self.short.get(word, {}).items():
                if (item := folded[at : at + n]) in items:
                    found[item] = (found.get(item, (at,))[0], at + n - 1)
            at += len(word) + 1
        ends = {item: (int(back[a]), int(back[b - 1]) + 1) for item, (a, b) in found.items()}
        return [(item_id, *ends[item], 0) for item in sorted(ends) for item_id in self.short[item.split(b" ")[0]][len(item)][item]]

    def _edited(self, data: np.ndarray, back: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Matches of the other items, by q-grams and alignment."""
        if not self.ids or len(data) < Q:
            return []
        g = grams(data)
        with np.errstate(over="ignore"):
            at = np.flatnonzero(self.filter[_hash(g)]) if len(g) else np.empty(0, np.int64)
        at = self._dense(at)
        if not len(at):
            return []
        slot = np.searchsorted(self.grams, g[at])
        good = (slot < len(self.grams)) & (self.grams[np.minimum(slot, len(self.grams) - 1)] == g[at])
        at, slot = at[good], slot[good]
        if len(at) < self.least:
            return []
        n = self.first[slot + 1] - self.first[slot]
        where = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner, place, at = self.owner[where], self.place[where], np.repeat(at, n)
        return self._verified(data, back, owner, at, place)

    def _verified(self, data: np.ndarray, back: np.ndarray, owner: np.ndarray, at: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
        width = 2 * (max(self.budget) + 1)
        diagonal = at - place + ZERO
        band = diagonal // (width // 2)
        # Bands are twice as wide as the step, so any diagonals a budget apart share one.
        owner, at, place = np.tile(owner, 2), np.tile(at, 2), np.tile(place, 2)
        band = np.concatenate([band, band - 1])
        key = owner.astype(np.int64) << 40 | band
        order = np.lexsort((place, key))
        key, owner, place, band = key[order], owner[order], place[order], band[order]
        cut = np.flatnonzero(np.diff(np.concatenate([[-1], key])))
        size = np.diff(np.append(cut, len(key)))
        need = np.asarray(self.need)[owner[cut]]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, n, k in zip(cut[size >= need].tolist(), size[size >= need].tolist(), need[size >= need].tolist(), strict=True):
            p, item = place[i : i + n], int(owner[i])
            w, starts = self.windows[item]
            if not (p[k - 1 :] - p[: n - k + 1] <= w - Q).any():
                continue
            low = int(band[i]) * (width // 2) - ZERO
            budget = self.budget[item]
            places = np.asarray(starts)
            enough = np.searchsorted(p, places + w - Q, "right") - np.searchsorted(p, places) >= k
            for s in places[enough].tolist():
                a, b = max(0, s + low - budget), min(len(data), s + w + low + width + budget)
                if b > a and (hit := aligned(self.data[item][s : s + w], data[a:b], budget)):
                    found.setdefault(item, []).append((hit[0], a + hit[1], a + hit[2]))
        return [(self.ids[item], int(back[min(x[1] for x in hits)]), int(back[max(x[2] for x in hits) - 1]) + 1, min(x[0] for x in hits)) for item, hits in sorted(found.items())]


def _indexes(benchmark: DataFrame, item: str, text: str, s: Settings) -> Iterator[tuple[Index, bool]]:
    """One index per block of the benchmark, each of bounded size, and whether it is the last."""
    held = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    total = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // s.block_bytes)
    n_short = 0
    for b in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        index = Index([(r["item_id"], r["text"].encode()) for r in rows], s)
        n_short += index.n_short
        yield index, b == blocks - 1
    log.info("%d benchmark items are under %d bytes once folded and looked up as they are", n_short, s.shortest)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, item_id, start, end, edits): a row for each document and item found in it; places are bytes of its text."""
    spark = docs.sparkSession
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits long"
    out = spark.createDataFrame([], schema)
    for index, _ in _indexes(benchmark, item, item_text, settings):
        sent = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j in slices(batch, "text"):
                    part = batch.slice(i, j - i)
                    rows = [(d, *m) for d, t in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text")), strict=True) for m in sent.value.matches(t)]
                    columns = list(zip(*rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "edits"])

        out = out.unionByName(held.mapInArrow(scan, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` without contaminated rows, in all their columns.

    Where the benchmark has several blocks, what each leaves is written to the shared folder, so
    that a task holds one block at a time.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # Spark asks for columns by name, which a dot in one would break
    docs, place = docs.toDF(*plain), names.index(text)
    for index, last in _indexes(benchmark, item, item_text, settings):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j in slices(batch, plain[place]):
                    part = batch.slice(i, j - i)
                    yield part.filter(pa.array([not sent.value.matches(t) for t in texts_of(part.column(place))], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
        if not last:
            docs = materialize(docs, "clean")
            sent.unpersist()
    return docs.toDF(*names)
