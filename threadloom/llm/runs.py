"""Periodic runs of words: branching tandem repeats from a suffix tree, rotated and merged into maximal runs.

Method. Of a stretch of words all suffixes are sorted; the intervals of suffixes that share a
prefix are the inner nodes of its suffix tree, each with its depth. At a node of depth D two
suffixes from different children, D words apart, are a branching tandem repeat: a word sequence
of length D twice in a row that can't be shifted one to the right. Only the leaves of the
smaller part of a node are listed (each time as one range of the sorted suffixes) and looked
up in the other part, in either direction, so all nodes together list n log n leaves. Every
maximal run ends in exactly one branching repeat of its period; rotating that to the left, word
by word, gives the run. Of repeats with one end the shorter period comes first, and a
multiple of it inside the same run is merged with it.

Only words that a wanted run can hold enter the tree: a run of at least ``least`` words and
``times`` periods repeats each window of some words (16 for 24 and 3) one period further on in
the same text, so windows that stand once in their text end a stretch. The windows are found by
hashes, the tree compares words themselves; a collision only makes a stretch longer.

Defined results: null and empty texts have no words and no runs and collapse to the empty text;
a text's words stand joined by single spaces when collapsed; repeated rows and repeated or null
ids are judged row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import quoted
from threadloom.llm.textvec import mix, release, slices

U = np.uint64
SLICE = 1 << 21  # bytes of text looked at together
LEAVES = 1 << 20  # leaves listed together
STEP = U(0xC2B2AE3D27D4EB4F)


def window_of(least: int, times: int) -> int:
    """Words that any wanted run repeats one period further on, at least."""
    return min(least - least // times, (times - 1) * -(-least // times))


def stretches(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """(start, end) rows of the stretches of words covered by windows that stand twice in their text; ``h``: hashes of all words, ``starts``: of each text, and the end."""
    n = len(h) - window + 1
    if n < 2:
        return np.empty((0, 2), np.int64)
    with np.errstate(over="ignore"):
        key, at, power, width = np.zeros(n, np.uint64), 0, mix(h), 1
        while width <= window:
            if window & width:
                key, at = mix(key * STEP + power[at : at + n]), at + width
            if 2 * width <= window:
                power = mix(power[: len(power) - width] * STEP + power[width:])
            width *= 2
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        inside = owner[:n] == owner[window - 1 :]
        key = mix(key + owner[:n].astype(np.uint64) * STEP)
    held = np.sort(key[inside])
    twice = np.unique(held[1:][held[1:] == held[:-1]])
    if not len(twice):
        return np.empty((0, 2), np.int64)
    near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    at = np.flatnonzero(inside & (twice[near] == key))
    cover = np.cumsum(np.bincount(at, minlength=len(h) + 1) - np.bincount(at + window, minlength=len(h) + 1))[: len(h)] > 0
    cut = np.zeros(len(h) + 1, bool)
    cut[starts] = True
    before = np.concatenate([[False], cover])
    after = np.concatenate([cover, [False]])
    return np.stack([np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))], 1)


def suffix_tree(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes, each suffix's place among them, and the depth shared with the one before. The symbols end in one of their own."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
    n, levels = len(rank), [rank]
    while rank.max() < n - 1:
        width = 1 << (len(levels) - 1)
        behind = np.concatenate([rank[width:].astype(np.int64) + 1, np.zeros(min(width, n), np.int64)])
        rank = np.unique(rank.astype(np.int64) * (n + 1) + behind, return_inverse=True)[1].astype(np.int32)
        levels.append(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    depth, i, j = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = (np.maximum(i, j) < n) & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        step = same.astype(np.int64) << k
        depth[1:] += step
        i, j = i + step, j + step
    return order, rank, depth


def nodes(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k: the first leaf of the part before it and the end of the part from it on, of the node whose depth stands at k (nodes of many children are joined child by child)."""
    values = [*depth.tolist(), -1]
    n = len(values) - 1
    left, right, open_ = [0] * n, [n] * n, [0]
    values[0] = -1
    for k in range(1, n + 1):
        d = values[k]
        while len(open_) > 1 and values[open_[-1]] >= d:
            right[open_.pop()] = k
        if k < n:
            left[k] = open_[-1]
            open_.append(k)
    return np.asarray(left), np.asarray(right)


def branching(symbols: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats whose period is at most ``most`` (by symbol) where they start."""
    order, rank, depth = suffix_tree(symbols)
    left, right = nodes(depth)
    k = np.flatnonzero((depth > 0) & (depth <= most[order]))
    k = k[k > 0]
    first = k - left[k] <= right[k] - k
    lo, hi = np.where(first, left[k], k), np.where(first, k, right[k])
    other_lo, other_hi = np.where(first, k, left[k]), np.where(first, right[k], k)
    size, found = hi - lo, []
    ends = np.cumsum(size)
    a = 0
    while a < len(k):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LEAVES, "right")))
        node = np.repeat(np.arange(a, b), size[a:b])
        leaf = order[np.arange(len(node)) + np.repeat(lo[a:b] - (ends[a:b] - size[a:b] - (ends[a - 1] if a else 0)), size[a:b])]
        d = depth[k[node]]
        for partner, start in ((leaf + d, leaf), (leaf - d, leaf - d)):
            ok = (partner >= 0) & (partner < len(order))
            at = np.zeros(len(leaf), np.int64)
            at[ok] = rank[partner[ok]]
            ok &= (at >= other_lo[node]) & (at < other_hi[node])
            found.append(np.stack([start[ok], d[ok]]))
        a = b
    both = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    return both[0], both[1]


def _reach(symbols: np.ndarray, i: int, d: int) -> int:
    """How many words before ``i`` equal the word ``d`` further on, without a gap."""
    done, size = 0, 64
    while done < i:
        n = min(size, i - done)
        a = i - done - n
        differ = np.flatnonzero(symbols[a : a + n] != symbols[a + d : a + d + n])
        if len(differ):
            return done + n - 1 - int(differ[-1])
        done, size = done + n, 2 * size
    return done


def maximal_runs(symbols: np.ndarray, most: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all wanted runs."""
    i, d = branching(symbols, most)
    need = np.maximum(least, times * d) - 2 * d
    for t in range(1, max(1, least - 2 * (least // times)) + 1):
        ok = (need < t) | ((i >= t) & (symbols[i - t] == symbols[np.maximum(i - t, 0) + d]))
        i, d, need = i[ok], d[ok], need[ok]
    order = np.lexsort((d, i + 2 * d))
    out, last_end, held = [], -1, 0
    for start, period in zip(i[order].tolist(), d[order].tolist(), strict=True):
        end = start + 2 * period
        if end == last_end and held >= 2 * period:
            continue
        length = 2 * period + _reach(symbols, start, period)
        last_end, held = end, max(length, held) if end == last_end else length
        if length >= max(least, times * period):
            out.append((end - length, length, period))
    return sorted(set(out))


def runs_of_texts(texts: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text (given as words), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(starts[-1])).view(np.uint64)
    parts = stretches(h, starts, window_of(least, times))
    parts = parts[parts[:, 1] - parts[:, 0] >= least]
    if not len(parts):
        return out
    owner = np.searchsorted(starts, parts[:, 0], "right") - 1
    symbols, known = [], 0
    for t, (a, b) in zip(owner.tolist(), (parts - starts[owner][:, None]).tolist(), strict=True):
        seen: dict[bytes, int] = {}
        symbols += [known + seen.setdefault(w, len(seen)) for w in texts[t][a:b]]
        known += len(seen) + 1
        symbols.append(known - 1)  # an end of its own
    length = parts[:, 1] - parts[:, 0]
    base = np.cumsum(length + 1) - length - 1
    for a, length_, period in maximal_runs(np.asarray(symbols, np.int64), np.repeat(length // times, length + 1), least, times):
        s = int(np.searchsorted(base, a, "right")) - 1
        t = int(owner[s])
        out[t].append((int(a - base[s] + parts[s, 0] - starts[t]), length_, period))
    return [sorted(r) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [w for w, gone in zip(words, np.cumsum(drop).tolist()) if not gone]  # noqa: B905
    return b" ".join(words)


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): all runs of each whole text's words, by start and period, and the text without their repeats. No shuffle."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    lists = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, "text", SLICE):
                part = batch.slice(i, j - i)
                texts = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]
                runs = runs_of_texts(texts, least, times)
                rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], lists)
                short = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, short.cast(pa.string())], ["doc_id", "runs", "collapsed"])
        release()

    held = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    return held.mapInArrow(find, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli) and the digests of all runs and of the collapsed text."""

    def before(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        ties = F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
        return F.when(x > y, -1).when(x < y, 1).otherwise(ties.cast("int"))

    best = F.get(F.array_sort("runs", before), 0)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    held = found.select("doc_id", "runs", best.alias("best"), "collapsed")
    return held.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
