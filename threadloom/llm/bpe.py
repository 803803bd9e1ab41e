"""Byte-level BPE by prefix dynamic programming: exact encoding, appends, edits, and decoding.

Method. A sequence of tokens is the one that merging by rank gives if and only if every two
neighbours are: merged on their own, the bytes of the two end as just these two. So each byte
prefix of a piece has exactly one last token that stands validly behind the last token of the
prefix before it. The table of these last tokens is filled from left to right; reading it
backwards from the end gives the ids. A longer text only adds entries, and after an edit the
entries from there on are worked out until they agree with the old ones over the length of the
longest token, so neither starts from the beginning (``Table``, ``Encoded``).

Two neighbours are checked by undoing their merges, the latest first: whenever the parts that
touch at the border could themselves merge before the merge that was just undone, the pair
doesn't stand. All new pieces of a slice of texts go through the table together, one byte
place after the other (``Vocabulary.encode_all``); pieces of over ``WIDE`` bytes go singly.
A bounded memo keeps the ids of pieces seen before.

Defined results: a null text counts as empty; an empty text has no ids; special tokens' names
are ordinary text; repeated rows and repeated or null ids are encoded row by row; an empty
table gives no rows; other columns, whatever their names, are ignored by ``encoded_documents``.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import quoted
from threadloom.llm.textvec import mix, release, slices

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
NEVER = 1 << 40  # later than any merge
WIDE = 32  # bytes of the longest piece that is encoded together with others
MEMO = 300_000  # pieces in each of the memo's two generations
SLICE = 1 << 21  # bytes of text encoded at a time


class Lookup:
    """Values of 64-bit keys by vector operations: tables of slots, each for the keys that found theirs taken in the one before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        keys, values = np.asarray(keys, np.uint64), np.asarray(values, np.int32)
        while len(keys):
            bits = max(4, len(keys).bit_length() + 2)
            slot = self._slot(keys, len(self.levels), bits)
            _, first, n = np.unique(slot, return_index=True, return_counts=True)
            held, value, shared = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
            held[slot[first]], value[slot[first]], shared[slot[first]] = keys[first], values[first], n > 1
            self.levels.append((held, value, shared, bits))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys + U(level)) * U(0xD6E8FEB86659FD93 + 2 * level) >> U(64 - bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none."""
        out, left = np.full(len(keys), -1, np.int64), None
        for level, (held, value, shared, bits) in enumerate(self.levels):
            slot = self._slot(keys, level, bits)
            hit = held[slot] == keys
            at = np.flatnonzero(hit)
            out[at if left is None else left[at]] = value[slot[at]]
            rest = np.flatnonzero(shared[slot] & ~hit)
            left, keys = rest if left is None else left[rest], keys[rest]
            if not len(left):
                break
        return out


def merged(piece: bytes, ranks: dict[bytes, int], parts: int = 1) -> list[bytes]:
    """Merge the pair of least rank, the leftmost first, until none can or ``parts`` are left."""
    held = [piece[i : i + 1] for i in range(len(piece))]
    while len(held) > parts:
        rank, at = min((ranks.get(held[i] + held[i + 1], NEVER), i) for i in range(len(held) - 1))
        if rank == NEVER:
            break
        held[at : at + 2] = [held[at] + held[at + 1]]
    return held


class Vocabulary:
    """Ranks of a tiktoken file, how each token came about, and which pairs of neighbours stand."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds all 256 bytes")
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.bytes = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, self.ranks))
        self.first, self.second = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)  # when it is merged; -1 for bytes
        self.sound = np.zeros(size, bool)  # merging its own bytes ends in the token
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.sound[rank] = True
                continue
            two = merged(token, self.ranks, 2)
            if len(two) == 2:
                self.sound[rank], self.made[rank] = True, rank
                self.first[rank], self.second[rank] = self.ranks[two[0]], self.ranks[two[1]]
        joins = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = np.asarray(joins, np.int64).reshape(-1, 3).T
        self.join = Lookup(a.astype(np.uint64) << U(32) | b.astype(np.uint64), r)
        self.joined = {(x, y): z for x, y, z in joins}
        names = sorted((len(t), t, r) for t, r in self.ranks.items() if self.sound[r])
        self.token = Lookup(np.concatenate([self._hashes([t for _, t, _ in group]) for group in _by_length(names)]), np.asarray([r for _, _, r in names]))
        self.parts = (self.first.tolist(), self.second.tolist(), self.made.tolist())
        self.pairs: dict[tuple[int, int], bool] = {}
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _hashes(pieces: list[bytes]) -> np.ndarray:
        """Hashes of pieces of one length."""
        data = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)
        h = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for column in data.T:
                h = h * BASE + column + U(1)
            return mix(h)

    def stands(self, a: int, b: int) -> bool:
        """Merging the bytes of ``a`` and ``b`` together ends in these two."""
        known = self.pairs.get((a, b))
        if known is None:
            first, second, made = self.parts
            x, y, until, known = a, b, NEVER, True
            while True:
                if self.joined.get((x, y), NEVER) < until:
                    known = False
                    break
                if made[x] < 0 and made[y] < 0:
                    break
                if made[x] > made[y]:
                    until, x = made[x], second[x]
                else:  # of equal merges the left one is done first, and so undone last
                    until, y = made[y] + 1, first[y]
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stands`` for many pairs."""
        out = np.ones(len(a), bool)
        left, x, y, until = np.arange(len(a)), a, b, np.full(len(a), NEVER)
        while len(left):
            met = self.join(x.astype(np.uint64) << U(32) | y.astype(np.uint64))
            bad = (met >= 0) & (met < until)
            out[left[bad]] = False
            on = ~bad & ((self.made[x] >= 0) | (self.made[y] >= 0))
            left, x, y = left[on], x[on], y[on]
            mx, my = self.made[x], self.made[y]
            undo = mx > my
            until = np.where(undo, mx, my + 1)
            x, y = np.where(undo, self.second[x], x), np.where(undo, y, self.first[y])
        return out

    def encode_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece (not empty): the tables of all of them are filled side by side."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        some = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = (whole,)
            elif len(p) > WIDE:
                out[i] = tuple(Table(self, p).ids())
            else:
                some.append(i)
        if not some:
            return out
        some.sort(key=lambda i: -len(pieces[i]))
        n = np.asarray([len(pieces[i]) for i in some])
        wide = int(n[0])
        data = np.frombuffer(b"".join(pieces[i].ljust(wide, b"\0") for i in some), np.uint8).reshape(len(some), wide)
        last, size = np.full((wide + 1, len(some)), -1, np.int64), np.zeros((wide + 1, len(some)), np.int64)
        with np.errstate(over="ignore"):
            prefix = np.zeros((wide + 1, len(some)), np.uint64)
            powers = np.cumprod(np.concatenate([[U(1)], np.full(wide, BASE)]), dtype=np.uint64)
            for e in range(wide):
                prefix[e + 1] = prefix[e] * BASE + data[:, e] + U(1)
            for e in range(1, wide + 1):
                open_ = np.arange(np.searchsorted(-n, -e, "right"))
                for k in range(min(e, self.longest), 0, -1):
                    token = self.token(mix(prefix[e, open_] - prefix[e - k, open_] * powers[k]))
                    at = np.flatnonzero(token >= 0)
                    if not len(at):
                        continue
                    if e > k:
                        at = at[self.stand(last[e - k, open_[at]], token[at])]
                    last[e, open_[at]], size[e, open_[at]] = token[at], k
                    rest = np.ones(len(open_), bool)
                    rest[at] = False
                    open_ = open_[rest]
                    if not len(open_):
                        break
        ends, where, rows = n.copy(), np.arange(len(some)), []
        while len(where):
            rows.append((where, last[ends[where], where]))
            ends[where] -= size[ends[where], where]
            where = where[ends[where] > 0]
        owner, ids = np.concatenate([w for w, _ in rows][::-1]), np.concatenate([t for _, t in rows][::-1])
        order = np.argsort(owner, kind="stable")
        ids, cuts = ids[order].tolist(), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(some)))]).tolist()
        for j, i in enumerate(some):
            out[i] = tuple(ids[cuts[j] : cuts[j + 1]])
        return out

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text: every match of the pattern for itself, those not met lately through the tables."""
        split = [self.pattern.findall(t) for t in texts]
        met: dict[str, tuple[int, ...]] = {}
        for p in set(chain.from_iterable(split)):
            met[p] = self.new.get(p) or self.old.get(p) or ()
        self.new.update((p, ids) for p, ids in met.items() if ids)
        fresh = [p for p, ids in met.items() if not ids]
        found = dict(zip(fresh, self.encode_all([p.encode() for p in fresh]), strict=True))
        met.update(found)
        self.new.update((p, ids) for p, ids in found.items() if len(p) <= WIDE)
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        return [list(chain.from_iterable(map(met.__getitem__, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _by_length(names: list[tuple[int, bytes, int]]) -> Iterator[list[tuple[int, bytes, int]]]:
    lengths = [n for n, _, _ in names]
    for n in sorted(set(lengths)):
        a = bisect_left(lengths, n)
        yield names[a : bisect_left(lengths, n + 1)]


class Table:
    """The last token of every byte prefix of one piece; grows by ``append``, changes by ``edit``."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> int:
        """Number of entries worked out: the new bytes' only."""
        self.piece += more
        return self._fill(len(self.piece) - len(more))

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace ``removed`` bytes at ``at``; entries before stay, those behind are worked out until they agree with the old ones."""
        old, self.last = self.last, self.last[:at]
        self.piece = self.piece[:at] + inserted + self.piece[at + removed :]
        return self._fill(at, old, removed - len(inserted), at + len(inserted))

    def _fill(self, start: int, old: list[int] = (), shift: int = 0, behind: int = NEVER) -> int:
        """Work out entries from ``start`` on (entry i: prefix of i + 1 bytes). From ``behind`` on the bytes are the old ones, which stood ``shift`` further."""
        v, piece, last, agree = self.vocabulary, self.piece, self.last, 0
        for i in range(start, len(piece)):
            for k in range(min(i + 1, v.longest), 0, -1):
                token = v.ranks.get(piece[i + 1 - k : i + 1])
                if token is not None and v.sound[token] and (k > i or v.stands(last[i - k], token)):
                    last.append(token)
                    break
            if i >= behind:
                agree = agree + 1 if old[i + shift] == last[i] else 0
                if agree >= v.longest:
                    last.extend(old[i + 1 + shift :])
                    return i + 1 - start
        return len(piece) - start

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.piece)
        if whole is not None:
            return [whole]
        out, e = [], len(self.piece)
        while e:
            out.append(self.last[e - 1])
            e -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Encoded:
    """A text's pieces with their tables, for edits anywhere: only pieces that an edit can change are matched and encoded again."""

    AHEAD = 2  # characters behind a match that can decide where it ends

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.vocabulary, self.text = vocabulary, text
        pieces = vocabulary.pattern.findall(text)
        self.tables = [Table(vocabulary, p.encode()) for p in pieces]
        self.ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Replace ``removed`` characters at ``at``; number of table entries worked out."""
        shift, old_ends = removed - len(inserted), self.ends
        self.text = self.text[:at] + inserted + self.text[at + removed :]
        first = int(np.searchsorted(old_ends, at - self.AHEAD, "right"))
        start, stop, pieces, ends = int(old_ends[first - 1]) if first else 0, len(old_ends), [], []
        for m in self.vocabulary.pattern.finditer(self.text, start):
            pieces.append(m.group().encode())
            ends.append(m.end())
            if m.end() >= at + len(inserted):
                j = int(np.searchsorted(old_ends, m.end() + shift))
                if j < len(old_ends) and old_ends[j] == m.end() + shift:
                    stop = j + 1
                    break
        fresh, worked = [], 0
        for i, piece in enumerate(pieces):
            if i == 0 and first < stop:
                table = self.tables[first]
                worked += self._changed(table, piece)
            else:
                table = Table(self.vocabulary, piece)
                worked += len(piece)
            fresh.append(table)
        self.tables[first:stop] = fresh
        self.ends = np.concatenate([old_ends[:first], np.asarray(ends, np.int64), old_ends[stop:] - shift])
        return worked

    @staticmethod
    def _changed(table: Table, piece: bytes) -> int:
        old, same = table.piece, 0
        most = min(len(old), len(piece))
        while same < most and old[same] == piece[same]:
            same += 1
        tail = 0
        while tail < most - same and old[-1 - tail] == piece[-1 - tail]:
            tail += 1
        return table.edit(same, len(old) - same - tail, piece[same : len(piece) - tail])

    def append(self, more: str) -> int:
        return self.edit(len(self.text), 0, more)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(t.ids() for t in self.tables))


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker and file."""
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = Vocabulary(path, pattern)
    return _VOCABULARIES[path, pattern]


def encoded_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): each whole text's ids and the bytes that they stand for. No shuffle; a slice of texts at a time."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for i, j in slices(batch, "text", SLICE):
                part = batch.slice(i, j - i)
                ids = v.encode_texts([t or "" for t in part.column("text").to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.fromiter(chain.from_iterable(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array([v.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])
        release()

    held = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    return held.mapInArrow(encode, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows of ``encoded_documents``."""
    ids = F.sha2(F.array_join("ids", " ").cast("binary"), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def edited(edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, worked) of rows (doc_id, text, at, removed, inserted): the edited text's ids and the table entries that the edit cost.

    Places and lengths count characters; those beyond the text's end are cut back to it. Nulls count as empty texts and zeros.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                held = Encoded(v, r["text"] or "")
                at = min(max(r["at"] or 0, 0), len(held.text))
                worked = held.edit(at, min(max(r["removed"] or 0, 0), len(held.text) - at), r["inserted"] or "")
                rows.append({"doc_id": r["doc_id"], "ids": held.ids(), "worked": worked})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("worked", pa.int64())]))

    held = edits.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("at").cast("int"), F.col("removed").cast("int"), F.col("inserted").cast("string"))
    return held.mapInArrow(encode, "doc_id long, ids array<int>, worked long")
