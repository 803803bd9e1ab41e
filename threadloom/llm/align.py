"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and pair counts over all documents.

Method. The tokens of both tokenizers are byte ranges of one text. Overlapping ranges are the
edges of a bipartite graph, and union-find over it gives its components: the smallest groups of
tokens of A and of B that cover the same bytes. Every pair of an A and a B token of one group is
a link. A pair's count is the number of documents that hold it linked.

A text is cut before each single space or line end between two characters that are no white
space. Neither tokenizer makes a token across such a place (the vocabularies are checked for it),
so a text's groups are those of its units, and each unit is encoded and united once, behind
a bounded memo. A task counts its documents' distinct pairs in blocks, and Spark adds the
blocks up. Counts come back by way of the distinct units: the links of each are joined with the
pairs' counts, and the documents' units with the units' sums. The most frequent pairs and units,
``hot`` of them at most, are broadcast, as they would else be hot keys; all others are shuffled.

Defined results: texts that are null, empty, or whose tokens don't spell a space and the text
(white space or signs that a tokenizer changes) have no tokens, zeros and an empty digest;
repeated rows and repeated or null ids are documents of their own; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import quoted, shared_dir
from threadloom.llm.textvec import release, slices

SLICE = 1 << 20  # bytes of text aligned at a time
MEMO = 400_000  # units that one worker keeps
LEARNT = 1 << 14  # units learnt at a time
TOGETHER = 1024  # units encoded as one text
BLOCK = 1 << 21  # distinct pairs that a task gathers before it hands them on
ROW = 1 << 15  # of these, in one row
OWNER_BITS = 20  # of a row within a slice
HOT = 1 << 18  # pairs or units that are broadcast at most

APART = re.compile(r"(?<=\S)(?=[ \n]\S)")
PLAIN = re.compile(r"[ \n][^ \n]*")
DOUBLE = re.compile(r"\s\s|\s\Z")
HEX = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the rule that such vocabularies share."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def united(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Root (the least member) of each of n nodes under the edges u-v: union-find with all edges hooked at once, then paths compressed."""
    parent = np.arange(n)
    while True:
        p, q = parent[u], parent[v]
        open_ = p != q
        if not open_.any():
            return parent
        u, v, p, q = u[open_], v[open_], p[open_], q[open_]
        low = np.minimum(p, q)
        np.minimum.at(parent, p, low)
        np.minimum.at(parent, q, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number, in order of the bytes, of the group of each token of A and of B, by the places where the tokens end in the same bytes.

    Between two neighbouring ends lies one token of either side: these pairs are the edges.
    """
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])[: len(ends)]]
    n = len(ends_a)
    root = united(n + len(ends_b), np.searchsorted(ends_a, ends), n + np.searchsorted(ends_b, ends))
    number = np.cumsum(root[:n] == np.arange(n)) - 1  # a group's root is its first token of A
    return number[root[:n]], number[root[n:]]


class Aligner:
    """Encodes texts with a byte-level BPE (A) and a sentence-piece BPE (B) and keeps what is known of their units."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode() for name in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := HEX.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces) or any(re.search(r"\S\s", t.decode("utf-8", "replace")) for t in self.bytes_a):
            raise ValueError("a token reaches over white space, so texts can't be cut into units")
        self.width = len(pieces)
        self.length_a, self.length_b = (np.asarray([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.spelled = [n + end for end in (",", "|", ";", "") for n in names]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.name: list[str] = []
        self.text: list[str] = []
        self.sums, self.met = np.empty((1 << 12, 4), np.int32), np.zeros(1 << 12, np.int32)
        self.sound = np.empty(1 << 12, bool)
        self.start, self.keys, self.used = np.zeros((1 << 12) + 1, np.int64), np.empty(1 << 14, np.int64), 0

    def thin_out(self, most: int) -> None:
        """Forget all units but those met most often, ``most`` of them at most; the times they were met count half from now on."""
        n = len(self.text)
        met = np.sort(self.met[:n])
        least = int(met[-most - 1]) + 1 if n > most else 0
        kept = np.flatnonzero(self.met[:n] >= least)
        held = self.sums[kept], self.sound[kept], self.met[kept] >> 1, self.links(kept)[0], [self.name[i] for i in kept.tolist()], [self.text[i] for i in kept.tolist()]
        self.forget()
        release()  # before the arrays grow again
        self._take(*held)

    @staticmethod
    def units(text: str) -> list[str]:
        """Units of a space and the text."""
        text = " " + text
        return APART.split(text) if DOUBLE.search(text) else PLAIN.findall(text)

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids; B adds a space itself, which is dropped before a text that opens with a line end."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without places, which take time
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        return np.asarray(a, np.int64), np.asarray(b, np.int64)

    def _spell(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw

    def _together(self, units: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of units, A's ids, B's ids) for units that may stand side by side, halved until both encodings spell them; a unit that they don't spell has no ids."""
        raw = "".join(units)
        a, b = self._ids(raw)
        if self._spell(a, b, raw.encode()):
            yield len(units), a, b
        elif len(units) == 1:
            yield 1, a[:0], b[:0]
        else:
            yield from self._together(units[: len(units) // 2])
            yield from self._together(units[len(units) // 2 :])

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of all units, how many each has, and B's likewise; units that not both encodings spell have none."""
        odd = [i for i, u in enumerate(units) if DOUBLE.search(u)] if DOUBLE.search("".join(units)) else []
        cuts = sorted({0, len(units), *range(0, len(units), TOGETHER), *odd, *(i + 1 for i in odd)})
        sizes = np.asarray([len(u.encode()) for u in units], np.int64)
        ids, counts, at = ([], []), ([], []), 0
        for i, j in zip(cuts, cuts[1:]):  # noqa: B905
            for n, *both in self._together(units[i:j]):
                ends = np.cumsum(sizes[at : at + n])
                for side, (x, lengths) in enumerate(zip(both, (self.length_a, self.length_b), strict=True)):
                    ids[side].append(x)
                    counts[side].append(np.diff(np.searchsorted(np.cumsum(lengths[x]), ends, "right"), prepend=0))
                at += n
        none = np.empty(0, np.int64)
        a, b = (np.concatenate([none, *x]) for x in ids)
        n_a, n_b = (np.concatenate([none, *x]) for x in counts)
        return a, n_a, b, n_b

    def align(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Which units are spelled by both, their numbers of tokens, groups and links (one row each), their groups as text, and all links in order."""
        a, n_a, b, n_b = self.encode(units)
        group_a, group_b = groups_of(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        groups = int(group_a[-1]) + 1 if len(a) else 0
        of_a, of_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        start_a, start_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        unit_a = np.repeat(np.arange(len(units)), n_a)
        unit = unit_a[start_a] if groups else np.empty(0, np.int64)  # of each group
        each = of_b[group_a]  # links of each token of A
        with_b = np.arange(each.sum()) + np.repeat(start_b[group_a] - (np.cumsum(each) - each), each)
        links = np.repeat(a, each) * self.width + b[with_b]
        sums = np.stack([n_a, n_b, np.bincount(unit, minlength=len(units)), np.bincount(unit_a, each, len(units)).astype(np.int64)], 1)
        # a token's name with what follows it, in the order of groups, A before B
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[start_a + of_a - 1], ends_b[start_b + of_b - 1] = True, True
        last = np.zeros(len(b), bool)
        if len(b):
            last[np.cumsum(n_b)[n_b > 0] - 1] = True
        names = np.empty(len(a) + len(b), np.int64)
        size = len(self.spelled) // 4
        names[np.arange(len(a)) + start_b[group_a]] = a + size * np.where(ends_a, 1, 0)
        names[np.arange(len(b)) + (start_a + of_a)[group_b]] = b + size * np.where(last, 3, np.where(ends_b, 2, 0))
        words, cut = list(map(self.spelled.__getitem__, names.tolist())), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        return n_a > 0, sums, ["".join(words[i:j]) for i, j in zip(cut, cut[1:])], links  # noqa: B905

    def learn(self, units: list[str]) -> None:
        sound, sums, texts, links = self.align(units)
        self._take(sums, sound, np.zeros(len(units), np.int32), links, units, texts)

    def _take(self, sums: np.ndarray, sound: np.ndarray, met: np.ndarray, links: np.ndarray, units: list[str], texts: list[str]) -> None:
        first, end = len(self.text), len(self.text) + len(units)
        if end > len(self.sound):
            more = max(end, len(self.sound) * 3 // 2)
            self.sums, self.sound, self.met, self.start = np.resize(self.sums, (more, 4)), np.resize(self.sound, more), np.resize(self.met, more), np.resize(self.start, more + 1)
        self.sums[first:end], self.sound[first:end], self.met[first:end] = sums, sound, met
        self.text += texts
        if self.used + len(links) > len(self.keys):
            self.keys = np.resize(self.keys, max(self.used + len(links), len(self.keys) * 3 // 2))
        self.keys[self.used : self.used + len(links)] = links
        self.start[first + 1 : end + 1] = self.used + np.cumsum(sums[:, 3], dtype=np.int64)
        self.used += len(links)
        self.name += units
        self.known.update(zip(units, range(first, end), strict=True))

    def links(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of numbered units, and which of the given units each belongs to."""
        n = self.start[units + 1] - self.start[units]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[units] - (ends - n), n)
        return self.keys[at], np.repeat(np.arange(len(units)), n)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


SUMS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, units array<string>, times array<int>, pairs array<long>, docs array<int>"
COLUMNS = [c.split()[0] for c in ALIGNED.split(", ")]


def _cut(values: pa.Array, sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


class Counts:
    """Distinct pairs of a task's documents, added up block by block."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > 4 * BLOCK:
            self._merge()

    def _merge(self) -> None:
        keys, n = np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        opens = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts, self.held = [(keys[opens], np.add.reduceat(n, opens))], len(opens)

    def rows(self, least: int) -> Iterator[pa.RecordBatch]:
        """Rows of pairs, once there are ``least`` of them."""
        if len(self.parts) > 1 and self.held > least:
            self._merge()
        if not self.held or self.held <= least:
            return
        for keys, n in self.parts:
            for at in range(0, len(keys), ROW):
                some = keys[at : at + ROW]
                arrays = {"pairs": _cut(pa.array(some), [len(some)]), "docs": _cut(pa.array(n[at : at + ROW].astype(np.int32)), [len(some)])}
                types = {"groups": pa.string(), "units": pa.list_(pa.string()), "times": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([arrays.get(c, pa.nulls(1, types.get(c, pa.int64()))) for c in COLUMNS], COLUMNS)
        self.parts, self.held = [], 0


def _counted(pairs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order, and the number of owners of each."""
    held = np.sort(pairs << OWNER_BITS | owner)
    pairs = held[np.concatenate([[True], held[1:] != held[:-1]])[: len(held)]] >> OWNER_BITS
    opens = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)])
    return pairs[opens], np.diff(np.concatenate([opens, [len(pairs)]]))


def _aligned(al: Aligner, doc_ids: pa.Array, texts: list[str | None], first_row: int, counts: Counts, digest: bool) -> pa.RecordBatch:
    split = [al.units(t) if t else [] for t in texts]
    fresh = [u for u in set(chain.from_iterable(split)) if u not in al.known]
    if len(al.known) + len(fresh) > MEMO:
        al.thin_out(MEMO // 2)
        fresh = [u for u in set(chain.from_iterable(split)) if u not in al.known]
    for i in range(0, len(fresh), LEARNT):
        al.learn(fresh[i : i + LEARNT])
    n = np.asarray([len(s) for s in split], np.int64)
    unit = np.fromiter(map(al.known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
    owner = np.repeat(np.arange(len(texts)), n)
    bad = np.bincount(owner[~al.sound[unit]], minlength=len(texts)) > 0
    unit, owner = unit[~bad[owner]], owner[~bad[owner]]
    sums = [np.bincount(owner, al.sums[unit, c], len(texts)).astype(np.int64) for c in range(4)]
    groups, numbers, at = [], unit.tolist(), np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for i in range(len(texts)):
        spelled = ";".join(map(al.text.__getitem__, numbers[at[i] : at[i + 1]]))
        groups.append(hashlib.sha256(spelled.encode()).hexdigest() if digest and spelled else spelled)
    both = np.sort(owner << 32 | unit)
    opens = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
    times, owner, unit = np.diff(np.concatenate([opens, [len(both)]])), both[opens] >> 32, both[opens] & 0xFFFFFFFF
    np.add.at(al.met, unit, 1)
    pairs, which = al.links(unit)
    counts.add(*_counted(pairs, owner[which]))
    sizes = np.bincount(owner, minlength=len(texts))
    names = pa.array(list(map(al.name.__getitem__, unit.tolist())), pa.string())
    rows = pa.array(first_row + np.arange(len(texts)))
    none = pa.nulls(len(texts), pa.list_(pa.int64())), pa.nulls(len(texts), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([rows, doc_ids, *map(pa.array, sums), pa.array(groups), _cut(names, sizes), _cut(pa.array(times.astype(np.int32)), sizes), *none], COLUMNS)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder in compressed form, and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _frequent(df: DataFrame, n: str, most: int) -> DataFrame:
    """``df`` with the column hot: among the rows of greatest ``n``, at most ``most`` of them. A histogram of a few hundred rows gives the bound."""
    level = F.floor(8 * F.log2(F.col(n).cast("double"))).cast("int")
    left, bound = most, 1 << 30
    for r in sorted(df.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        bound = r["level"]
    return df.withColumn("hot", level >= bound)


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``: its hot rows are broadcast, the others shuffled."""
    hot = F.broadcast(table.filter("hot").drop("hot"))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(table.filter("NOT hot").drop("hot"), key))


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (with units) and rows of pair counts (row is null) of ``docs``; groups as text or, with ``digest``, its SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, row, counts = aligner(path_a, path_b), TaskContext.get().partitionId() << 33, Counts()
        for batch in batches:
            for i, j in slices(batch, "text", SLICE):
                part = batch.slice(i, j - i)
                yield _aligned(al, part.column("doc_id"), part.column("text").to_pylist(), row, counts, digest)
                row += len(part)
                yield from counts.rows(BLOCK)
        yield from counts.rows(0)
        release()

    held = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    return held.mapInArrow(run, ALIGNED)


def unit_links(units: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(unit, n, pairs): the links of each distinct unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        for batch in batches:
            _, sums, _, links = al.align(batch.column("unit").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("n"), _cut(pa.array(links), sums[:, 3])], ["unit", "n", "pairs"])
        release()

    return units.select("unit", "n").mapInArrow(run, "unit string, n long, pairs array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): documents that hold each pair, from the rows of ``align``."""
    rows = aligned.filter("row IS NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    return rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, hot: int = HOT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of ``docs``.

    n_best: links whose count is the highest that their A token has with any B token.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    aligned = _kept(align(docs, path_a, path_b, digest, id_col, text), "aligned")
    counts = _kept(pair_counts(aligned), "pair-counts")
    a = F.expr(f"pair div {width}L").alias("a")
    highest = counts.groupBy(a).agg(F.max("n").alias("highest"))  # a row for each id of A at most
    counts = counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best"))
    held = aligned.filter("row IS NOT NULL")
    seen = held.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    units = _kept(unit_links(seen, path_a, path_b), "unit-links")
    links = units.select("unit", F.explode("pairs").alias("pair"))
    scored = _looked_up(links, _frequent(counts, "n", hot), "pair").groupBy("unit").agg(F.sum("n").alias("total"), F.sum("best").alias("best"))
    scores = _kept(scored.join(units.select("unit", "n"), "unit"), "unit-scores")
    met = held.select("row", F.explode(F.arrays_zip("units", "times")).alias("u")).select("row", F.col("u.units").alias("unit"), F.col("u.times").alias("times"))
    found = _looked_up(met, _frequent(scores, "n", hot).drop("n"), "unit")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.col("total")).alias("count_sum"), F.sum(F.col("times") * F.col("best")).alias("n_best"))
    filled = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return held.select("row", "doc_id", *SUMS, "groups").join(sums, "row", "left").select("doc_id", *SUMS, *filled, "groups")
