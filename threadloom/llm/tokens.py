"""Token ids: exact encoding with a public tokenizer, ORC output, and packing.

Encoding. Both supported tokenizers split a text at single spaces and line ends before they
merge anything, so a text without two white-space characters in a row is encoded word by word
with a bounded memo of words already seen; new words, and whole texts where the rule doesn't
hold, go to the tokenizers library. The ids are those of encoding the text at once.

ORC output. Documents are dealt by ranges of their id, sorted, and encoded inside the range;
each task writes one file with integer run-length encoding, row indexes and a Bloom filter on
doc_id, so a reader can take stripes in parallel and skip those that can't hold an id. Token
places are sums in two levels: within a file while writing, and over files (one number each).

Packing. Each document is cut into pieces of power-of-two lengths (of 4096 as often as it
goes, then the binary digits of the rest, longest first); a piece is a sequence of its own
and sequences of one length form a bucket, so nothing is padded and none crosses documents.

Defined results: null text counts as empty, and an empty text is the end id alone; repeated
rows and repeated ids are encoded one by one (equal ids in the order of their texts); a null
id sorts first; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from string import punctuation as PUNCTUATION

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import shared_dir
from threadloom.llm.textvec import mix, release, slices, texts_of
from threadloom.llm.textvec import words as hashed_words

END_ID = 2
MEMO = 1_000_000  # words that one worker keeps, in some 40 bytes each
RECENT = 60_000  # of these, words not yet sorted in
SLICE = 3 << 17  # bytes of text encoded at a time


WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True
#: Bytes that open a white-space character outside ASCII (or another character).
WIDE = np.zeros(256, bool)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the number of each key among them."""
    order = np.argsort(keys)
    held = keys[order]
    opens = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.empty(0, bool)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(opens) - 1
    return held[opens], order[opens], inverse


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after another, and how many each has."""
    return np.concatenate(ids), np.asarray([len(x) for x in ids], np.int64)


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes, without an end id.

    Words are told apart by 64-bit hashes worked out over all bytes of a batch at once. The
    memo maps a word's hash to its ids' place in one flat array, so that the ids of a batch
    are gathered in a few vector operations; only words not seen before are looked at singly.
    """

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.edges = np.asarray([n.startswith("\u0120") if keeps_space else n.endswith("</w>") for n in names])
        self.gap = np.zeros(256, bool)
        self.gap[[0x20, 0x0A] if keeps_space else [0x20, 0x0A, 0x09]] = True
        self.odd = re.compile(r"\s\s|\s\Z")
        self.prefixes = ("", " ", "\n") if keeps_space else ("",)
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.recent: dict[int, int] = {}
        self.start, self.length, self.flat = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), np.empty(1 << 18, "<u4")
        self.again = np.zeros(1 << 16, bool)
        self.used = self.known = 0

    def _forget(self, most: int) -> None:
        """Keep, of the words met again since the last time, the ``most`` latest; most words of a corpus are never met again."""
        self._sort_in()
        kept = np.flatnonzero(self.again[: self.known])[-most:]
        number = np.full(self.known, -1, np.int32)
        number[kept] = np.arange(len(kept))
        here = number[self.place] >= 0
        self.keys, self.place = self.keys[here], number[self.place[here]]
        self.flat = self._joined(kept)
        length = self.length[kept]
        self.start, self.length = np.cumsum(length, dtype=np.int64) - length, length
        self.again = np.zeros(len(kept), bool)
        self.used, self.known = len(self.flat), len(kept)

    def _joined(self, where: np.ndarray) -> np.ndarray:
        """Ids of words, given by their numbers, one after another."""
        n = self.length[where].astype(np.int64)
        done = np.cumsum(n)
        return self.flat[np.repeat(self.start[where] - done + n, n) + np.arange(done[-1] if len(done) else 0)]

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's word, -1 for new words."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.place[at[hit]]
        if self.recent:
            left = np.flatnonzero(out < 0)
            out[left] = [self.recent.get(k, -1) for k in keys[left].tolist()]
        return out

    def _sort_in(self) -> None:
        keys = np.concatenate([self.keys, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
        place = np.concatenate([self.place, np.fromiter(self.recent.values(), np.int32, len(self.recent))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.place, self.recent = keys[order], place[order], {}

    def _fresh(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh_words(self, words: list[str], prefix: str) -> list[np.ndarray]:
        """Ids of words of letters, which the tokenizer keeps apart, from one text of them all, cut at the tokens that open or close a word."""
        if len(words) < 8 or (self.keeps_space and prefix != " "):
            return self._fresh([prefix + w for w in words])
        ids = self._fresh([" ".join(["", *words]) if self.keeps_space else " ".join(words)])[0]
        edge = np.flatnonzero(self.edges[ids])
        cuts = edge if self.keeps_space else np.concatenate([[0], edge[:-1] + 1])
        if len(cuts) != len(words):
            return self._fresh([prefix + w for w in words])
        cuts = [*cuts.tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def _add(self, keys: list[int], ids: np.ndarray, n: np.ndarray) -> None:
        """New words by key, their ids one after another, and how many each has."""
        first, end, last = self.known, self.used + len(ids), self.known + len(keys)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(end, "<u4")])
        if last > len(self.start):
            self.start, self.length, self.again = (np.concatenate([x, np.zeros(last, x.dtype)]) for x in (self.start, self.length, self.again))
        self.flat[self.used : end] = ids
        self.start[first:last] = self.used + np.cumsum(n) - n
        self.length[first:last] = n
        self.again[first:last] = False
        self.recent.update(zip(keys, range(first, last), strict=True))
        self.used, self.known = end, last

    def _learn(self, keys: list[int], words: list[str], kinds: list[int]) -> None:
        """A word of letters with ASCII marks behind it is the word's ids and the marks'; the word alone is looked up, and learned, too."""
        for kind, prefix in enumerate(self.prefixes):
            cores, tails, marked, others = {}, {}, [], []  # cores and tails are numbered
            for key, word, own in zip(keys, words, kinds, strict=True):
                if own == kind:
                    core = word.rstrip(PUNCTUATION)
                    if not core.isalpha():
                        others.append((key, word))
                        continue
                    number = cores.setdefault(core, len(cores))
                    if core != word:
                        tail = word[len(core) :]
                        marked.append((key, number, tails.setdefault(tail, len(tails))))
            if cores:
                names = list(cores)
                named = mix(hashed_words(np.frombuffer((" ".join(names) + " ").encode(), np.uint8), self.gap)[2] + np.uint64(kind))
                place = self._places(named)
                self.again[place[place >= 0]] = True
                fresh = np.flatnonzero(place < 0)
                if len(fresh):
                    place[fresh] = self.known + np.arange(len(fresh))
                    self._add(named[fresh].tolist(), *_flat(self._fresh_words([names[i] for i in fresh.tolist()], prefix)))
            if marked:
                new, core, tail = zip(*marked, strict=True)
                marks, n = _flat(self._fresh(list(tails)))
                tail, where = np.asarray(tail), place[np.asarray(core)]
                size, behind = self.length[where].astype(np.int64), n[tail]
                whole = np.empty(int((size + behind).sum()), "<u4")
                is_mark = np.repeat(np.tile([False, True], len(new)), np.stack([size, behind], 1).ravel())
                whole[~is_mark] = self._joined(where)
                starts = np.cumsum(n) - n
                whole[is_mark] = marks[np.repeat(starts[tail] - np.cumsum(behind) + behind, behind) + np.arange(behind.sum())]
                self._add(list(new), whole, size + behind)
            if others:
                self._add([k for k, _ in others], *_flat(self._fresh([prefix + w for _, w in others])))

    def _gathered(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts in which words and single gaps take turns."""
        if not texts:
            return []
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        begin, end, h = hashed_words(data, self.gap)
        kind = np.zeros(len(begin), np.int64)
        if self.keeps_space and len(begin):
            kind[1:] = np.where(data[begin[1:] - 1] == 0x0A, 2, 1)
            kind[0] = 0 if begin[0] == 0 else 2 if data[begin[0] - 1] == 0x0A else 1
            opening = np.minimum(np.searchsorted(begin, starts[:-1]), len(begin) - 1)
            kind[opening[begin[opening] == starts[:-1]]] = 0
        keys, first, inverse = _distinct(mix(h + kind.astype(np.uint64)))
        place = self._places(keys)
        self.again[place[place >= 0]] = True
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            raw, at, named = data.tobytes(), first[fresh], keys[fresh].tolist()
            self._learn(named, [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], kind[at].tolist())
            place[fresh] = [self.recent[k] for k in named]
            if len(self.recent) > RECENT:
                self._sort_in()
        where = place[inverse]
        done = np.concatenate([[0], np.cumsum(self.length[where], dtype=np.int64)])
        ids = self._joined(where).tobytes()
        cuts = (4 * done[np.searchsorted(begin, starts)]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def _odd(self, texts: list[bytes]) -> set[int]:
        """Texts with two white-space characters in a row or one at the end: found by bytes, in doubt by a pattern."""
        if not self.keeps_space:
            return set()
        data = np.frombuffer(b"x".join(texts) + b"x", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        ws = WHITE[data]
        at = np.flatnonzero(ws[:-1] & ws[1:])
        owner = np.searchsorted(starts, at, "right") - 1
        odd = set(owner.tolist()) | {i for i, t in enumerate(texts) if t[-1:].isspace()}
        wide = np.flatnonzero(WIDE[data])
        for i in set((np.searchsorted(starts, wide, "right") - 1).tolist()) - odd:
            if self.odd.search(texts[i].decode("utf-8", "replace")):
                odd.add(i)
        return odd

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.known > MEMO:
            self._forget(MEMO // 2)
        odd = self._odd(texts)
        whole = iter(self._fresh([texts[i].decode("utf-8", "replace") for i in sorted(odd)]))
        with np.errstate(over="ignore"):
            plain = iter(self._gathered([t for i, t in enumerate(texts) if i not in odd]))
        return [next(whole).tobytes() if i in odd else next(plain) for i in range(len(texts))]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = Encoder(path, keeps_space)
    return _ENCODERS[path, keeps_space]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, keeps_space: bool, end_id: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    enc, end = encoder(path, keeps_space), np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        for i, j in slices(batch, "text", SLICE):
            part = batch.slice(i, j - i)
            yield part.column("doc_id"), [ids + end for ids in enc.encode(texts_of(part.column("text")))]
    release()


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))


def write_orc(docs: DataFrame, path: str, tokenizer: str, keeps_space: bool = True, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", stripe_mb: int = 16, row_index_stride: int = 1000) -> None:
    """Write (doc_id, ids, n_tokens, file_no, start_in_file) in ascending doc_id order.

    Only texts are shuffled, not ids. ``tokenizer`` is the path of a tokenizers file; on a
    cluster it must exist on every executor. ``keeps_space`` says whether a word's leading
    space belongs to its token (byte-level BPE) or white space is dropped (BPE with word ends).
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for doc_ids, ids in _encoded(batches, tokenizer, keeps_space, end_id):
            n = np.asarray([len(x) // 4 for x in ids], np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([doc_ids, _lists(ids), _longs(n), _longs(np.full(len(n), part)), _longs(starts)], ["doc_id", "ids", "n_tokens", "file_no", "start_in_file"])

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = held.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    out = dealt.mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, file_no long, start_in_file long")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(row_index_stride), "orc.stripe.size": str(stripe_mb << 20), "compression": "zstd"}
    out.write.options(**options).orc(path)


ORC_SCHEMA = "doc_id long, ids array<int>, n_tokens long, file_no long, start_in_file long"


def read_orc(spark, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, start): start counts the ids of all documents before, over all files.

    Filters on doc_id reach the files' statistics and Bloom filters; the sums over files read
    the one column n_tokens and have a row for each file.
    """
    held = spark.read.schema(ORC_SCHEMA).orc(path)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = held.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return held.join(F.broadcast(files), "file_no").select("doc_id", "ids", "n_tokens", (F.col("base") + F.col("start_in_file")).cast("long").alias("start"))


def with_crc(df: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with an ids array."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            data, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(data[at[i] : at[i + 1]].tobytes()) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), _longs(np.diff(at)), _longs(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def orc_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared space and return the digest of what is read back."""
    path = shared_dir(docs.sparkSession, "orc-ids")
    write_orc(docs, path, tokenizer, **options)
    return with_crc(read_orc(docs.sparkSession, path))


def binary_pieces(n: int, longest: int) -> list[int]:
    """Power-of-two lengths that sum to n, longest first, none above ``longest`` (itself a power of two)."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool = False, longest: int = 4096, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length (its bucket), ids_crc32, doc_tokens, sequence_id, offset and, if kept, ids.

    There is no shuffle: a piece is a sequence, whose id follows from its task and row.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in _encoded(batches, tokenizer, keeps_space, end_id):
            rows, starts, lengths, totals, pieces = [], [], [], [], []
            for r, x in enumerate(ids):
                at = 0
                for n in binary_pieces(len(x) // 4, longest):
                    rows.append(r)
                    starts.append(at)
                    lengths.append(n)
                    totals.append(len(x) // 4)
                    pieces.append(x[4 * at : 4 * (at + n)])
                    at += n
            arrays = [doc_ids.take(pa.array(np.asarray(rows, np.int64))), _longs(starts), _longs(lengths), _longs([zlib.crc32(p) for p in pieces]), _longs(totals)]
            yield pa.RecordBatch.from_arrays([*arrays, *([_lists(pieces)] if keep_ids else [])], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    schema = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in names)
    cuts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)
    return cuts.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so that a training job reads batches of one shape."""
    pieces.write.partitionBy("length").parquet(path)


def read_buckets(spark, path: str, schema, length: int | None = None) -> DataFrame:
    """The pieces of all buckets, or those of one length: its folder alone is read."""
    held = spark.read.schema(schema).parquet(path).select(*(f.name for f in schema))
    return held if length is None else held.filter(F.col("length") == length)


def checked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the checksum of their ids in place of the ids, in batches."""
    names = [c for c in pieces.columns if c != "ids"]

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            data, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(data[at[i] : at[i + 1]].tobytes()) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), _longs(sums)], [*names, "ids_crc32"])

    return pieces.select(*names, "ids").mapInArrow(crc, ", ".join(f"{c} long" for c in (*names, "ids_crc32")))


def packed_buckets(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``pack`` by way of buckets in the shared folder: the ids are written, read back, and their checksums taken from what was read."""
    pieces, path = pack(docs, tokenizer, **options).drop("ids_crc32"), shared_dir(docs.sparkSession, "buckets")
    write_buckets(pieces, path)
    return checked(read_buckets(docs.sparkSession, path, pieces.schema))
