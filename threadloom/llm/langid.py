"""Language identification: words first, then ever shorter character n-grams.

A known word adds its log frequency in each language. A word never seen adds the mean log
frequency of its longest n-grams of which any is known, from five characters down to one.
The language with the greatest sum wins; its score is the share of the soft-maximum.

The model is fitted on a bounded sample: at most about ``docs_per_language`` labelled
documents of each language, chosen by a hash of the id, and of these the most frequent
``most_words`` words and ``most_grams`` n-grams; so it fits in a broadcast at any scale.
Counting is distributed. Prediction reads whole texts and has no shuffle.

Defined results: a null text, or one without any letter, is ``und`` with score 0, as is every
text if there was nothing to learn from. A null id counts as the empty text in folds. Each
input row gives one output row, repeated rows included; ties between languages go to the
first by name; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import split_side
from threadloom.llm.textvec import slices

LONGEST = 5
STRIP = b".,;:!?|\"'()[]{}#*$%&<>-_/\\=+~`^"
LETTER = re.compile(rb"[a-zA-Z]")
FLUSH = 300_000  # counted words that a task holds before it passes them on
ALPHA = 0.5


def word_counts(text: bytes) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(text.lower().split()).items():
        if w := w.strip(STRIP):
            out[w] += n
    return out


def pieces(word: bytes, n: int) -> list[str]:
    s = f" {word.decode('utf-8', 'replace')} "
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def most_frequent(counted: DataFrame, most: int, size: str = "n") -> DataFrame:
    """Rows with ``size`` above the lowest step (an eighth of a power of two) that keeps at most ``most`` rows."""
    step = F.floor(8 * F.log2(F.col(size).cast("double"))).cast("long")
    steps = counted.groupBy(step.alias("step")).count().collect()  # at most a few hundred rows
    kept, least = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        kept += r["count"]
        if kept > most:
            break
        least = r["step"]
    return counted.filter(F.lit(False)) if least is None else counted.filter(step >= least)


class Model:
    """Log frequencies by language of words and n-grams."""

    def __init__(self, languages: list[str], words: dict[bytes, int], word_logs: np.ndarray, word_unseen: np.ndarray, grams: dict[str, int], gram_logs: np.ndarray, prior: np.ndarray):
        self.languages, self.words, self.grams = languages, words, grams
        self.word_logs, self.word_unseen, self.gram_logs, self.prior = word_logs, word_unseen, gram_logs, prior
        self.memo: dict[bytes, np.ndarray] = {}

    def unseen(self, word: bytes) -> np.ndarray:
        if (v := self.memo.get(word)) is not None:
            return v
        out = np.zeros(len(self.languages))
        for n in range(LONGEST, 0, -1):
            if known := [g for p in pieces(word, n) if (g := self.grams.get(p)) is not None]:
                out = self.gram_logs[known].mean(axis=0)
                break
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0
        at, n, total, get = [], [], self.prior.copy(), self.words.get
        for w, c in word_counts(text).items():
            if (i := get(w)) is not None:
                at.append(i)
                n.append(c)
            else:
                total += c * self.unseen(w)
        if at:
            total += np.asarray(n, float) @ self.word_logs[at]
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _summed(parts: DataFrame, key: str, n: int) -> DataFrame:
    counts = [f"c{i}" for i in range(n)]
    held = parts.groupBy(key).agg(*(F.sum(c).alias(c) for c in counts))
    return held.withColumn("n", sum((F.col(c) for c in counts), F.lit(0)))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 50_000, most_words: int = 150_000, most_grams: int = 150_000) -> Model:
    """Learn from all rows given that have a text and a language, within the bounds above."""
    held = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in held.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    n = len(languages)
    if not n:
        return Model([], {}, np.zeros((0, 0)), np.zeros(0), {}, np.zeros((0, 0)), np.zeros(0))
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, docs_per_language / size)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    order = {name: i for i, name in enumerate(languages)}
    fields = ", ".join(f"c{i} long" for i in range(n))
    names = [f"c{i}" for i in range(n)]

    def rows(counts: dict, kind: pa.DataType) -> pa.RecordBatch:
        table = np.asarray(list(counts.values()), np.int64).reshape(-1, n)
        return pa.RecordBatch.from_arrays([pa.array(list(counts), kind), *(pa.array(table[:, i]) for i in range(n))], ["key", *names])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for t, name in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), strict=True):
                i = order[name]
                for w, c in word_counts(t).items():
                    if (row := held.get(w)) is None:
                        held[w] = row = [0] * n
                    row[i] += c
            if len(held) > FLUSH:
                yield rows(held, pa.binary())
                held = {}
        yield rows(held, pa.binary())

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            table = np.column_stack([batch.column(c).to_numpy() for c in names])
            for w, row in zip(batch.column("key").to_pylist(), table, strict=True):
                for k in range(1, LONGEST + 1):
                    for p in pieces(w, k):
                        held[p] = held[p] + row if p in held else row
            if len(held) > FLUSH:
                yield rows(held, pa.string())
                held = {}
        yield rows(held, pa.string())

    words = _summed(held.filter(draw < share).select("text", "lang").mapInArrow(count_words, f"key binary, {fields}"), "key", n).select("key", "n", *names)
    from threadloom.llm.common import materialize

    words = materialize(words, "words")
    vocabulary = most_frequent(words, most_words)
    grams = materialize(_summed(vocabulary.select("key", *names).mapInArrow(count_grams, f"key string, {fields}"), "key", n), "grams")

    def logs(table: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
        counts = np.column_stack([table.column(c).to_numpy() for c in names]).astype(float).reshape(-1, n)
        total = counts.sum(axis=0) + ALPHA * (len(counts) + 1)
        return {k: i for i, k in enumerate(table.column("key").to_pylist())}, np.log((counts + ALPHA) / total).astype(np.float32), np.log(ALPHA / total)

    word_at, word_logs, unseen = logs(vocabulary.toArrow())
    gram_at, gram_logs, _ = logs(most_frequent(grams, most_grams).toArrow())
    prior = np.log(np.asarray([sizes[x] for x in languages], float) / sum(sizes.values()))
    return Model(languages, word_at, word_logs, unseen, gram_at, gram_logs, prior)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                out = [sent.value.predict(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(guess, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(split_side(F.col("doc_id"), folds) != held_fold))
    return predict(docs, model).select("doc_id", (split_side(F.col("doc_id"), folds) == held_fold).alias("held_out"), "lang_pred", "score")
