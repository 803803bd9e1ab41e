"""Quality rules by weak supervision, in built-in functions only.

Each rule votes good (+1) or bad (-1) on a document, or abstains (0). Most measures have two
rules, a strict and a mild one, so that a plain defect gets two bad votes and a doubtful value
one. Documents that fail the base rule are rejected by it. For the others, expectation-
maximisation over the counts of vote patterns (a strict bad vote implies the mild one, so there
are at most 4 ** 7 * 3, whatever the corpus' size) estimates how each rule votes on good and on bad documents, and
hence its accuracy; the posterior probability of being good decides. The rates are estimated
freely, with a prior of one vote: a rule that often votes alone turns out to be weak, and its bad
vote is outvoted. Nothing is sampled: the counts are of all documents, and only those few counts
reach the driver.

Defined results: null text counts as a text without words; it and an empty text fail the
base rule (fewer than 50 words), as does a text that mostly repeats itself. Repeated rows,
null ids and null other columns are kept as they are: a document is judged by its text
alone, without a join, so each input row gives one output row. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WS, let, materialize, quoted, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

# Thresholds of the rules, by rate: bad to the strict rule, bad to the mild one, good to both.
THRESHOLDS = {
    "symbols": (0.2, 0.1, 0.02),  # symbol characters a word
    "repeats": (0.3, 0.15, 0.05),  # share of words in repeated 3-word windows
    "dup_lines": (0.5, 0.25, 0.0),  # share of lines that repeat an earlier one
    "upper": (0.5, 0.3, 0.2),  # upper-case letters among cased letters
    "shouts": (0.3, 0.15, 0.05),  # exclamation marks a word
}
RULES = (*(f"{strength}{name}" for name in (*THRESHOLDS, "word_length", "length") for strength in ("", "mild_")), "sentences")

#: Beta priors, as votes: share of bad votes on good and on bad documents (one vote in all), and of good documents (ten).
PRIOR_FALSE, PRIOR_TRUE, PRIOR_GOOD = 0.02, 0.5, 0.9


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted by hash with their places; those equal to a neighbour are places of
    repeated windows, and a fold over these in order adds up the words they cover.
    """
    places = F.sequence(F.lit(1), F.size(words) - 2)
    hashed = F.transform(places, lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(s, lambda e, j: ((j > 0) & (F.get(s, j - 1).h == e.h)) | ((j < n - 1) & (F.get(s, j + 1).h == e.h)))
        at = F.sort_array(F.transform(same, lambda e: e.i))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct((i + 3).alias("end"), (acc.total + i + 3 - F.greatest(acc.end, i)).alias("total"))
        return F.aggregate(at, zero, step, lambda acc: acc.total)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(hashed), twice)).cast("long")


def _parts(t: Column) -> tuple[Column, Column, dict[str, Column]]:
    """Counts over a whole text: by words, by lines, by characters."""
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS[1:]}"))
    by_word = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"), F.size(F.filter(x, lambda s: s.rlike(r"[.!?:;\"')\]]\s*$"))).cast("long").alias("ended")))
    chars = {
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_shouts": F.length(t) - F.length(F.translate(t, "!", "")),
        "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
        "n_lower": F.length(F.regexp_replace(t, r"\P{Ll}+", "")),
    }
    return by_word, by_line, {n: c.cast("long") for n, c in chars.items()}


def _features(w: Column, lines: Column, chars: dict[str, Column]) -> Column:
    return F.struct(w.getField("n_words").alias("n_words"), w.getField("n_repeat_words").alias("n_repeat_words"), lines.getField("dup").alias("n_dup_lines"), lines.getField("n").alias("n_lines"), lines.getField("ended").alias("n_ended"), *(c.alias(n) for n, c in chars.items()))


def _whole(text: str) -> Column:
    return F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))


def features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, f): the columns to keep (all) in one struct, so that no name can clash, and counts over the whole text."""
    by_word, by_line, chars = _parts(_whole(text))
    held = docs.select(F.struct(*(F.col(quoted(c)) for c in (docs.columns if keep is None else keep))).alias("row"), by_word.alias("w"), by_line.alias("l"), *(c.alias(n) for n, c in chars.items()))
    return held.select("row", _features(F.col("w"), F.col("l"), {n: F.col(n) for n in chars}).alias("f"))


def votes(f: Column) -> Column:
    """Array of one vote (-1, 0, 1) a rule, in the order of RULES."""
    g = lambda name: f.getField(name).cast("double")
    rate = {"symbols": ("n_symbols", g("n_words")), "repeats": ("n_repeat_words", g("n_words")), "dup_lines": ("n_dup_lines", g("n_lines")), "upper": ("n_upper", g("n_upper") + g("n_lower")), "shouts": ("n_shouts", g("n_words"))}
    out = []
    for name, (*bad, good) in THRESHOLDS.items():
        count, of = rate[name]
        share = g(count) / F.greatest(of, F.lit(1.0))
        out += [F.when(of == 0, 0).when(share > least, -1).when(share <= good, 1).otherwise(0) for least in bad]
    mean = g("word_chars") / F.greatest(g("n_words"), F.lit(1.0))
    for low, high, fine_low, fine_high in ((2, 15, 3, 11), (3.5, 10, 4, 8)):
        out.append(F.when(g("n_words") == 0, 0).when((mean > high) | (mean < low), -1).when((mean <= fine_high) & (mean >= fine_low), 1).otherwise(0))
    out += [F.when(g("n_words") < least, -1).when(g("n_words") >= 2 * MIN_WORDS, 1).otherwise(0) for least in (MIN_WORDS, 1.5 * MIN_WORDS)]
    ended = g("n_ended") / F.greatest(g("n_lines"), F.lit(1.0))
    out.append(F.when(g("n_lines") == 0, 0).when(ended >= 0.5, 1).when(ended < 0.1, -1).otherwise(0))
    return F.array(*out)


def believed(pattern: tuple[int, ...]) -> float:
    """Probability of being good from which the estimation starts: one bad vote may be an error, two hardly."""
    return (0.95, 0.7, 0.1)[min(2, sum(v < 0 for v in pattern))]


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = 500) -> dict:
    """Accuracies of each rule on good and on bad documents from counts of vote patterns.

    Whether a rule votes at all is taken to say nothing about the class; given that it votes,
    ``false[j]`` is the chance of a bad vote on a good document and ``true[j]`` that on a bad
    one. Returns the posterior's log-odds, ``bias`` and ``weight[rule][vote]``, with the rates
    and each rule's ``accuracy``.
    """
    if not counts:
        return {"bias": 0.0, "weight": [], "false": [], "true": [], "accuracy": []}
    n_rules = len(next(iter(counts)))
    total = sum(counts.values())
    post = {p: believed(p) for p in counts}
    for _ in range(rounds):
        prior = (sum(n * post[p] for p, n in counts.items()) + 10 * PRIOR_GOOD) / (total + 10)
        false, true = [], []
        for j in range(n_rules):
            bad, voted = [PRIOR_FALSE, PRIOR_TRUE], [1.0, 1.0]
            for p, n in counts.items():
                if p[j]:
                    for c, mass in ((0, n * post[p]), (1, n * (1 - post[p]))):
                        voted[c] += mass
                        bad[c] += mass * (p[j] < 0)
            false.append(bad[0] / voted[0])
            true.append(bad[1] / voted[1])
        bias = math.log(prior / (1 - prior))
        weight = [{-1: math.log(f / t), 0: 0.0, 1: math.log((1 - f) / (1 - t))} for f, t in zip(false, true, strict=True)]
        odds = {p: bias + sum(w[v] for w, v in zip(weight, p, strict=True)) for p in counts}
        fresh = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for p, x in odds.items()}
        moved = max(abs(fresh[p] - post[p]) for p in counts)
        post = fresh
        if moved < 1e-9:
            break
    accuracy = [prior * (1 - f) + (1 - prior) * t for f, t in zip(false, true, strict=True)]
    return {"bias": bias, "weight": weight, "false": false, "true": true, "accuracy": accuracy}


def _failed(f: Column) -> Column:
    """Does the base rule reject a document of these counts?"""
    return (f.getField("n_words") < MIN_WORDS) | (100 * f.getField("n_repeat_words") > 50 * f.getField("n_words"))


def _posterior(model: dict, v: Column) -> Column:
    odds = F.lit(model["bias"])
    for j, w in enumerate(model["weight"]):
        vote = F.get(v, F.lit(j))
        odds = odds + F.when(vote == -1, w[-1]).when(vote == 1, w[1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, f, quality_probability, base_failed, kept): ``row`` holds the columns to keep, all by default.

    The features are written once to the shared folder, with ``row``: the vote counts and the verdict both read them.
    """
    f, v = F.col("f"), F.col("v")
    held = materialize(features(docs, text, keep).withColumn("v", votes(f)), "quality")
    counts = {tuple(r["v"]): r["count"] for r in held.filter(~_failed(f)).groupBy("v").count().collect()}  # at most 4 ** 7 * 3 rows
    p = _posterior(expectation_maximisation(counts), v)
    return held.select("row", "f", p.alias("quality_probability"), _failed(f).alias("base_failed"), (~_failed(f) & (p >= 0.5)).alias("kept"))


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps. Nothing is written: texts are read and measured twice, for the vote counts and for the verdict.

    All that is said of a row is one expression, each part of it bound once, so it can stand in a filter.
    """
    w, lines, chars = _parts(_whole(text))
    parts = F.struct(w.alias("w"), lines.alias("l"), *(c.alias(n) for n, c in chars.items()))

    def measured(body) -> Column:
        return let(parts, lambda s: let(_features(s.getField("w"), s.getField("l"), {n: s.getField(n) for n in chars}), body))

    pattern = measured(lambda f: F.when(~_failed(f), votes(f)))
    counts = {tuple(r["v"]): r["count"] for r in docs.groupBy(pattern.alias("v")).count().collect() if r["v"] is not None}  # at most 4 ** 7 * 3 rows
    model = expectation_maximisation(counts)
    return docs.filter(measured(lambda f: ~_failed(f) & let(votes(f), lambda v: _posterior(model, v) >= 0.5)))
