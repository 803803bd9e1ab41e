"""Text functions on columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, RECORD = "\x1f", "\x1e"


def stripped(c: Column) -> Column:
    """Text without Unicode white space at its ends; '' for null."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def has(c: Column, pattern: str) -> Column:
    """Does a Unicode-aware, case-insensitive pattern occur? False for null."""
    return F.coalesce(c.rlike(f"(?iU){pattern}"), F.lit(False))


def flags(c: Column, patterns: dict[str, str]) -> Column:
    """struct of one boolean per named pattern."""
    return F.struct(*(has(c, p).alias(n) for n, p in patterns.items()))


def has_phrase(folded: Column, phrase: str) -> Column:
    """A phrase with a space counts anywhere; a single word at word boundaries. ``folded`` is lower case."""
    return F.contains(folded, F.lit(phrase)) if " " in phrase else folded.rlike(rf"(?U)\b\Q{phrase}\E\b")


def simple_norm(c: Column) -> Column:
    """Lower case with runs of white space made one space: the SQL-checkable form of ``full_norm``."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def full_norm(c: Column | str) -> Column:
    """NFKC, case folding and collapsed white space; Spark has neither of the first two built in."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return folded(c)


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def message_digest(role: Column, text: Column) -> Column:
    """sha256 of role and text set apart by a unit separator."""
    return digest(F.concat_ws(UNIT, F.lower(role), text))


def parsed_time(c: Column) -> Column:
    """Timestamp of 'Mon Oct 23 17:40:17 +0000 2017'; null where it doesn't parse. The weekday is skipped."""
    return F.try_to_timestamp(F.substr(c, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(c: Column, pattern: str = r"(?U)\b\w+\b") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def unigrams_and_bigrams(tokens: Column) -> Column:
    """Tokens and pairs of neighbours; the tokens are bound once, so that each pair doesn't find them anew."""

    def both(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", F.element_at(t, i), F.element_at(t, i + 1)))
        return F.concat(t, F.when(F.size(t) > 1, pairs).otherwise(F.array().cast("array<string>")))

    return F.element_at(F.transform(F.array(tokens), both), 1)


def hash_fraction(seed: str, key: Column) -> Column:
    """Value in [0, 1) from the first eight bytes of sha256('seed:key')."""
    head = F.conv(F.substring(digest(F.concat(F.lit(f"{seed}:"), key)), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.pow(F.lit(2.0), F.lit(64.0))


def one_of(c: Column, allowed, optional: bool = False) -> Column:
    """Membership in a vocabulary; null and '' count as absent."""
    absent = F.coalesce(c, F.lit("")) == ""
    inside = F.coalesce(c.isin(*allowed), F.lit(False))
    return (absent | inside) if optional else (~absent & inside)


def present(*checks: tuple[Column, str]) -> Column:
    """Array of the messages whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))


def safe_id(c: Column) -> Column:
    """Is it an id of 1 to 80 ASCII letters, digits, underscores, points and hyphens? False for null."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.\-]{1,80}\z"), F.lit(False))
