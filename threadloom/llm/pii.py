"""PII: format-preserving pseudonyms by a keyed Feistel permutation, in built-in functions only.

Numbers and dates are found by pattern, validated, and permuted within their own format: a
card number stays a card number of the same length and the same check-sum state, an address
stays four octets, a date stays a valid date. The permutation depends on the key and the
kind only, so equal values get equal pseudonyms in every document, without any table.

The permutation runs on pairs (l, r) of Z_a x Z_b: even rounds add a keyed hash of r to l
modulo a, odd rounds the reverse. Each round can be undone, so different values of a kind get
different pseudonyms. In a run of digit groups the cards are the disjoint stretches of whole groups that
pass the Luhn test and open like an issuer's, leftmost and then longest first; their first six digits
stay, so that the pseudonym opens like one too. What is left of the run is searched for the
other kinds. A date with slashes is read day first, and month first where only that is a date; the
two kinds of strings are permuted each within itself. Mail addresses and hexadecimal secrets are no numbers; they get a keyed
hash in the same shape.

Defined results: null text stays null and empty text empty, with no matches; every input row
gives one output row with all its columns (repeated rows and null ids included); a value that
fails validation (an impossible date, an octet over 255, a social-security area 000, 666 or
9xx, a number of 13 to 19 digits that fails the Luhn test or opens like no issuer's, a date before 1900 or after
2099) is left alone and not counted; input columns named like the new ones are replaced. A key must
be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import let, quoted, unused

ROUNDS, WALK = 8, 12

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Patterns by kind; earlier ones win where two could start at the same place.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,6}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<![\d/\-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/\-])",
    "ssn": r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
    "phone": r"(?<![\d(])(?:\+\d{1,3}[ \-.]?)?(?:\(\d{3}\) ?|\d{3}[\-.])\d{3}[\-.]\d{4}(?!\d)",
    # A whole run of digit groups, which _cards searches; possessive, so that long runs need no stack.
    "card": r"(?<![\dA-Za-z])(?=\d(?:[ \-]?\d){12})\d++(?![A-Za-z])(?:[ \-]\d++(?![A-Za-z]))*+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
NO_CARD = "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "card")
CARD_DIGITS, ISSUER_DIGITS = (13, 19), 6
# The first digits of card issuers.
ISSUERS = r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[04-9]|6)"
FIRST_DAY, LAST_DAY, DAYS = "1900-01-01", "2099-12-31", (17, 4297)  # 17 * 4297 days
MONTH_FIRST = (2400, 19)  # months since 1900, days 13 to 31
SSN = (898 * 99, 9999)


def session_key(spark: SparkSession) -> str:
    """The secret key of the session, ``spark.threadloom.pseudonymKey``; for the invented test tables a fixed one."""
    return spark.conf.get("spark.threadloom.pseudonymKey", "key of the invented test tables")


def _kind(m: Column) -> Column:
    out = None
    for kind, p in PATTERNS.items():
        plain = p.replace(r"(?<![\d.])", "").replace(r"(?<![\d/\-])", "")
        out = (F if out is None else out).when(m.rlike(f"^(?:{plain})$"), F.lit(kind))
    return out


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn(body: Column) -> Column:
    """Check digit that makes body + digit pass the Luhn test."""
    at = F.sequence(F.lit(1), F.length(body))
    double = lambda i: (F.length(body) - i) % 2 == 0
    one = lambda i: let(F.substr(body, i, F.lit(1)).cast("int"), lambda d: F.when(double(i), F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return (10 - F.aggregate(F.transform(at, one), F.lit(0), lambda x, y: x + y) % 10) % 10


def _pad(v: Column, n: Column) -> Column:
    return F.lpad(v.cast("string"), n, F.lit("0"))


def _feistel(key: str, kind: Column, p: Column) -> Column:
    """Permute (p.l, p.r) of Z_a x Z_b."""

    def prf(value: Column, i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), value.cast("string")), 256), 1, 12), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, (s.l + prf(s.r, i)) % p.a).otherwise(s.l).alias("l"), F.when(even, s.r).otherwise((s.r + prf(s.l, i)) % p.b).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(p.l.alias("l"), p.r.alias("r")), step)


def _pair(left: Column, right: Column, a: Column, b: Column) -> Column:
    return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))


def _halves(d: Column) -> Column:
    u = F.floor(F.length(d) / 2).cast("int")
    cut = lambda s, i, n: F.substr(s, i, n).cast("long")
    return _pair(cut(d, F.lit(1), u), cut(d, u + 1, F.length(d) - u), _power(u), _power(F.length(d) - u))


def _joined(d: Column, q: Column) -> Column:
    u = F.floor(F.length(d) / 2).cast("int")
    return F.concat(_pad(q.l, u), _pad(q.r, F.length(d) - u))


def _into(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order; separators stay."""
    put = lambda i: let(F.substr(m, i, F.lit(1)), lambda c: F.when(c.rlike(r"\d"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), i))), F.lit(1))).otherwise(c))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), put), "")


def _date(m: Column) -> Column:
    """struct(day, style) of a date as it is written; day is null where it is none, or out of range."""
    first, last = (F.lit(x).cast("date") for x in (FIRST_DAY, LAST_DAY))
    iso = F.substr(m, F.lit(5), F.lit(1)) == "-"
    styles = [F.when(iso, F.try_to_date(m, "yyyy-MM-dd")), F.when(~iso, F.try_to_date(m, "dd/MM/yyyy")), F.when(~iso, F.try_to_date(m, "MM/dd/yyyy"))]
    style = F.when(styles[0].isNotNull(), 0).when(styles[1].isNotNull(), 1).when(styles[2].isNotNull(), 2)
    return let(F.coalesce(*styles), lambda day: F.struct(F.when(day.between(first, last), day).alias("day"), style.alias("style")))


def _permuted_date(key: str, m: Column) -> Column:
    start = F.lit(FIRST_DAY).cast("date")

    def any_day(day: Column) -> Column:
        n = F.date_diff(day, start)
        p = _pair(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]))
        return let(_feistel(key, F.lit("date"), p), lambda q: F.date_add(start, (q.l * DAYS[1] + q.r).cast("int")))

    def late_day(day: Column) -> Column:
        """Among days after the 12th: permuted again until the month has such a day."""
        size = F.lit(MONTH_FIRST[0]), F.lit(MONTH_FIRST[1])
        real = lambda q: q.r + 13 <= F.dayofmonth(F.last_day(F.add_months(start, q.l.cast("int"))))
        turn = lambda q: _feistel(key, F.lit("month first"), _pair(q.l, q.r, *size))
        first = turn(F.struct(((F.year(day) - 1900) * 12 + F.month(day) - 1).cast("long").alias("l"), (F.dayofmonth(day) - 13).cast("long").alias("r")))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda q, _: F.when(real(q), q).otherwise(turn(q)))
        return let(walked, lambda q: F.date_add(F.add_months(start, q.l.cast("int")), (q.r + 12).cast("int")))

    def moved(d: Column) -> Column:
        shown = F.when(d.style == 0, F.date_format(any_day(d.day), "yyyy-MM-dd")).when(d.style == 1, F.date_format(any_day(d.day), "dd/MM/yyyy")).otherwise(F.date_format(late_day(d.day), "MM/dd/yyyy"))
        return F.when(d.day.isNotNull(), shown).otherwise(m)

    return let(_date(m), moved)


def _permuted_ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    p = _pair(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    return let(_feistel(key, F.lit("ip"), p), lambda q: F.concat_ws(".", *(x.cast("int").cast("string") for x in (F.floor(q.l / 256), q.l % 256, F.floor(q.r / 256), q.r % 256))))


def _permuted_ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    p = _pair(index * 99 + group - 1, serial - 1, F.lit(SSN[0]), F.lit(SSN[1]))

    def shown(q: Column) -> Column:
        i = F.floor(q.l / 99)
        return F.concat_ws("-", _pad(F.when(i >= 665, i + 2).otherwise(i + 1), F.lit(3)), _pad(q.l % 99 + 1, F.lit(2)), _pad(q.r + 1, F.lit(4)))

    return let(_feistel(key, F.lit("ssn"), p), shown)


def _permuted_phone(key: str, m: Column) -> Column:
    def moved(d: Column) -> Column:
        body = F.right(d, F.lit(10))
        country = F.substr(d, F.lit(1), F.length(d) - 10)
        return let(_feistel(key, F.lit("phone"), _halves(body)), lambda q: _into(m, F.concat(country, _joined(body, q))))

    return let(_digits(m), moved)


def _permuted_card(key: str, m: Column) -> Column:
    """The digits between the issuer's and the last are permuted; the last makes the number pass the Luhn test."""

    def moved(d: Column) -> Column:
        issuer, inner = F.substr(d, F.lit(1), F.lit(ISSUER_DIGITS)), F.substr(d, F.lit(ISSUER_DIGITS + 1), F.length(d) - ISSUER_DIGITS - 1)
        new = let(_feistel(key, F.concat(F.lit("card"), F.length(d).cast("string"), issuer), _halves(inner)), lambda q: F.concat(issuer, _joined(inner, q)))
        return let(new, lambda b: _into(m, F.concat(b, _luhn(b).cast("string"))))

    return let(_digits(m), moved)


def _cards(run: Column) -> Column:
    """Cards of a run of digit groups: array of struct(at, size), places from 1."""
    least, most = CARD_DIGITS

    def searched(groups: Column) -> Column:
        def is_card(d: Column) -> Column:
            return F.length(d).between(least, most) & d.rlike(ISSUERS) & (_luhn(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)).cast("int"))

        def longest(i: Column) -> Column:
            sizes = F.sequence(F.lit(1), F.least(F.lit(most), F.size(groups) - i + 1))
            return F.coalesce(F.array_max(F.filter(sizes, lambda k: let(F.array_join(F.slice(groups, i, k), ""), is_card))), F.lit(0))

        def step(s: Column, i: Column) -> Column:
            past = (s.at + F.length(F.element_at(groups, i)) + 1).alias("at")

            def taken(k: Column) -> Column:
                size = F.length(F.array_join(F.slice(groups, i, k), " "))
                cards = F.when(k > 0, F.array_append(s.cards, F.struct(s.at.alias("at"), size.alias("size")))).otherwise(s.cards)
                return F.struct(F.when(k > 0, i + k).otherwise(s.free).alias("free"), past, cards.alias("cards"))

            return let(F.when(i >= s.free, longest(i)).otherwise(F.lit(0)), taken)

        none = F.expr("cast(array() as array<struct<at:int,size:int>>)")
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), F.struct(F.lit(1).alias("free"), F.lit(1).alias("at"), none.alias("cards")), step, lambda s: s.cards)

    return let(F.split(run, r"[ \-]"), searched)


def _pieces(m: Column) -> Column:
    """One match as an array of struct(kind, text); kind is null for what stays between the values of a run."""
    piece = lambda kind, text: F.array(F.struct(kind.cast("string").alias("kind"), text.alias("text")))
    none = F.expr("cast(array() as array<struct<kind:string,text:string>>)")

    def others(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(NO_CARD), F.lit(0))
        between = lambda hits: F.flatten(F.transform(F.split(text, NO_CARD, -1), lambda x, i: F.concat(piece(F.lit(None), x), F.when(i < F.size(hits), piece(_kind(F.get(hits, i)), F.get(hits, i))).otherwise(none))))
        return let(found, between)

    def cut(cards: Column) -> Column:
        def part(j: Column) -> Column:
            card, last = F.get(cards, j), F.get(cards, j - 1)
            start = F.when(j > 0, last.at + last.size).otherwise(F.lit(1))
            stop = F.when(j < F.size(cards), card.at).otherwise(F.length(m) + 1)
            return F.concat(let(F.substr(m, start, stop - start), others), F.when(j < F.size(cards), piece(F.lit("card"), F.substr(m, card.at, card.size))).otherwise(none))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cards)), part))

    return let(_kind(m), lambda kind: F.when(kind == "card", let(_cards(m), cut)).otherwise(piece(kind, m)))


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    """struct(kind, value) of one piece; kind is null where validation fails and the value is left alone."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("text"), m), 256)
    value = (
        F.when(kind == "email", F.concat(F.lit("user-"), F.substring(digest, 1, 12), F.lit("@pseudonym.invalid")))
        .when(kind == "secret", F.substr(digest, F.lit(1), F.length(m)))
        .when(kind == "ip", _permuted_ip(key, m))
        .when(kind == "date", _permuted_date(key, m))
        .when(kind == "ssn", _permuted_ssn(key, m))
        .when(kind == "phone", _permuted_phone(key, m))
        .when(kind == "card", _permuted_card(key, m))
        .otherwise(m)
    )
    valid = (kind != "date") | _date(m).day.isNotNull()
    return F.struct(F.when(valid, kind).alias("kind"), value.alias("value"))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", kinds: str = "pii_kinds", count: str = "n_pii") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, the number of replaced values and their distinct kinds, sorted and comma-joined."""
    if not key:
        raise ValueError("a secret key is needed")
    t, held_name = F.col(quoted(text)), unused(docs, "_p")
    pieces = F.col(held_name)
    none = F.expr("cast(array() as array<array<struct<kind:string,value:string>>>)")
    gate = t.rlike(r"[0-9][0-9.\-/() ]{5}|@|[0-9a-f]{32}")
    found = F.when(gate, F.transform(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda m: F.transform(_pieces(m), lambda p: pseudonym(key, p.kind, p.text)))).otherwise(none)
    held = docs.drop(kinds, count).withColumn(held_name, found)
    rest = F.split(t, PATTERN, -1)
    woven = let(rest, lambda s: F.array_join(F.transform(s, lambda x, i: F.concat(x, F.coalesce(F.array_join(F.transform(F.get(pieces, i), lambda p: p.value), ""), F.lit("")))), ""))
    real = F.filter(F.flatten(pieces), lambda p: p.kind.isNotNull())
    return held.select(
        *(F.when(F.size(pieces) > 0, woven).otherwise(t).alias(text) if c == text else F.col(quoted(c)) for c in held.columns if c != held_name),
        F.size(real).cast("long").alias(count),
        F.array_join(F.array_sort(F.array_distinct(F.transform(real, lambda p: p.kind))), ",").alias(kinds),
    )
