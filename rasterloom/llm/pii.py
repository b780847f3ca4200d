"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern and validated: card numbers by their check digit, addresses by their octets, social security
numbers by the ranges in use, phone numbers by their digits, dates by the calendar. What is valid is permuted within its format by a
keyed Feistel network over a product of two ranges, so equal values get equal pseudonyms in all documents and different ones
stay different:

    card      the first digit and the length stay, the others but the last are permuted, the check digit is made anew
    phone     the country code (1, or else two digits) and all punctuation stay, the other digits are permuted
    address   four octets as two numbers of 16 bits
    number    social security: area and group (898 x 99 in use) by serial (9999)
    date      a day within its Gregorian cycle of 400 years: 146,097 days are 189 x 773

Mail addresses are no numbers: they become "u" and 16 hexadecimal digits of a keyed hash at example.invalid.

The rounds take HMAC-SHA-256 of their state. Whoever has the key can undo the pseudonyms, so there is none in this file: give
one, or set KEY_SETTING in the session. Plans hold numbers derived from it; keep them where the key may be kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import beside

ROUNDS = 8
#: The session setting that names the key, where pseudonymise() isn't given one.
KEY_SETTING = "spark.rasterloom.pii.key"

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}"
DATE_YEAR_FIRST = r"(?<!\d)\d{4}(?<ya>[\-/.])\d{1,2}\k<ya>\d{1,2}(?!\d)"
DATE_YEAR_LAST = r"(?<!\d)\d{1,2}(?<yb>[\-/.])\d{1,2}\k<yb>\d{4}(?!\d)"
NUMBER = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
ADDRESS = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?<ca>[ \-])\d{4}\k<ca>\d{4}\k<ca>\d{4}|\d{4}(?<cb>[ \-])\d{6}\k<cb>\d{5})(?!\d)"
#: Between two digits of an international number: one blank or mark, or a bracket or two with a blank.
BLANK = r"[ .\-/\u00a0\u202f]"
GAP = rf"(?:{BLANK}?[()]{BLANK}?(?:[()]{BLANK}?)?|{BLANK})"
#: What begins another finding rather than the next group of a number that has eight digits.
OTHER = (
    r"(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{4}[\-/.]\d{1,2}[\-/.]\d{1,2}|\d{1,2}[\-/.]\d{1,2}[\-/.]\d{4}|\d{3}-\d{2}-\d{4}"
    rf"|{OCTET}(?:\.{OCTET}){{3}}|(?:1[ .\-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .\-])\d{{3}}[ .\-]\d{{4}})(?!\d)"
)
#: All groups of a number with a plus sign, or as many from the left as have 15 digits together.
INTERNATIONAL = rf"(?<!\d)\+\d(?:{GAP}?\d){{7}}(?:(?:(?!{BLANK}?{OTHER}){GAP})?\d){{0,7}}(?!\d)"
PHONE = r"(?<![\d(])(?:\+?1[ .\-]?)?\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d(])(?:\+?1[ .\-]?)?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\d)|" + INTERNATIONAL
ANY = "|".join((EMAIL, DATE_YEAR_FIRST, DATE_YEAR_LAST, NUMBER, ADDRESS, PHONE, CARD))
#: A text without these holds nothing of the kinds above.
HINT = r"[0-9@]"
KINDS = ("email", "date", "number", "address", "card", "phone")


def keyed_hash(key: str, text: Column) -> Column:
    """HMAC-SHA-256 of a text, in hexadecimal digits."""
    whole = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")  # in place of the key, which may be long
    inner, outer = (F.lit(bytes(b ^ pad for b in whole)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def feistel(kind: str, key: str, x: Column, y: Column, a: Column, b: Column) -> Column:
    """A struct l, r: the keyed permutation of (x, y) in range(a) x range(b)."""

    def step(state: Column, i: Column) -> Column:
        text = F.concat_ws("|", F.lit(kind), i.cast("string"), state.a.cast("string"), state.b.cast("string"), state.r.cast("string"))
        noise = F.conv(F.substring(keyed_hash(key, text), 1, 15), 16, 10).cast("long")
        return F.struct(state.r.alias("l"), ((state.l + noise % state.a) % state.a).alias("r"), state.b.alias("a"), state.a.alias("b"))

    start = F.struct(x.cast("long").alias("l"), y.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def permuted(kind: str, key: str, digits: Column) -> Column:
    """Two digits or more, at most 36, as as many other digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    out = feistel(kind, key, F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1).cast("long"), power(u), power(n - u))
    # one state is written out twice: bound to a name, it is computed once
    return F.transform(F.array(out), lambda s: F.concat(F.lpad(s.l.cast("string"), u, "0"), F.lpad(s.r.cast("string"), n - u, "0")))[0]


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The weighted digit sum; every second digit from the right is doubled, from the last (doubled=0) or the one before."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def in_format_of(text: Column, digits: Column) -> Column:
    """text with its digits, in order, replaced by others."""

    def at(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(digits_of(F.substr(text, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), at), "")


def date_pseudonym(m: Column, key: str) -> tuple[Column, Column]:
    """(whether m is a date of the years 1600 to 2399, its pseudonym). With the year last, "/" puts the month first."""
    sep = F.regexp_extract(m, r"^\d+([\-/.])", 1)
    parts = F.split(m, r"[\-/.]")
    first = F.length(parts[0]) == 4
    year = F.when(first, parts[0]).otherwise(parts[2]).cast("int")
    month = F.when(first | (sep != "/"), parts[1]).otherwise(parts[0]).cast("int")
    day = F.when(first, parts[2]).when(sep == "/", parts[1]).otherwise(parts[0]).cast("int")
    sound = m.rlike(rf"^(?:{DATE_YEAR_FIRST}|{DATE_YEAR_LAST})$") & F.when(
        year.between(1600, 2399) & month.between(1, 12) & (day >= 1), day <= F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    ).otherwise(False)
    start = F.make_date(F.when(year < 2000, 1600).otherwise(2000), F.lit(1), F.lit(1))
    n = F.datediff(F.make_date(year, month, day), start)
    moved = F.transform(F.array(feistel("date", key, F.floor(n / 773), n % 773, F.lit(189), F.lit(773))), lambda s: F.date_add(start, (s.l * 773 + s.r).cast("int")))[0]

    def part(column: Column, width: Column) -> Column:
        return F.lpad(column.cast("string"), F.greatest(width, F.length(column.cast("string"))), "0")

    def shown(d: Column) -> Column:
        y, mo, da = F.year(d), F.month(d), F.dayofmonth(d)
        widths = [F.length(parts[i]) for i in range(3)]
        at_front = F.concat(part(y, F.lit(4)), sep, part(mo, widths[1]), sep, part(da, widths[2]))
        american = F.concat(part(mo, widths[0]), sep, part(da, widths[1]), sep, part(y, F.lit(4)))
        european = F.concat(part(da, widths[0]), sep, part(mo, widths[1]), sep, part(y, F.lit(4)))
        return F.when(first, at_front).when(sep == "/", american).otherwise(european)

    return sound, F.transform(F.array(moved), shown)[0]


def number_pseudonym(m: Column, key: str) -> tuple[Column, Column]:
    parts = F.split(m, "-")
    area, group, serial = (parts[i].cast("int") for i in range(3))
    sound = m.rlike(f"^(?:{NUMBER})$") & F.when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)).otherwise(False)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    state = feistel("number", key, index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def shown(s: Column) -> Column:
        i = F.floor(s.l / 99)
        return F.concat_ws("-", F.lpad((i + 1 + F.when(i >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((s.l % 99 + 1).cast("string"), 2, "0"), F.lpad((s.r + 1).cast("string"), 4, "0"))

    return sound, F.transform(F.array(state), shown)[0]


def address_pseudonym(m: Column, key: str) -> tuple[Column, Column]:
    o = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    state = feistel("address", key, o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    shown = F.transform(F.array(state), lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.floor(s.l / 256), s.l % 256, F.floor(s.r / 256), s.r % 256))))[0]
    return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), shown


def card_pseudonym(m: Column, key: str) -> tuple[Column, Column]:
    d = digits_of(m)
    sound = m.rlike(f"^(?:{CARD})$") & F.when(F.length(d).between(13, 19), luhn_sum(d, 1) % 10 == 0).otherwise(False)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted("card", key, F.substr(d, F.lit(2), F.length(d) - 2)))
    whole = F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))[0]
    return sound, F.transform(F.array(whole), lambda w: in_format_of(m, w))[0]


def phone_pseudonym(m: Column, key: str) -> tuple[Column, Column]:
    d = digits_of(m)
    code = F.when(F.length(d) == 10, 0).when((F.length(d) == 11) & d.startswith("1"), 1).otherwise(2)
    # without a plus sign the same ten digits are the same number
    whole = F.concat(F.substr(d, F.lit(1), code), permuted("phone", key, F.substr(d, code + 1)))
    return m.rlike(f"^(?:{PHONE})$") & F.length(d).between(8, 15), F.transform(F.array(whole), lambda w: in_format_of(m, w))[0]


def email_pseudonym(m: Column, key: str) -> tuple[Column, Column]:
    name = F.substring(keyed_hash(key, F.concat_ws("|", F.lit("email"), F.lower(m))), 1, 16)
    return m.contains("@"), F.concat(F.lit("u"), name, F.lit("@example.invalid"))


def judged(m: Column, key: str) -> Column:
    """A struct kind, text of a candidate; the kind is null and the text unchanged if it isn't valid."""
    makers = (email_pseudonym, date_pseudonym, number_pseudonym, address_pseudonym, card_pseudonym, phone_pseudonym)
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    for kind, make in reversed(list(zip(KINDS, makers, strict=True))):
        sound, shown = make(m, key)
        out = F.when(sound, F.struct(F.lit(kind).alias("kind"), shown.alias("text"))).otherwise(out)
    return out


def equals(kind: str):
    return lambda k: F.when(k == kind, True)


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """The columns of docs with the text's personal data replaced, and pii: a map from kind to how many were replaced.

    Without a key, here or in KEY_SETTING, it raises ValueError.

    A null text stays null with an empty map, an empty text stays empty. Long texts are searched whole. Null ids, ties and repeated
    rows pass through, equal values get equal pseudonyms in all rows. A column named pii, in any case, is replaced, all others
    stay. An empty table gives an empty result. What isn't valid stays as it is.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"no key: give one, or set {KEY_SETTING}")
    own, t, back = beside(docs, text, "pii")
    none = F.array().cast("array<string>")
    step = own.withColumn("found", F.when(F.col(t).rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(none))
    step = step.withColumn("judged", F.transform("found", lambda m: judged(m, key)))
    pieces = F.split(F.col(t), ANY, -1)
    joined = F.concat(pieces[0], F.array_join(F.zip_with(F.col("judged.text"), F.slice(pieces, F.lit(2), F.size("found")), lambda a, b: F.concat(a, b)), ""))
    kinds = F.col("judged.kind")
    of_kind = [F.size(F.array_compact(F.transform(kinds, equals(k)))) for k in KINDS]
    count = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*of_kind)), lambda _, n: n > 0)
    step = step.withColumn(t, F.when(F.exists(kinds, lambda k: k.isNotNull()), joined).otherwise(F.col(t))).withColumn("pii", count)
    return step.select(*back, "pii")
