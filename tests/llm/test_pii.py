from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import pii


def keyed(key, text):
    return hmac.new(hashlib.sha256(key.encode()).digest(), text.encode(), hashlib.sha256).hexdigest()


def noise(kind, key, i, a, b, r):
    return int(keyed(key, f"{kind}|{i}|{a}|{b}|{r}")[:15], 16)


def feistel(kind, key, x, y, a, b):
    """The same network, in plain Python."""
    left, right = x, y
    for i in range(pii.ROUNDS):
        left, right, a, b = right, (left + noise(kind, key, i, a, b, right) % a) % a, b, a
    return left, right


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(kind, key, d):
    u = len(d) // 2
    x, y = feistel(kind, key, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
    return str(x).zfill(u) + str(y).zfill(len(d) - u)


def card(d, key):
    body = d[0] + digits("card", key, d[1:-1])
    return next(body + c for c in "0123456789" if luhn(body + c))


def address(m, key):
    o = list(map(int, m.split(".")))
    x, y = feistel("address", key, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def date(m, key):
    d = dt.date.fromisoformat(m)
    start = dt.date(1600 if d.year < 2000 else 2000, 1, 1)
    n = (d - start).days
    x, y = feistel("date", key, n // 773, n % 773, 189, 773)
    return (start + dt.timedelta(x * 773 + y)).isoformat()


def number(m, key):
    area, group, serial = map(int, m.split("-"))
    x, y = feistel("number", key, (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
    i = x // 99
    return f"{i + 1 + (i >= 665):03}-{x % 99 + 1:02}-{y + 1:04}"


def email(m, key):
    return f"u{keyed(key, 'email|' + m.lower())[:16]}@example.invalid"


def run(docs, texts, key="k"):
    return [(r.text, r.pii) for r in pii.pseudonymise(docs(list(enumerate(texts))), key=key).orderBy("doc_id").collect()]


def test_equals_plain_python(docs):
    """All six kinds, dates with the year at either end."""
    draw = random.Random(1)
    texts, want = [], []
    for i in range(30):
        d = "4" + "".join(draw.choice("0123456789") for _ in range(14))
        d = next(d + c for c in "0123456789" if luhn(d + c))
        ip = ".".join(str(draw.randrange(256)) for _ in range(4))
        day, other = ((dt.date(1600, 1, 1) + dt.timedelta(draw.randrange(2 * 146097))).isoformat() for _ in "ab")
        phone = f"({draw.randrange(1000):03}) 555-{draw.randrange(10000):04}"
        p = digits("phone", "k", re.sub(r"\D", "", phone))
        ssn = f"{draw.choice([*range(1, 666), *range(667, 900)]):03}-{draw.randrange(1, 100):02}-{draw.randrange(1, 10000):04}"
        mail = f"Some.One{draw.randrange(10**6)}@Mail{i}.Example.org"

        def last(iso, sep):
            y, m, d = iso.split("-")
            return sep.join((m, d, y) if sep == "/" else (d, m, y))

        sep = draw.choice("/.-")
        texts.append(f"a {d}, b {ip} c {day}. d {phone} e {ssn}; {mail} on {last(other, sep)}")
        found = f"a {card(d, 'k')}, b {address(ip, 'k')} c {date(day, 'k')}. d ({p[:3]}) {p[3:6]}-{p[6:]} e {number(ssn, 'k')}; {email(mail, 'k')} on {last(date(other, 'k'), sep)}"
        want.append((found, {"card": 1, "address": 1, "date": 2, "phone": 1, "number": 1, "email": 1}))
    assert run(docs, texts) == want


def test_there_is_no_key_unless_one_is_given(spark, docs):
    with pytest.raises(ValueError, match="no key"):
        pii.pseudonymise(docs([(1, "97.51.17.173")]))
    spark.conf.set(pii.KEY_SETTING, "of the session")
    try:
        assert pii.pseudonymise(docs([(1, "97.51.17.173")])).first().text == address("97.51.17.173", "of the session")
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_the_permutation_is_one(spark):
    df = spark.range(30).select(pii.feistel("t", "k", F.floor(F.col("id") / 6), F.col("id") % 6, F.lit(5), F.lit(6)).alias("s"))
    got = {(r.s.l, r.s.r) for r in df.collect()}
    assert got == {(x, y) for x in range(5) for y in range(6)}


def test_formats_and_links(docs):
    (a, n), (b, _) = run(docs, ["4111-1111-1111-1111 and +1 (487) 555-7209, Mail.One@Example.com 123-45-6789 12/31/2001 31.12.2001", "x4111111111111111 mail.one@example.com (487) 555-7209"])
    assert n == {"card": 1, "phone": 1, "email": 1, "number": 1, "date": 2}
    found = re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", a)[0]
    assert luhn(found.replace("-", "")) and found.replace("-", "") in b
    mail = re.search(r"\S+@\S+", a)[0]
    assert mail in b and mail.endswith("@example.invalid")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)[0][3:] in b
    us, eu = re.search(r"\d{2}/\d{2}/\d{4}", a)[0], re.search(r"\d{2}\.\d{2}\.\d{4}", a)[0]
    assert us.split("/") == [eu.split(".")[1], eu.split(".")[0], eu.split(".")[2]]
    ssn = re.search(r"\b\d{3}-\d{2}-\d{4}\b", a)[0]
    assert ssn != "123-45-6789" and ssn[:3] not in ("000", "666") and ssn[0] != "9"
    assert run(docs, ["4111-1111-1111-1111"], key="other")[0][0] not in (found, "4111-1111-1111-1111")


@pytest.mark.parametrize("text", ["4111111111111112", "2/30/2001", "2023-02-29", "000-12-3456", "666-12-3456", "300.1.1.1", "1.2.3.4.5", "version 3, 2.0", "a@b", "12345", "1599-01-01", "@ @ @", "no data at all"])
def test_what_is_not_valid_stays(docs, text):
    assert run(docs, [text]) == [(text, {})]


def test_odd_rows(spark, docs):
    long = "word " * 20_000 + "97.51.17.173 " + "a1" * 20_000
    df = docs([(1, None), (2, ""), (None, "97.51.17.173"), (3, long), (3, long)]).toDF("doc_id", "text", "pii", "found", "judged")
    got = sorted(((r.doc_id, r.text, r.pii) for r in pii.pseudonymise(df, key="k").collect()), key=repr)
    ip = address("97.51.17.173", "k")
    assert got == sorted([(1, None, {}), (2, "", {}), (None, ip, {"address": 1}), *[(3, long.replace("97.51.17.173", ip), {"address": 1})] * 2], key=repr)
    assert pii.pseudonymise(docs([]), key="k").count() == 0


def test_no_python_on_the_executors(docs):
    plan = pii.pseudonymise(docs([(1, "x")]), key="k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_international_numbers_are_whole(docs):
    whole = ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "+49 89 12 34 56 78", "+49 30 123 456 78 90", "+49 (0)89/123456-78", "(+33) 1.23.45.67.89", "+44 20 7946 0958", "+33\u00a01\u202f23 45 67 89"]
    other = {"4111-1111-1111-1111": "card", "4111111111111111": "card", "2001-12-31": "date", "123-45-6789": "number", "97.51.17.173": "address", "(487) 555-7209": "phone", "+33 6 12 34 56 78": "phone"}
    none = ["+12 34", "+1 2 3 4 5 6 7", "+1234567890123456789012", "3 + 12 is 15"]
    got = run(docs, [f"a {t}, b" for t in whole] + list(other) + [f"{whole[0]} {o}" for o in other] + none)
    shown = []
    for t in whole:
        d = re.sub(r"\D", "", t)
        p = iter(d[:2] + digits("phone", "k", d[2:]))
        shown.append(re.sub(r"\d", lambda _: next(p), t))
    n = len(whole)
    assert got[:n] == [(f"a {s}, b", {"phone": 1}) for s in shown]
    alone, both = got[n : n + len(other)], got[n + len(other) : -len(none)]
    # what follows a number is a finding of its own
    assert [t for t, _ in both] == [f"{shown[0]} {t}" for t, _ in alone]
    assert [k for _, k in both] == [{"phone": 2} if k == "phone" else {"phone": 1, k: 1} for k in other.values()]
    assert got[-len(none) :] == [(t, {}) for t in none]


def test_clashing_columns(docs):
    odd = docs([(1, "call +49 89 123456 78")]).selectExpr("doc_id", "text as TEXT", "1 as PII", "2 as `a.b`", "3 as found", "4 as judged", "5 as c0")
    got = pii.pseudonymise(odd, key="k")
    assert got.columns == ["doc_id", "TEXT", "a.b", "found", "judged", "c0", "pii"]
    row = tuple(got.first())
    assert row[2:6] == (2, 3, 4, 5) and row[6] == {"phone": 1} and row[1] != "call +49 89 123456 78"
