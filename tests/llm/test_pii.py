"""Anchor expansion against regular expressions, and the kinds beyond them."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """Base spans by regular expressions."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [d * 2 if i % 2 else d for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE]


CASES = [
    "a@b.c@d.e x@y z@w.q. .@.. a@b..c a@b.c.-", "a@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1.1 0001.2.3.255", "1.2.3", "4111 1111-1111 1111", "4111  1111 1111 1111",
    "+1 (375) 555-4393 +12 +1-2 +1() +12345678901234567 ++1 234 567 89", "12", "+", "@", "", " ", "é@a.b", "+1 555 010 9999)", "49.37.233.206@x.y 4111111111111111.1.1.1",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert base(text) == plain(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.é@-+ (0123459)\n%_", max_size=40))
def test_base_spans_of_random_texts(text):
    assert base(text) == plain(text)


def test_random_numbers():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["4111111111111111", "1", "22", "255", "256", ".", " ", "-", "+1", "x", "a@b.c"]) for _ in range(rng.randrange(1, 9)))
        assert base(text) == plain(text)


def said(text):
    return [(k, text[a:b]) for k, a, b in pii.spans(text)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to jo.doe (at) mail (dot) example.com now", [("mailbox", "jo.doe (at) mail (dot) example.com")]),
        ("jo[AT]example[DOT]org", [("mailbox", "jo[AT]example[DOT]org")]),
        ("jo＠example.org", [("mailbox", "jo＠example.org")]),
        ("josé@exämple.org.", [("mailbox", "josé@exämple.org")]),
        ("see (at) noon, x (at) y", []),
        ("ftp://u:p@host.example:21/x", [("login", "ftp://u:p@host.example:21"), ("email", "p@host.example")]),
        ("http://host.example/a@b", []),
        ("call tel:555-0100-99", [("tel", "555-0100-99")]),
        ("IBAN: DE89 3704 0044 0532 0130 00 The next", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("IBAN DE89 3704 0044 0532 0130 01", []),
        ("SSN 123-45-6789.", [("ssn", "123-45-6789")]),
        ("ssn 000-45-6789, ssn 666-12-3456, ssn 123-00-4567, ssn 123-45-67890, assn 123-45-6789", []),
        ("account no. 12345678, acct #555-666-777 and account 12345678", [("account", "12345678"), ("account", "555-666-777")]),
        ("Passport number X1234567", [("passport", "X1234567")]),
        ("on account of 1234567 reasons; passport to 1234567", []),
    ],
)
def test_added_kinds(text, found):
    assert said(text) == found


@pytest.mark.parametrize("unit", ["a", "1", "@", "+", "a@", "1.", "1 ", "+1", "a.", "(at)", "://", "a://", "iban ", "iban A", "account 1", "ssn 1", "x@a-", "tel:1", "é", "A1"])
def test_linear_time(unit):
    began = time.time()
    pii.spans(unit * 100_000)
    assert time.time() - began < 3


def test_masked():
    text = "ftp://u:p@host.example and 1.2.3.4 end"
    assert pii.masked(text, pii.spans(text)) == "[login] and [ip] end"
    assert pii.masked("", []) == ""


def test_query_and_awkward_rows(spark, sf, awkward, empty):
    extra = awkward.limit(20).unionByName(awkward.limit(1).withColumn("text", F.lit("mail a.b@c.de from 10.0.0.1, +1 (375) 555-4393, 4111 1111 1111 1111, jo (at) x.org")))
    got = pii.find(extra).collect()
    assert len(got) == extra.count()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.pii] == pii.spans(r.text)
    assert sum(len(r.pii) == 5 for r in got) == 1
    with pytest.raises(ValueError, match="already"):
        pii.find(extra, out="score")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op13_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{a}:{b}" for k, a, b in want}
    assert pii.op13_pii(spark, empty).count() == 0
    masks = pii.redact(extra.select("doc_id", "text")).filter("size(pii) = 5").first()
    assert masks.text == "mail [email] from [ip], [phone], [card], [mailbox]"
