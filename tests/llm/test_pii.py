import hashlib
import random
import re

from tidemark.llm import pii

DOCS = "doc_id long, text string, spans string, digits int"
KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def fine(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def slow(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, r in KINDS.items() for m in r.finditer(text or "") if fine(k, m[0])]


def texts():
    rng = random.Random(9)
    out = [None, "", "x", "a@b.c", "a@b.c_d@e.f a@b", "é日\U0001f600 bob.b@mail.example.com, +1 (988) 555-2485 4918187128635271 10.0.0.1", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.2.3.256"]
    out += ["4111 1111 1111 1111", "4111-1111-1111-1112 0000000000000000", "+123456789 +12 +1234567890123456 + 1 +1  2", "a" * 30_000, "1" * 30_000, "1." * 9000, "a@" + "b." * 9000 + "c", "+1" + " " * 30_000 + "2", "x@y.z " * 700]
    for letters in ("ab@.-_ ", "0123. -", "+(1) 23.-", "0125.@a+- \n"):
        out += ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(250)]
    return out


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in [*rows, rows[5]]], DOCS)
    got = pii.scan(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = slow(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), rows[r.doc_id][1]
        assert set(want) <= set(r.spans.split(",")) or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in KINDS]


def test_wider_kinds_are_added_and_clean_text_is_not(spark):
    personal = "Contact Mr. John Smith, ssn 219-45-6780, call (415) 555-2671 or mail jane [at] mail [dot] com"
    clean = "The order 123456 has version 1.2.3 and chapter 12-34, in 2024"
    docs = spark.createDataFrame([(i, personal if i % 2 else clean, "", 0) for i in range(40)], DOCS)
    for r in pii.scan(docs).collect():
        kinds = {s.split(":")[0] for s in r.spans.split(",") if s}
        assert kinds == ({"name", "ssn", "phone_local", "email_hidden"} if r.doc_id % 2 else set())
    assert pii.scan(docs.where("doc_id < 0")).count() == 0


def test_expectation_maximisation_tells_labelers_apart():
    counts = {"email +++0": 400, "email ++00": 100, "email 0---": 300, "email 00--": 150, "email +0-0": 5}
    believed = pii.reliabilities(counts)
    assert believed["email +++0"] > 0.95 and believed["email 0---"] < 0.05
    assert pii.reliabilities({}) == {}
