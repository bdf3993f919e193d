import math
import random
import re

from tidemark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow(text):
    words = WORD.findall(lower(text))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    for template, label in licenses.TEMPLATES:
        want, n = set(template.split()), len(template.split())
        size = 16
        while size < 2 * n:
            size *= 2
        least = len(want) if len(want) < 8 else math.ceil(0.8 * len(want) - 1e-9)
        starts = range(0, len(words) - size // 2, size // 2) if len(words) > size else [0]
        for start in starts:
            held = want & set(words[start : start + size])
            if len(held) >= least:
                labels.add(label)
                score = max(score, len(held) / len(want))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def texts():
    rng = random.Random(2)
    pool = [w for t, _ in licenses.TEMPLATES for w in t.split()] + ["foo", "é", "日本", "x9"]
    out = [None, "", "!!!", "Released under the MIT License.", "UNDER THE MIT-LICENSE, under the mit license", "cc-by-nc cc by nc by nc", "Apache License, Version 2.0", "All rights reserved", "no such thing"]
    for template, _ in licenses.TEMPLATES:
        words = template.split()
        for drop in (0, 1, 3, 6):
            kept = words[:]
            for _ in range(min(drop, len(kept) - 1)):
                kept.pop(rng.randrange(len(kept)))
            rng.shuffle(kept)
            out.append(" ".join(kept))
            out.append("foo " * rng.randint(1, 400) + template + " bar" * rng.randint(1, 300) + "\n" + template.upper())
    return out + [" ".join(rng.choices(pool, k=rng.randint(1, 200))) for _ in range(150)]


def test_rows_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "l", 0.5) for i, t in [*rows, rows[3]]], "doc_id long, text string, labels string, score double")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert tuple(r)[1:] == slow(rows[r.doc_id][1]), rows[r.doc_id][1]
    assert licenses.scan(docs.where("doc_id < 0")).count() == 0


def test_prefixes_are_short_and_rare_first():
    index = licenses.index_templates(licenses.TEMPLATES, {b"the": 100, b"license": 90, b"granted": 1})
    t = next(i for i, (text, _) in enumerate(licenses.TEMPLATES) if text.startswith("permission is hereby granted free") and len(text.split()) < 40)
    words = index.words[t].tolist()
    by = {v: k for k, v in index.order.items()}
    assert by[words[-1]] == b"the" and index.needed[t] < len(words)
    indexed = {w for prefix in index.prefix.values() for w, hits in prefix.items() if any(own == t for own, _ in hits)}
    assert indexed == set(words[: len(words) - index.needed[t] + 1]) and index.order[b"the"] not in indexed


def test_time_grows_with_the_places():
    import time

    index = licenses.index_templates(licenses.TEMPLATES, {})
    took = []
    for n in (10_000, 40_000):
        text = "under the mit license foo " * n
        start = time.perf_counter()
        out = licenses.scan_text(text, index)
        took.append(time.perf_counter() - start)
        assert out[:4] == (5 * n, n, 0, 5 * (n - 1))
    assert took[1] < 10 * took[0]


def test_one_word_tells_short_notices_apart():
    index = licenses.index_templates(licenses.TEMPLATES, {})
    assert licenses.scan_text("Released under the BSD license. It is a license of note.", index)[-2] == ""
    assert licenses.scan_text("Released under\nthe MIT license.", index)[-2] == "mit"


def test_wrapped_notices_are_found(spark):
    rng = random.Random(7)
    rows = []
    for template, label in licenses.TEMPLATES:
        words = template.split()
        for width in (3, 6, 11):
            for before in (0, 31, 50, 333):
                lines = [" ".join(["foo"] * rng.randint(1, 8)) for _ in range(before)]
                lines += ["# " + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
                rows.append((len(rows), "\r\n".join([*lines, "bar", "bar " * 200]), label))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text, label in rows:
        assert label in got[i].labels.split(",") and got[i].score == 1.0, text
    plain = spark.createDataFrame([(1, "permission is hereby granted\nfoo\nfree of charge")], "doc_id long, text string")
    assert licenses.scan(plain).first().labels == ""
