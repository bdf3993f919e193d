import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality, secret_scan
from tidemark.llm.common import crc_of_id

SYLLABLES = {"aa": ["the", "ing", "ion", "er", "st"], "bb": ["ça", "eau", "oué", "ille", "ment"], "cc": ["sch", "ung", "ßer", "ö", "keit"]}


def prose(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_language(spark):
    rng = random.Random(0)
    rows = [(i, prose(rng, lang, rng.randint(3, 80)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "the " * 400, None), (1004, "0xqzj zzqx xxqk " * 30, None), (1005, "theing " * 30_000, None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows + odd], "doc_id long, text string, lang string, source string, score double")
    held = crc_of_id(F.col("doc_id")) % 4 == 2
    model = langid.fit(docs.where(~held & (F.col("doc_id") < 1000)))
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    wrong = sum(out[i].lang_pred != lang for i, _, lang in rows)
    assert wrong <= 3 and not any(out[i].rejected for i, _, _ in rows)
    assert all((out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert out[1004].rejected and all(0 <= r.score <= 1 for r in out.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.rejected}
    none = langid.fit(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("doc_id < 0"), model).count() == 0


def slow_vector(text, held, total, bits):
    """The unit vector of a text by loops over its bytes: bucket to weight."""
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode()]
    seen = {}
    for size, multiplier in zip((2, 3, 4), (2654435761, 2246822519, 3266489917), strict=True):
        for i in range(len(raw) - size + 1):
            gram = sum(raw[i + k] << (8 * k) for k in range(size))
            bucket = (gram * multiplier % (1 << 32)) >> (32 - bits)
            seen[bucket] = seen.get(bucket, 0) + 1
    weights = {b: np.log1p(n) * (np.log((1 + total) / (1 + held.get(b, 0))) + 1) for b, n in seen.items()}
    norm = sum(w * w for w in weights.values()) ** 0.5
    return {b: w / norm for b, w in weights.items()}


def test_language_equals_loops_over_all_centroids(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randint(3, 30)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=240))]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, lang string")
    train = [*(r for r in rows if r[0] < 180), *rows[:3]]
    model = langid.fit(docs.where("doc_id < 180"))
    held = {}
    for _, text, _ in train:
        for b in slow_vector(text, {}, 0, model.bits):
            held[b] = held.get(b, 0) + 1
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text, _ in rows:
        vector = slow_vector(text, held, len(train), model.bits)
        best = {}
        for centroid, owner in zip(model.centroids, model.owner, strict=True):
            cosine = sum(w * float(centroid[b]) for b, w in vector.items())
            best[model.langs[owner]] = max(best.get(model.langs[owner], -1.0), cosine)
        lang = max(sorted(best), key=best.get)
        assert abs(got[i].score - best[lang]) < 1e-4
        assert got[i].lang_pred == lang or best[lang] - best[got[i].lang_pred] < 1e-5


def test_letters_are_those_of_the_category(spark):
    texts = ["½ ² ① Ⅷ", "12 ½", "ª", "日本", "ǅ", "ʰ", "_", "\u0301", ""]
    docs = spark.createDataFrame([(i, t, "aa" if i > 2 else None) for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [got[i] == "und" for i in range(9)] == [not any(c.isalpha() for c in t) for t in texts]


def test_samples_hold_copies_once(spark):
    rng = random.Random(6)
    rows = [(7, "a copy of one text", "aa")] * 3000 + [(7 if i % 2 else i, prose(rng, "bb", 12), "aa") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_per_lang=3300)
    assert model.langs == ["aa"] and (model.centroids @ model.centroids.T).min() < 0.9  # copies do not crowd the others out
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    assert 0 < quality.fit(docs, labels).prior < 1


def test_arrow_setting_of_the_session_stays(spark):
    from tidemark.llm import common

    before = spark.conf.getAll.get(common._BATCH_SETTING)
    spark.conf.set(common._BATCH_SETTING, "64m")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert common.small_batches(docs) is docs and spark.conf.get(common._BATCH_SETTING) == "64m"
    spark.conf.unset(common._BATCH_SETTING)
    common.small_batches(docs)
    assert int(spark.conf.get(common._BATCH_SETTING)) == common.BATCH_BYTES
    if before is not None:
        spark.conf.set(common._BATCH_SETTING, before)


def quality_rows(rng, n=400):
    out = []
    for i in range(n):
        good = rng.random() < (0.9 if i % 3 else 0.5)
        text = prose(rng, "aa", 60) if good else " ".join(w.upper() + "!!" for w in prose(rng, "aa", 60).split())
        out.append((i, text, f"https://Host{i % 3}.example/path{i % 2}/x", int(good)))
    return out


def test_quality(spark):
    rows = quality_rows(random.Random(1))
    docs = spark.createDataFrame([(*r[:3], "h", 0.1) for r in rows] + [(900, None, None, "h", 0.1), (901, "", "", "h", 0.1), (None, "a b", "x", "h", 0.1)], "doc_id long, text string, source string, host string, p_doc double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2] + [(901, None), (5000, 1), (None, 0)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == 403 and out[0].host == "host0.example" and out[0].path == "path0"
    held = [r for r in rows if not r[0] % 2]
    assert sum(out[r[0]].rejected == bool(r[3]) for r in held) <= 2
    assert not any(out[r[0]].rejected for r in rows if r[3])
    rates = {h: np.mean([out[r[0]].p_site for r in rows if r[0] % 3 == h]) for h in range(3)}
    assert rates[0] < rates[1] and rates[0] < rates[2]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == sorted((i if i is not None else -1) for i, r in out.items() if not r.rejected)
    assert quality.classify(docs.where("doc_id < 0"), labels).count() == 0
    assert {r.p_doc for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_sites_shrink_toward_parents(spark):
    scored = spark.createDataFrame([("a", "p", 0.9)] * 50 + [("b", "p", 0.2)] * 50 + [("c", "q", 0.1)] + [("c", "r", 0.8)] * 1, "host string, path string, p_doc double").withColumn("doc_id", F.lit(1))
    known = quality.sites(scored)
    out = {(r.host, r.path): r.p_site for r in quality.posterior(scored, known).collect()}
    assert out["a", "p"] > 0.8 and out["b", "p"] < 0.3 and 0.3 < out["c", "q"] < 0.85


def slow_posterior(rows, clip=lambda v, a, b: min(b, max(a, v))):
    """Posteriors of (host, path, probability) rows by loops."""
    def worth(groups, parents):
        n = sum(len(g) for g in groups)
        nn = sum(len(g) ** 2 for g in groups)
        if not n or len(groups) < 2 or n * n <= nn:
            return 1e6
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, parents, strict=True))
        v = sum(m * (1 - m) for m in parents) / len(groups)
        spread = (between - (len(groups) - 1) * v) / (n - nn / n)
        return clip(v / max(spread, 1e-9) - 1, 1.0, 1e6)

    rate = clip(sum(p for *_, p in rows) / len(rows), 1e-4, 1 - 1e-4)
    hosts, paths = {}, {}
    for h, s, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, s), []).append(p)
    by_host = worth(list(hosts.values()), [rate] * len(hosts))
    host_rate = {h: (sum(g) + by_host * rate) / (len(g) + by_host) for h, g in hosts.items()}
    by_path = worth(list(paths.values()), [host_rate[h] for h, _ in paths])
    logit = lambda v: np.log(clip(v, 1e-6, 1 - 1e-6) / (1 - clip(v, 1e-6, 1 - 1e-6)))
    out = []
    for h, s, p in rows:
        above = (sum(hosts[h]) - p + by_host * rate) / (len(hosts[h]) - 1 + by_host)
        site = (sum(paths[h, s]) - p + by_path * above) / (len(paths[h, s]) - 1 + by_path)
        out.append((site, 1 / (1 + np.exp(-(logit(p) + logit(site) - np.log(rate / (1 - rate)))))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_posterior_equals_loops(spark, seed):
    rng = random.Random(seed)
    rows = []
    for h in range(9):
        for s in range(rng.randint(1, 5)):
            level = rng.random()
            rows += [(f"h{h}", f"p{s}", min(1.0, max(0.0, rng.gauss(level, 0.15)))) for _ in range(rng.choice([1, 2, 30]))]
    rows += rows[:2]
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, p_doc double")
    got = {r.doc_id: (r.p_site, r.score) for r in quality.posterior(scored, quality.sites(scored)).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(slow_posterior(rows)):
        assert np.allclose(got[i], want, rtol=1e-9, atol=1e-12), rows[i]


@pytest.fixture(scope="module")
def secrets(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows, want = [], {}
    for i in range(300):
        text = prose(rng, rng.choice(list(SYLLABLES)), 50)
        kind = i % 6
        secret = {0: hexes(40), 1: hexes(18), 2: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))}.get(kind)
        if secret:
            lead = {0: 'token = "', 1: "password=", 2: ""}[kind]
            at = len(text) + 1 + len(lead)
            text = f"{text} {lead}{secret}" + ('"' if kind == 0 else "") + " end"
            want[i] = f"{at}:{at + len(secret)}"
        elif kind == 3:
            text += " " + "".join(rng.choices(SYLLABLES["aa"], k=8)) + " 4918187128635271"
        rows.append((i, text, "src/config"))
    return rows, want


def test_secrets(spark, secrets):
    rows, want = secrets
    odd = [(900, None, None), (901, "", "x"), (902, "a" * 50_000, "x"), (0, rows[0][1], "src/config")]
    docs = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, source string, spans string")
    model = secret_scan.fit(docs)
    assert 0 < len(model.corpus.words) <= 1 / secret_scan.SHARE
    out = {r.doc_id: r for r in secret_scan.scan(docs, model).collect()}
    missed = [i for i in want if out[i].spans != want[i]]
    false = [i for i, r in out.items() if i not in want and r.n_secrets]
    assert len(missed) <= 2 and len(false) <= 1, (missed, false)
    clean = {r.doc_id: r for r in secret_scan.redact(docs, model).collect()}
    assert clean[900].text is None and clean[901].text == "" and secret_scan.redact(docs, model).columns == docs.columns
    for i, text, _ in rows:
        spans = [tuple(map(int, s.split(":"))) for s in out[i].spans.split(",") if s]
        for a, b in reversed(spans):
            text = text[:a] + secret_scan.PLACEHOLDER + text[b:]
        assert clean[i].text == text
    assert secret_scan.scan(docs.where("doc_id < 0"), secret_scan.fit(docs.where("doc_id < 0"))).count() == 0


def test_forest_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((800, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = secret_scan.Forest(30, 8).fit(x[:600], y[:600])
    assert ((forest.score(x[600:]) > 0.5) == (y[600:] > 0.5)).mean() > 0.93


def slow_forest(forest, rows):
    """Mean over the trees of the leaf that a walk ends in."""
    out = []
    for row in rows:
        total = 0.0
        for t in range(forest.trees):
            node = 1
            while forest.feature[t, node] >= 0:
                j = forest.feature[t, node]
                binned = sum(row[j] >= e for e in forest.edges[j])
                node = 2 * node + int(binned >= forest.least[t, node])
            total += forest.value[t, node]
        out.append(total / forest.trees)
    return out


def slow_spans(text):
    """Candidates by one loop for each kind."""
    import re

    found = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_\-]{16,}={0,2}", text)]
    found += [(a, DOT.end()) for a, _ in found if (DOT := re.compile(r"[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,}){2,}").match(text, a))]
    for m in secret_scan.ASSIGNED.finditer(text):
        value = m[1]
        while value and value[-1] in ".:)]}":
            value = value[:-1]
        found += [(m.start(1), m.start(1) + len(value))] * (len(value) >= 6)
    found += [m.span(1) for m in secret_scan.ADDRESS.finditer(text)]
    found += [m.span() for m in re.finditer(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----.*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----", text, re.DOTALL)]
    out, at = [], 0
    while rest := [x for x in found if x[0] >= at]:
        best = min(rest, key=lambda x: (x[0], -x[1]))
        out.append(best)
        at = best[1]
    return out


def test_secrets_equal_a_walk_through_the_forest(spark, secrets):
    rng = random.Random(8)
    parts = ["password = hunter2!", "token: 'abcdefgh'", "a.b", "https://me:pa55w0rd@host.example/x", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abcdefgh12345678", "-----BEGIN RSA PRIVATE KEY-----\nAbc+/12=\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "secret=", "auth: \"x", "0123456789abcdef0123", "\n", " ", "é", "pwd=(abcdefg).", "====", "api_key=>ZZZZZZZZ9"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(300)] + [t for _, t, _ in secrets[0][:60]]
    docs = spark.createDataFrame([(i, t, "src/config") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    model = secret_scan.fit(docs)
    got = {r.doc_id: r for r in secret_scan.scan(docs, model).collect()}
    for i, text in enumerate(texts):
        own = slow_spans(text)
        assert secret_scan.spans(text) == own
        rows = [secret_scan.describe(secret_scan.Finding(text[a:b], text[max(0, a - 40) : a], text[b : b + 40], "src/config"), model.corpus) for a, b in own]
        scores = slow_forest(model.forest, rows)
        assert got[i].n_candidates == len(own) and abs(got[i].max_score - max(scores, default=0.0)) < 1e-9
        assert got[i].spans == ",".join(f"{a}:{b}" for (a, b), v in zip(own, scores, strict=True) if v >= 0.5 - 1e-12)


def test_forms_that_training_never_saw(spark):
    rng = random.Random(9)
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    full = low + low.upper() + digits
    words = [w.strip(".").lower() for _ in range(200) for w in prose(rng, "aa", 20).split()]
    plain = lambda k=1: " ".join(rng.choices(words, k=k))
    secret = {
        "gitlab": lambda: f"glpat-{draw(full, 20)}",
        "npm": lambda: f"npm_{draw(full, 36)}",
        "slack": lambda: f"xoxb-{draw(digits, 12)}-{draw(digits, 12)}-{draw(full, 24)}",
        "base32": lambda: f"secret: {draw(low + '234567', 26)}",
        "mail": lambda: f"SG.{draw(full, 22)}.{draw(full, 43)}",
        "password": lambda: f"passphrase = '{draw(full, 5)}-{draw(full, 5)}'",
        "address": lambda: f"mongodb://{plain()}:{draw(full, 11)}@{plain()}.example:27017",
        "block": lambda: f"-----BEGIN DSA PRIVATE KEY-----\n{draw(full, 64)}\n{draw(full, 30)}\n-----END DSA PRIVATE KEY-----",
    }
    harmless = {
        "path": lambda: "/" + "/".join(rng.choices(words, k=5)) + ".txt",
        "assigned": lambda: f"token: {max(rng.choices(words, k=9), key=len)} and",
        "count": lambda: f"id {draw(digits, 18)}",
        "constant": lambda: "_".join(rng.choices(words, k=4)).upper() + "_LIMIT",
        "file": lambda: f"{plain()}_{plain()}_{plain()}_{plain()}_20240131.csv",
        "method": lambda: plain() + "".join(w.capitalize() for w in rng.choices(words, k=4)) + "Id",
    }
    texts, kinds = [], []
    for _ in range(60):
        for kind, make in (secret | harmless).items():
            texts.append(f"{plain(20)} {make()} {plain(20)}")
            kinds.append(kind)
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    model = secret_scan.fit(docs)
    hit = {}
    for r in secret_scan.scan(docs, model).collect():
        hit.setdefault(kinds[r.doc_id], []).append(r.n_secrets > 0)
    rates = {k: sum(v) / len(v) for k, v in hit.items()}
    print(rates)
    assert np.mean([rates[k] for k in secret]) >= 0.9 and np.mean([rates[k] for k in harmless]) <= 0.05, rates


def test_findings_come_from_a_table(spark, secrets):
    made = secret_scan.training_findings(frozenset(SYLLABLES["aa"]), 400)
    table = spark.createDataFrame([(f.token, f.before or None, f.after, f.path, f.secret) for f in made] * 2 + [(None, "", "", "", True), ("x", "", "", "", None)], "token string, before string, after string, path string, secret boolean")
    read = secret_scan.findings_of(table)
    assert set(read) == set(made) and 0 < len(secret_scan.findings_of(table, 100)) < 200
    docs = spark.createDataFrame([(*r, "s") for r in secrets[0]], "doc_id long, text string, source string, spans string")
    model = secret_scan.fit(docs, table)
    assert secret_scan.scan(docs, model).where("n_secrets > 0").count() > 100
