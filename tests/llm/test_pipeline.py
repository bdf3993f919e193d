import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, packing, quality, secret_scan, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("print", F.lit("x")).withColumn("host", F.lit(1))
    odd = spark.createDataFrame([(10_001, None, "en", "s", None), (10_002, "", None, None, 0), (None, "The and of this", "en", "s", 15), (None, "The and of this", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    return table.unionByName(odd.withColumn("print", F.lit("x")).withColumn("host", F.lit(1))).unionByName(table.limit(5)).cache()


def keyed(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.source or "") for r in df.collect())


def test_each_stage_does_what_its_operator_says(spark, docs):
    columns = docs.columns
    known = corpus_pipeline.language(spark, docs, SF)
    model = langid.fit(docs)
    out = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(docs, model).collect()}
    assert known.columns == columns and known.count() == docs.count() - 2 - sum(1 for i, lang, bad in out if bad and lang != "und")
    good = corpus_pipeline.good_quality(spark, docs, SF)
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert good.columns == columns and good.count() == scored.where("NOT rejected").count()
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    groups = {r.doc_id: r.component_id for r in simhash.joined_groups(docs.where("doc_id IS NOT NULL").select("doc_id", "text")).collect()}
    ids = [r.doc_id for r in single.collect()]
    assert single.columns == columns and ids.count(None) == 1 and sorted(i for i in ids if i is not None) == sorted(set(groups.values()))
    clean = corpus_pipeline.secrets(spark, docs, SF)
    assert clean.columns == columns and keyed(clean) == keyed(secret_scan.redact(docs, secret_scan.fit(docs)))
    assert clean.where("n_chars != length(text)").count() == docs.where("n_chars != length(text)").where("doc_id < 0").count()
    last = corpus_pipeline.packed(spark, docs, SF)
    want = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, last.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert out.count() > 0 and per.where("n > 2048 OR n != end").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "secrets", "packing"]


def test_stages_on_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_texts_that_share_an_id_all_stay(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    rows = [(1, one), (1, two), (1, two), (2, two), (3, three), (3, three), (4, four), (4, None), (None, one), (5, two + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    kept = sorted((r.text or "").split(" more")[0] for r in out.collect())
    assert out.columns == docs.columns and kept == sorted([one, two, three, four, ""])


def slow_groups(rows):
    """Least id of each group of (id, text) rows, by all pairs: five-word shingles at 0.8, or fingerprints at two bits."""
    import xxhash

    def pieces(text, size):
        words = (text or "").encode().lower().split()
        return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []

    def fingerprint(text):
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces(text, 3)]
        return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))

    sets, prints = [set(pieces(t, 5)) for _, t in rows], [fingerprint(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(x):
                union = sets[x] | sets[y]
                near = not union or len(sets[x] & sets[y]) / len(union) >= 0.8 or (prints[x] ^ prints[y]).bit_count() <= 2
                if near and label[x] != label[y]:
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    return {i: one for (i, _), one in zip(rows, label, strict=True)}


def test_near_duplicates_equal_all_pairs(spark):
    import random

    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    rows = [(1000, None), (1001, ""), (1002, "One  two"), (1003, "one two"), (1004, "one two three")]
    for base in range(14):  # texts short enough for an exact similarity
        words = rng.choices(vocabulary, k=rng.randint(8, 110))
        for copy in range(rng.randint(1, 6)):
            own = words[:]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if copy % 3 == 2:
                own = own[: int(len(own) * rng.uniform(0.7, 1))] + rng.choices(vocabulary, k=rng.randint(0, 4))
            rows.append((len(rows) * 7 % 997, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = slow_groups(rows)
    got = {r.doc_id: r.component_id for r in simhash.joined_groups(docs.select("doc_id", "text")).collect()}
    assert len(got) == len(rows) and got == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < len(rows) - 10


def test_many_texts_of_the_same_words(spark):
    rng = __import__("random").Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(words, 40))) for i in range(4000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert len(kept) > 3900  # none of these is a near copy of another, but for few with close fingerprints
