import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash

DOCS = "doc_id long, text string, a string, print string"


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints):
    label = {p: p for p in prints}
    order = sorted(label)
    for _ in order:
        changed = False
        for p in order:
            for q in order:
                if (p ^ q).bit_count() <= 2 and label[q] < label[p]:
                    label[p], changed = label[q], True
        if not changed:
            return label
    return label


def check(spark, values):
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long")
    got = {r.node: r.label for r in simhash.components(simhash.close_links(distinct, 2)).collect()}
    want = slow_classes(values)
    classes, theirs = {}, {}
    for v in values:
        signed = v - (1 << 64) if v >> 63 else v
        classes.setdefault(want[v], set()).add(v)
        theirs.setdefault(got.get(signed, signed), set()).add(v)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("leaf", [2048, 4])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(leaf)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            v = base
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    check(spark, sorted(values))


def test_runs_span_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "LEAF", 3)
    keys = [1, 2, 2, 3, 3, 3, 3, 3, 4, 4]
    prints = [0, 0, 1, 0, 1, 2, 3, 4, 0, 255]
    rows = list(zip(keys, prints, strict=True))
    for cutting in ([10], [3, 7], [1, 1, 1, 1, 1, 1, 1, 1, 1, 1], [5, 0, 5]):
        batches, at = [], 0
        for n in cutting:
            part = rows[at : at + n]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], type=pa.int64()) for i in (0, 1)], names=["key", "print"]))
            at += n
        links, passed = set(), []
        for key, a, b in simhash.scan_runs(iter(batches), 2, False):
            for k, x, y in zip(key.tolist(), a.tolist(), b.tolist(), strict=True):
                links.add((x, y)) if k == -1 else passed.append((k, x))
        assert links == {(0, 1)} and sorted(passed) == [(3, i) for i in range(5)], cutting


def test_prints_and_edges(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "a b c d e"), (7, "A b\nc d e"), (8, "café  x y"), (9, long), (9, long), (None, "a b c d e")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    out = {}
    for r in simhash.groups(docs).collect():
        out.setdefault(r.doc_id, []).append((r.print % (1 << 64), r.component_id))
    for i, t in rows:
        assert all(p == slow_print(t) for p, _ in out[i])
    assert out[1] == out[2] == out[3] == [(0, 1)]
    assert out[6][0] == out[7][0] == out[None][0] and out[6][0][1] == 6
    assert len(out[9]) == 2 and simhash.groups(docs.where("doc_id < 0")).count() == 0


def test_large_group_is_one_component(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"t{j}" for j in range(300)) + f" tail{i % 40}") for i in range(200)]
    out = simhash.groups(spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS))
    prints = {r.doc_id: r.print % (1 << 64) for r in out.collect()}
    label = slow_classes(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[label[p]] = min(i, least.get(label[p], i))
    assert all(r.component_id == least[label[prints[r.doc_id]]] for r in out.select("doc_id", F.col("component_id")).collect())
    assert rng is not None


def near_copies(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows.append((len(rows), " ".join(words)))
        for _ in range(6):
            copy = words[:]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


def jaccard(a, b):
    cut = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_verified_groups_catch_near_copies_and_nothing_else(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    for leaf in (simhash.WIDE_LEAF, 3):
        monkeypatch.setattr(simhash, "WIDE_LEAF", leaf)
        component = {r.doc_id: r.component_id for r in simhash.verified_groups(docs).collect()}
        near = [(a, b, jaccard(s, t)) for a, s in rows for b, t in rows if a // 7 == b // 7 and a < b]
        high = [component[a] == component[b] for a, b, j in near if j >= 0.9]
        assert sum(high) >= 0.97 * len(high)
        for a, s in rows:
            for b, t in rows:
                if a < b and component[a] == component[b]:
                    assert a // 7 == b // 7
        assert all(component[a] == component[b] for a, b, j in near if j == 1.0)


def test_joined_groups_hold_both(spark):
    rows = near_copies(3)[:70] + [(900, None), (901, ""), (902, "same words"), (903, "Same  WORDS")]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    one, two, both = ({r.doc_id: r.component_id for r in f(docs).collect()} for f in (simhash.groups, simhash.verified_groups, simhash.joined_groups))
    ids = [i for i, _ in rows]
    for a in ids:
        for b in ids:
            if one[a] == one[b] or two[a] == two[b]:
                assert both[a] == both[b]
    assert both[900] == both[901] == 900 and both[902] == both[903] == 902
    assert all(min(i for i in ids if both[i] == c) == c for c in both.values())


def test_sketches_measure_similarity():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(1200)]
    other = words[:]
    for _ in range(20):
        other[rng.randrange(1200)] = "new"
    a, b = " ".join(words), " ".join(other)
    got = simhash.similarity(simhash.sketch(simhash.words(a)), simhash.sketch(simhash.words(b)))
    assert abs(got - jaccard(a, b)) < 0.12 and simhash.similarity(b"", b"") == 1.0
    short = "a b c d e f g"
    assert simhash.similarity(simhash.sketch(simhash.words(short)), simhash.sketch(simhash.words(short + " h"))) == pytest.approx(0.75)


def grown(words, rng, vocabulary, edits):
    copy = words[:]
    for at in rng.sample(range(len(copy)), edits):
        copy[at] = rng.choice(vocabulary)
    return " ".join(copy)


def test_failed_links_leave_members_to_the_rest_of_the_run(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = rng.choices(vocabulary, k=250)
    rows = [(i, grown(base, rng, vocabulary, rng.choice([4, 5]))) for i in range(600)] + [(600, " ".join(base))]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    component = {r.doc_id: r.component_id for r in simhash.verified_groups(docs).collect()}
    like_base = [i for i, t in rows[:600] if simhash.similarity(*(simhash.sketch(simhash.words(x)) for x in (t, rows[600][1]))) >= 0.8]
    assert len(like_base) > 400
    assert sum(component[i] == component[600] for i in like_base) >= 0.99 * len(like_base)


def test_linked_spans_what_all_verified_pairs_span():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    sketches = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([40, 200]))
        sketches += [simhash.sketch(simhash.words(grown(base, rng, vocabulary, rng.randint(0, 5)))) for _ in range(25)]
    rng.shuffle(sketches)
    label = list(range(len(sketches)))
    mine = label[:]

    def join(labels, a, b):
        old, new = max(labels[a], labels[b]), min(labels[a], labels[b])
        labels[:] = [new if x == old else x for x in labels]

    for a in range(len(sketches)):
        for b in range(a):
            if simhash.similarity(sketches[a], sketches[b]) >= simhash.SIMILARITY:
                join(label, a, b)
    for a, b in simhash.linked(sketches, np.arange(len(sketches))):
        assert simhash.similarity(sketches[a], sketches[b]) >= simhash.SIMILARITY
        join(mine, a, b)
    assert mine == label


def test_runs_of_any_size_lose_no_link(spark, monkeypatch):
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for size in (150, 50, 50):  # one hot group
        base = rng.choices(vocabulary, k=200)
        texts += [grown(base, rng, vocabulary, rng.randint(0, 5)) for _ in range(size)]
    ids = list(range(len(texts)))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    sketches = [simhash.sketch(simhash.words(t)) for t in texts]
    bands = [simhash.band_keys(simhash.shingles(simhash.words(t))) for t in texts]
    label = ids[:]
    for a in ids:
        for b in ids[:a]:
            if label[a] != label[b] and set(bands[a]) & set(bands[b]) and simhash.similarity(sketches[a], sketches[b]) >= simhash.SIMILARITY:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert max(label.count(x) for x in set(label)) > 100 and len(set(label)) > 3
    for leaf, grid, rounds in ((40, 1000, 2), (40, 20, 1)):
        for name, value in (("WIDE_LEAF", leaf), ("GRID", grid), ("ROUNDS", rounds), ("PIVOTS", 4)):
            monkeypatch.setattr(simhash, name, value)
        component = {r.doc_id: r.component_id for r in simhash.verified_groups(docs).collect()}
        same = [component[i] == label[i] for i in ids]
        assert all(same) if grid == 1000 else sum(same) >= 0.98 * len(same)


def test_passed_over_pairs_are_below_the_bar():
    rng = random.Random(16)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = ["", "one", "one two three four five six"]
    for size in (12, 40, 80, 130, 300):
        base = rng.choices(vocabulary, k=size)
        texts += [grown(base, rng, vocabulary, rng.randint(0, 4)) for _ in range(12)] + [" ".join(base[: size - 5])]
    sketches = [simhash.sketch(simhash.words(t)) for t in texts]
    values, sizes = simhash.sketch_table(sketches)
    shared = simhash.shared_values(values, sizes)
    assert shared.tolist() == [sum(any(x in set(values[j, : sizes[j]]) for j in range(len(texts)) if j != i) for x in values[i, : sizes[i]]) for i in range(len(texts))]
    pruned = 0
    for i in range(len(texts)):
        most = simhash.most_similar(i, np.arange(len(texts)), shared, sizes)
        for j in range(len(texts)):
            if i != j:
                assert simhash.similarity(sketches[i], sketches[j]) <= most[j]
                pruned += most[j] < simhash.SIMILARITY
    assert pruned


def test_texts_without_an_id_are_rows_of_verified_groups(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "", ""), (None, "q r s t u v", "", ""), (4, "a b c d e f", "", "")], DOCS)
    rows = sorted([tuple(r) for r in simhash.verified_groups(docs).collect()], key=str)
    assert rows == [(4, 4), (None, 4), (None, None)]


def test_candidates_do_not_depend_on_where_texts_differ(spark):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for pair in range(320):
        words = rng.choices(vocabulary, k=rng.randint(100, 400) if pair % 4 < 3 else 20)
        n = len(words)
        other = (words + rng.choices(vocabulary, k=n // 20), words + rng.choices(vocabulary, k=n // 9), words[: n - n // 10], [*words[:-1], "last"])[pair % 4]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    assert all(jaccard(rows[i][1], rows[i + 1][1]) > 0.87 for i in range(0, len(rows), 2))
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    component = {r.doc_id: r.component_id for r in simhash.verified_groups(docs).collect()}
    for kind in range(4):
        caught = [component[2 * p] == component[2 * p + 1] for p in range(kind, 320, 4)]
        assert sum(caught) >= 0.97 * len(caught), kind


def test_bands_miss_few_pairs_at_the_bar():
    rng = random.Random(14)
    missed = 0
    for _ in range(1500):
        hashes = np.array(rng.sample(range(1 << 32), 270), dtype=np.uint32)
        pair = simhash.band_keys(hashes[:243]), simhash.band_keys(hashes[27:])  # 216 of 270 in both: 0.8
        missed += all(a != b for a, b in zip(*pair, strict=True))
    assert missed <= 5


def test_pairs_of_a_large_run_that_agree_in_one_band_alone_are_linked(spark, monkeypatch):
    for name, value in (("WIDE_LEAF", 40), ("GRID", 20), ("ROUNDS", 1), ("PIVOTS", 4)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(16)
    rows = []
    for _ in range(60):  # pairs of near copies, all in one run; no two members agree in a second band
        base = rng.sample(range(1 << 32), 101)
        for kept in (base[:100], base[1:]):
            bands = [7, *(rng.getrandbits(62) for _ in range(simhash.BANDS - 1))]
            rows.append((len(rows), bands, bytearray(np.sort(np.array(kept, dtype=np.uint32)).astype(">u4").tobytes())))
    nodes = spark.createDataFrame(rows, "node long, bands array<long>, sketch binary")
    found = {(r.a, r.b) for r in simhash.verified_links(nodes).collect()}
    assert found == {(i, i + 1) for i in range(0, 120, 2)}


@pytest.mark.parametrize("held", [2_000_000, 10])
def test_components_are_those_of_brute_force_in_one_task_and_merged(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD_LINKS", held)
    rng = random.Random(held)
    path = rng.sample(range(-1000, 0), 60)  # a long path with nodes in no order, and loose links around
    links = [*zip(path, path[1:], strict=False), *[(rng.randrange(300), rng.randrange(300)) for _ in range(140)], (500, 500), (7, 501), (501, 7)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        front = [node]
        while front:
            if (x := front.pop()) not in want:
                want[x] = node
                front += near[x]
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert {r.node: r.label for r in simhash.components(frame).collect()} == want
    assert simhash.components(frame.where("a > 9999")).count() == 0


def test_components_of_few_links_take_few_tasks(spark):
    links = spark.range(0, 4000, 1, 50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    context = spark.sparkContext
    context.setJobGroup("components", "")
    try:
        simhash.components(links)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("components") for s in status.getJobInfo(job).stageIds}
    assert sum(status.getStageInfo(s).numTasks for s in stages if status.getStageInfo(s)) <= 200  # a few passes over 50 parts of links, and the task that joins them
