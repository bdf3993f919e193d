import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, list int"


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.0, 0) for i, v in rows], SCHEMA).repartition(3)


def slow(rows, k=20, every=20, width=8):
    fine = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == width and None not in v and np.isfinite(np.float32(v)).all() and np.any(np.float32(v))]
    out = {}
    for i, q in fine:
        if i % every:
            continue
        scored = []
        for j, v in fine:
            if j != i:
                total = 0.0
                for a, b in zip(q, v, strict=True):
                    total += a * b
                scored.append((-total, j))
        out[i] = sorted(scored)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_few_vectors_are_found_exactly_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8) * rng.uniform(0.5, 2)) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(50)] + [(200, rows[3][1])]
    rows += [(300, None), (320, [0.0] * 8), (340, [None] + [1.0] * 7), (360, [float("nan")] * 8), (380, [float("inf")] * 8), (400, [1.0] * 5), (None, [1.0] * 8)]
    got = found(ann.search(make(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == slow(rows)


def test_fewer_than_k_and_empty(spark):
    rng = np.random.default_rng(1)
    rows = [(20 * i, rng.normal(size=8)) for i in range(5)]
    got = found(ann.search(make(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == slow(rows) and {len(v) for v in got.values()} == {4}
    assert ann.search(make(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_each_length_is_searched_for_itself(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8 if i % 3 else 5)) for i in range(90)]
    got = found(ann.search(make(spark, rows), F.col("vec_id") % 20 == 0))
    want = {}
    for size in (5, 8):
        own = [(i, v) for i, v in rows if len(v) == size]
        want |= slow(own, width=size)
    assert got == want


SIZES = [{}, {"SHELF_ROWS": 64}, {"SHELF_ROWS": 100, "SHELF_QUERIES": 7, "LIST_ROWS": 40}, {"FIRST_LEVEL": 6, "LIST_ROWS": 50}]


@pytest.mark.parametrize("sizes", SIZES)
def test_recall_on_clustered_vectors(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, centres[0 if i < 800 else rng.integers(12)] + rng.normal(size=8)) for i in range(2400)]
    got, want = found(ann.search(make(spark, rows), F.col("vec_id") % 20 == 0)), slow(rows)
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {20}
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    scores = {(q, j): s for q, v in slow(rows, 2400).items() for s, j in v}
    assert all(scores[q, j] == s for q, v in got.items() for s, j in v)


def test_shelves_hold_all_lists_in_order():
    sizes = np.array([5, 0, 3, 30, 1, 9, 0, 10, 21])
    first, parts, many = ann.shelves(sizes, 10)
    load = np.zeros(many)
    for f, p, n in zip(first, parts, sizes, strict=True):
        load[f : f + p] += n / p
    assert (load <= 10).all() and load.sum() == sizes.sum() and (np.diff(first) >= 0).all() and parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1, 3]


def scanned(rows, queries, abandon):
    rng = np.random.default_rng(4)
    d = rows.shape[1] + 1
    none = np.zeros((0, d))
    index = ann.Index(np.linalg.qr(rng.normal(size=(d, d)))[0], float((rows**2).sum(axis=1).max()), 20, none, none, none)
    running = ann.Running(index, queries, np.full(len(queries), np.inf))
    pairs = ann.scan(running, np.arange(len(queries)), rows, ann.blocks_of(index.rotated(rows), False), np.arange(len(rows)), abandon)
    return running, pairs


def test_abandoned_candidates_are_rarely_good():
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(3000, 32)), rng.normal(size=(50, 32))
    running, pairs = scanned(rows, queries, True)
    best = np.argsort(-(queries @ rows.T), axis=1)[:, :20]
    assert pairs < 0.7 * 150_000
    assert sum(len(set(a.tolist()) & set(b.tolist())) for a, b in zip(best, running.row, strict=True)) / 1000 >= 0.95
    running, pairs = scanned(rows, queries, False)
    assert pairs == 150_000 and np.array_equal(running.row[:, :20], best)


def test_ties_go_to_the_smaller_name():
    rng = np.random.default_rng(5)
    rows = rng.integers(-1, 2, size=(700, 6)).astype(float)
    queries = rng.integers(-1, 2, size=(40, 6)).astype(float)
    running, _ = scanned(rows, queries, True)
    want = np.array([np.lexsort((np.arange(700), -s))[:21] for s in queries @ rows.T])
    assert (running.row == want).mean() > 0.97
    running, _ = scanned(rows, queries, False)
    assert np.array_equal(running.row, want)
