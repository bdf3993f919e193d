import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def counted(planned):
    got = {}
    for chosen, many in planned:
        assert sum(length * often for length, often in chosen) <= packing.CAPACITY
        for length, often in chosen:
            got[length] = got.get(length, 0) + often * many
    return got


@pytest.mark.parametrize("kind", ["small", "wide", "large", "one", "full"])
def test_plan_covers_and_is_near_the_bound(kind):
    rng = np.random.default_rng(1)
    lengths = {
        "small": rng.integers(1, 300, 90),
        "wide": np.clip(rng.lognormal(6, 1, 30_000).astype(int), 1, 2048),
        "large": rng.integers(900, 2048, 2000),
        "one": np.full(501, 700),
        "full": np.full(7, 2048),
    }[kind]
    demand = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    planned = packing.plan(demand)
    assert counted(planned) == demand
    used = sum(many for _, many in planned)
    assert used <= sum(many for _, many in packing.best_fit(demand, packing.CAPACITY))
    if kind in ("small", "wide"):
        assert used <= -(-int(lengths.sum()) // packing.CAPACITY) + 10


def test_rows_and_edges(spark):
    texts = [None, "", "hello world", "a " * 5000, "x <|endoftext|> y", "café \U0001f600 \n\n  z", "one", "one"] + [f"doc {i} " * (i % 90) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, length int, rank int")
    rows = packing.pack(packing.pieces(docs, PATH)).collect()
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(by) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and (len(own) == 1 or len(ids) > 2048)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    seats = {}
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seated in seats.values():
        at = 0
        for offset, length in sorted(seated):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, PATH)).count() == 0


@pytest.mark.parametrize("stage", ["query", "pipeline"])
def test_added_tokens_in_texts_are_single_ids(spark, tmp_path, stage):
    import corpus_pipeline
    from tidemark.llm import queries

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"x{end}{end}  y", f" \n{end} c<|endoftext", f"{end[1:]} d {end}", f"é{end}😀", f"a {end} b " * 900, "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_packing(spark, str(tmp_path)) if stage == "query" else corpus_pipeline.packed(spark, docs, str(tmp_path))
    tok = Tokenizer.from_file(PATH)
    seen = {i: 0 for i in range(len(texts))}
    for r in rows.collect():
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()), texts[r.doc_id]
        seen[r.doc_id] += r.length
    assert all(n == len(tok.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i, n in seen.items())
