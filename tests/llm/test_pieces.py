import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import piece

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    return piece.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(4)
    out = ["", " ", "a", " a", "a ", "\n", "\n\n", " \n ", "a\n b", "a  b\n\n c", "日本語 テスト", "ﬁ ｱ \x00 x", "▁▁a", "x" + " " * 40 + "y", "</s> <s> <0x41> <unk>", "aaaa" * 9, "\U0001f389\U0001f389 oḱ", "w" * 5000, "🎉" * 300]
    out += [" " * n for n in range(1, 120)] + ["q" + " " * n + "\nz" for n in range(1, 60)]
    for letters in ("abcdeéèst hin gou ", "01239.,-'\"() \n\tAB", " \n▁a", "日本 語a​"):
        out += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(400)]
    return out


def test_equal_to_the_library(models):
    own, library = models
    tokens = [library.id_to_piece(i) for i in range(259, 32_000)]
    rng = random.Random(5)
    for text in texts() + ["".join(rng.choices(tokens, k=rng.randint(1, 6))).replace("▁", " ") for _ in range(1500)]:
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert own.decode(ids) == library.decode(ids.tolist()), text


def test_kept_parts_change_nothing(models, monkeypatch):
    own, library = models
    monkeypatch.setattr(piece, "KEPT", 3)
    fresh = piece.PieceModel(PATH)
    for _ in range(2):
        for text in texts()[:200]:
            assert np.array_equal(fresh.encode(text), own.encode(text))
    assert len(fresh.parts) <= 3


def test_rows(spark, models):
    _, library = models
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in piece.digests(docs, PATH).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece.encode(docs.where("doc_id = 3"), PATH).first().decoded == "one two"
    assert piece.digests(docs.where("doc_id < 0"), PATH).count() == 0
