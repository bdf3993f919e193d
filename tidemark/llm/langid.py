"""Language identification by nearest clustered centroid of normalised TF-IDF n-gram vectors.

Method.  A text becomes hashed byte n-grams (2 to 4 bytes of the lower-cased text, non-letters blanked), damped
counts times inverse document frequency, scaled to length one.  Each language has several centroids, found by
spherical k-means over a bounded sample of its labelled rows.  A text takes the language of the centroid with the
largest cosine.  It is *rejected* when that cosine lies further from one than the distance allowed for texts of its
length in that language (see ``REJECT_SHARE``).

Scale.  Document frequencies are counted over all training rows (summed per task, then by bucket: at most 2**bits
rows).  Centroids are fitted from at most about ``sample_per_lang`` rows per language, chosen by a hash of the text.
The model is a few MB whatever the input; prediction is a scan without a shuffle.

Edge cases.  Null text or text without any letter (Unicode category L): ``und``, score 0, rejected.  Rows with null language do not train.
An empty training table gives a model without centroids: every text is ``und``.  Repeated rows each get a row.
Ties go to the language that sorts first.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import GramHasher, hashed_fraction, keep_rows, map_batches

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: A text is rejected below this share of the cosine that all but ``TAIL`` of the training texts of its length reach.
REJECT_SHARE, TAIL = 0.6, 0.005
#: Length classes of the rejection distances: powers of two of the text's bytes.
LENGTHS = 24

PREDICTED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


@dataclass
class LanguageModel:
    """Inverse document frequencies, the centroids with their languages, and the least cosine by language and length."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray
    bits: int

    def vector(self, hasher: GramHasher, text: str) -> np.ndarray:
        return weigh(hasher.counts(text), self.idf)

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and cosine, for unit rows."""
        cosines = vectors @ self.centroids.T
        best = np.full((len(vectors), len(self.langs)), -1.0, dtype=np.float32)
        for lang in range(len(self.langs)):
            best[:, lang] = cosines[:, self.owner == lang].max(axis=1)
        winner = best.argmax(axis=1)
        return winner, best[np.arange(len(vectors)), winner]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times ``idf``, of length one."""
    weights = np.log1p(counts).astype(np.float32) * idf
    norm = float(np.sqrt((weights * weights).sum()))
    return weights / norm if norm else weights


def length_class(text: str) -> int:
    return min(LENGTHS - 1, len(text.encode("utf-8", "replace")).bit_length())


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` unit centroids; starts from the mean and then the row furthest from all chosen."""
    mean = rows.mean(axis=0)
    centres = [mean / max(float(np.linalg.norm(mean)), 1e-12)]
    nearest = rows @ centres[0]
    for _ in range(min(k, len(rows)) - 1):
        centres.append(rows[int(nearest.argmin())])
        nearest = np.maximum(nearest, rows @ centres[-1])
    found = np.stack(centres)
    for _ in range(rounds):
        member = (rows @ found.T).argmax(axis=1)
        for j in range(len(found)):
            if (own := member == j).any():
                mean = rows[own].mean(axis=0)
                found[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return found


def document_frequencies(train: DataFrame, bits: int) -> tuple[int, np.ndarray, dict[str, int]]:
    """Over every training row: their number, the rows that hold each bucket, and the rows of each language."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])

    def body(batches):
        hasher = GramHasher(bits)
        held, langs = np.zeros(hasher.width, dtype=np.int64), {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                held += hasher.counts(text) > 0
                langs[lang] = langs.get(lang, 0) + 1
        used = np.flatnonzero(held)
        yield {"key": [f"b{i}" for i in used.tolist()] + [f"l{x}" for x in langs], "n": held[used].tolist() + list(langs.values())}

    rows = map_batches(train.select("text", "lang"), body, schema).groupBy("key").agg(F.sum("n").alias("n")).collect()
    held, langs = np.zeros(1 << bits, dtype=np.int64), {}
    for row in rows:
        if row.key[0] == "b":
            held[int(row.key[1:])] = row.n
        else:
            langs[row.key[1:]] = row.n
    return sum(langs.values()), held, langs


def fit(train: DataFrame, *, bits: int = 13, clusters: int = 6, sample_per_lang: int = 500) -> LanguageModel:
    """A model from ``text, lang`` rows; ``sample_per_lang`` bounds (in expectation) the different texts that fit the centroids."""
    train = train.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    total, held, langs = document_frequencies(train, bits)
    idf = (np.log((1 + total) / (1 + held)) + 1).astype(np.float32)
    names = sorted(langs)
    if not names:
        return LanguageModel([], idf, np.zeros((0, 1 << bits), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS)), bits)
    share = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(min(1.0, sample_per_lang / langs[name])))])
    # copies of a text fall together, so they are merged before a language's texts meet
    sample = train.where(hashed_fraction(F.col("text")) < share[F.col("lang")]).dropDuplicates()
    schema = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("centroids", T.ArrayType(T.FloatType())), T.StructField("least", T.ArrayType(T.DoubleType()))]
    )

    def cluster(key, frame):
        import pandas as pd

        hasher = GramHasher(bits)
        texts = [t for t in sorted(frame["text"]) if LETTER.search(t)] or [""]
        rows = np.stack([weigh(hasher.counts(t), idf) for t in texts])
        found = spherical_kmeans(rows, clusters)
        reached, sizes = (rows @ found.T).max(axis=1), np.array([length_class(t) for t in texts])
        least = np.zeros(LENGTHS)
        for size in range(LENGTHS):  # a class with few samples also takes its neighbours', so that the tail is known
            near = reached[np.abs(sizes - size) <= next((d for d in range(LENGTHS) if (np.abs(sizes - size) <= d).sum() >= 20), LENGTHS)]
            least[size] = REJECT_SHARE * np.quantile(near, TAIL)
        return pd.DataFrame({"lang": [key[0]], "centroids": [found.ravel().tolist()], "least": [least.tolist()]})

    fitted = {r.lang: r for r in sample.groupBy("lang").applyInPandas(cluster, schema).collect()}
    names = [n for n in names if n in fitted]
    each = [np.array(fitted[n].centroids, dtype=np.float32).reshape(-1, 1 << bits) for n in names]
    owner = np.concatenate([np.full(len(c), i) for i, c in enumerate(each)]) if each else np.zeros(0, int)
    return LanguageModel(names, idf, np.concatenate(each) if each else np.zeros((0, 1 << bits), np.float32), owner, np.array([fitted[n].least for n in names]), bits)


def verdicts(texts: list[str | None], model: LanguageModel, hasher: GramHasher) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of each whole text."""
    langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    known = [i for i, t in enumerate(texts) if model.langs and t and LETTER.search(t)]
    for first in range(0, len(known), 256):
        part = known[first : first + 256]
        winner, cosine = model.predict(np.stack([model.vector(hasher, texts[i]) for i in part]))
        for i, w, c in zip(part, winner.tolist(), cosine.tolist(), strict=True):
            langs[i], scores[i] = model.langs[w], min(1.0, max(0.0, c))
            rejected[i] = c < model.least[w, length_class(texts[i])]
    return langs, scores, rejected


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row, from its whole text alone."""

    def body(batches):
        hasher = GramHasher(model.bits)
        for batch in batches:
            langs, scores, rejected = verdicts(batch["text"], model, hasher)
            yield {"doc_id": batch["doc_id"], "lang_pred": langs, "score": scores, "rejected": rejected}

    return map_batches(docs.select("doc_id", "text"), body, PREDICTED)


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected."""
    hasher = GramHasher(model.bits)
    return keep_rows(docs, "text", lambda texts: [not x for x in verdicts(texts, model, hasher)[2]])
