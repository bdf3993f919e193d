"""Document quality by hierarchical empirical Bayes: a document classifier, corrected by its host and path.

Method.  A logistic model over binned text statistics gives each document a probability from its whole text.  These
probabilities are summed by host and by path within the host.  A host's rate is shrunk toward the global rate, a
path's rate toward its host's; how strongly follows from the spread between groups (method of moments), so a site
with few documents says little and a large one speaks for itself.  A document's own share is left out of its site's
sums.  The posterior odds are the classifier's odds times the site's odds over the global odds.

Scale.  The classifier is fitted on at most about ``sample`` labelled rows, chosen by a hash of id and text.  Scores are
computed once and kept (ids and numbers, no text); sums by site are partial aggregates, so one host with a third of
all rows is one row after the map side.  The site table joins back as a broadcast while its summed size allows; beyond that
as a shuffle join, in which adaptive execution splits a hot host.

Edge cases.  Null or empty text has all statistics at zero and is scored like any other.  A null source is the site
``""``.  Labels that are null, or that belong to no document, are ignored; without labels of both kinds every document
gets the global rate one half.  Repeated rows count each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, hashed_fraction, map_batches, small_batches, small_parts

NAMES = (
    "log_words", "word_length", "upper", "digits", "blank", "full_stop_comma", "marks", "bars", "non_ascii", "distinct_words",
    "commonest_word", "repeats_in_a_row", "distinct_lines", "words_ending_in_marks", "log_line_words", "capital_starts",
)
BINS = 16
#: Documents with a posterior below this are rejected.  Below one half, as a lost clean document costs more than a kept poor one.
REJECT_BELOW = 0.25

#: Bytes of site rows up to which they are broadcast.
BROADCAST_BYTES = 16 << 20

_CLASSES = np.zeros(256, dtype=np.uint8)
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 1, 2, 3
_CLASSES[[9, 10, 11, 12, 13, 32]], _CLASSES[[44, 46]], _CLASSES[124], _CLASSES[128:] = 4, 5, 6, 7


_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"!#$%&*|")] = True


def raw_ends(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Last and first bytes of all words."""
    data = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
    inside = _CLASSES[data] != 4
    return data[:-1][inside[:-1] & ~inside[1:]], data[1:][inside[1:] & ~inside[:-1]]


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``NAMES``, of the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_CLASSES[np.frombuffer(raw, dtype=np.uint8)], minlength=8)
    other, lower, upper, digits, blank, stops, bars, wide = kinds.tolist()
    words = raw.split()
    n, size = max(1, len(words)), len(raw)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    in_a_row = sum(map(bytes.__eq__, words, words[1:]))
    lasts, firsts = raw_ends(raw)
    marked = int(_MARKS[lasts].sum())
    capital = int((_CLASSES[firsts] == 2).sum())
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, upper / max(1, lower + upper + wide), digits / size, blank / size, stops / n, other / n, bars / n, wide / size,
        len(seen) / n, max(seen.values(), default=0) / n, in_a_row / n, len(set(lines)) / max(1, len(lines)), marked / n, float(np.log1p(n / max(1, len(lines)))), capital / n,
    ]


@dataclass
class DocumentModel:
    """Bin edges of each statistic and the weight of each bin; ``prior`` is the share of good labels it saw."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.bias)
        for j in range(rows.shape[1]):
            z += self.weights[j, np.searchsorted(self.edges[j], rows[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, ridge: float = 2.0) -> DocumentModel:
    """The document classifier, from at most about ``sample`` different labelled rows."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL").distinct()
    labelled = docs.select("doc_id").join(known.select("doc_id").distinct(), "doc_id", "left_semi").count()
    share = min(1.0, sample / max(1, labelled))
    # the text is read once and never shuffled: statistics first, for a share of the texts; copies are merged after
    drawn = docs.select("doc_id", "text").where(hashed_fraction(F.col("doc_id"), F.col("text")) < share)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = map_batches(drawn, lambda batches: ({"doc_id": b["doc_id"], "x": [statistics(t) for t in b["text"]]} for b in batches), schema)
    rows = rows.dropDuplicates().join(known, "doc_id").select("doc_id", "x", "good").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x, r.good))
    x, y = np.array([r.x for r in rows]).reshape(-1, len(NAMES)), np.array([r.good for r in rows])
    if len(set(y.tolist())) < 2:
        return DocumentModel(np.zeros((len(NAMES), BINS - 1)), np.zeros((len(NAMES), BINS)), 0.0, 0.5)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    width = len(NAMES) * BINS
    where = np.stack([np.searchsorted(edges[j], x[:, j], side="right") + j * BINS for j in range(len(NAMES))], axis=1)
    design = np.zeros((len(x), width + 1))
    np.put_along_axis(design, where, 1.0, axis=1)
    design[:, width] = 1.0
    w, penalty = np.zeros(width + 1), np.r_[np.full(width, ridge), 1e-6]
    for _ in range(12):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty)
        w -= np.linalg.solve(hessian, design.T @ (p - y) + penalty * w)
    return DocumentModel(edges, w[:width].reshape(len(NAMES), BINS), float(w[width]), float(y.mean()))


def site(source: Column) -> tuple[Column, Column]:
    """Host and path of a source: what stands before the first slash after the scheme, and the first part after it."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.substring_index(bare, "/", 1)), F.regexp_extract(bare, "^[^/]*/([^/?#]*)", 1)


def document_scores(docs: DataFrame, model: DocumentModel) -> DataFrame:
    """``doc_id, host, path, p_doc`` for every row."""
    host, path = site(F.col("source"))
    fields = [("doc_id", T.LongType()), ("host", T.StringType()), ("path", T.StringType()), ("p_doc", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def body(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch["text"]]).reshape(-1, len(NAMES))
            yield {"doc_id": batch["doc_id"], "host": batch["host"], "path": batch["path"], "p_doc": model.probability(rows)}

    return map_batches(docs.select("doc_id", "text", host.alias("host"), path.alias("path")), body, schema)


def strength(groups: DataFrame, parent: str) -> float:
    """How many documents the parent's rate is worth, from the spread of group rates around their parents'."""
    v = F.col(parent) * (1 - F.col(parent))
    sums = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent), 2)).alias("between"), F.avg(v).alias("v"),
    ).first()
    if not sums.n or sums.groups < 2 or sums.n * sums.n <= sums.nn:
        return 1e6
    spread = (sums.between - (sums.groups - 1) * sums.v) / (sums.n - sums.nn / sums.n)
    return float(np.clip(sums.v / max(spread, 1e-9) - 1, 1.0, 1e6))


@dataclass
class Sites:
    """Sums by host and path, the global rate, and how many documents a parent's rate is worth.

    ``size`` is the table's size in bytes, as summed over its rows.
    """

    table: DataFrame
    size: int
    rate: float
    host_worth: float
    path_worth: float


def sites(scored: DataFrame) -> Sites:
    """From the document scores of all rows."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = float(np.clip((total.s or 0) / max(1, total.n or 0), 1e-4, 1 - 1e-4))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("rate", F.lit(rate))
    host_worth = strength(hosts, "rate")
    shrunk = (F.col("s") + host_worth * rate) / (F.col("n") + host_worth)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), shrunk.alias("host_rate"))
    both = cut(paths.join(hosts, "host"))
    size = both.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64).alias("size")).first().size or 0
    return Sites(both, size, rate, host_worth, strength(both, "host_rate"))


def posterior(scored: DataFrame, known: Sites) -> DataFrame:
    """``scored`` with ``p_site`` and ``score``; the site's sums leave the document itself out."""
    own = [c for c in scored.columns if c not in ("host", "path")]
    # a small table of sites goes to every task, so that neither texts nor a hot host are dealt by site
    table = F.broadcast(known.table) if known.size <= BROADCAST_BYTES else known.table
    joined = scored.join(table, ["host", "path"])
    host_rate = (F.col("host_s") - F.col("p_doc") + known.host_worth * known.rate) / (F.col("host_n") - 1 + known.host_worth)
    path_rate = (F.col("s") - F.col("p_doc") + known.path_worth * host_rate) / (F.col("n") - 1 + known.path_worth)
    bounded = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(bounded(c) / (1 - bounded(c)))
    z = logit(F.col("p_doc")) + logit(path_rate) - F.lit(float(np.log(known.rate / (1 - known.rate))))
    return joined.select(*own, "host", "path", path_rate.alias("p_site"), (1 / (1 + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000) -> DataFrame:
    """``doc_id, p_doc, host, path, p_site, score, rejected`` for every row of ``docs``."""
    scored = cut(document_scores(docs, fit(docs, labels, sample=sample)))
    return posterior(scored, sites(scored)).withColumn("rejected", F.col("score") < REJECT_BELOW)


def keep_good(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected.  Texts are scored twice and never shuffled."""
    model = fit(docs, labels, sample=sample)
    known = sites(document_scores(docs, model))
    host, path = site(F.col("source"))
    whole = docs.select(F.struct("*").alias("doc"), host.alias("host"), path.alias("path"))
    schema = T.StructType([*whole.schema.fields, T.StructField("p_doc", T.DoubleType())])

    def run(batches):
        for part in small_parts(batches):
            rows = np.array([statistics(t) for t in part.column(0).field("text").to_pylist()]).reshape(-1, len(NAMES))
            columns = [*part.columns, pa.array(model.probability(rows))]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "p_doc"])

    return posterior(small_batches(whole).mapInArrow(run, schema), known).where(F.col("score") >= REJECT_BELOW).select("doc.*")
