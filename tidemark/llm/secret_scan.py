"""Secret scanning: candidates by form and place, a random forest to remove the false ones.

Method.  Candidates are runs of at least ``LEAST`` token characters, three or more such runs joined by dots, what is
assigned to a name like *password* (from ``LEAST_ASSIGNED`` characters on), passwords in addresses, and private key
blocks.  Of candidates that overlap the one that starts first counts, of these the longest.  A candidate's features are
its length and character classes, how often the class changes, the mean log-probability of its character transitions
under the corpus, its entropy, how much of it dictionary words cover, words in the document's path, and the neighbouring
words and marks.  A random forest, trained from labelled findings, scores it; a score of one half or more is a finding.

Labelled findings.  ``fit`` takes a table of them (``findings_of``).  The tables at hand hold none, so
``training_findings`` writes some by rule: keys of common shapes, passwords, addresses and key blocks (secret), and
compounds of dictionary words, identifiers, numbers, placeholders, plain words assigned to such names, and digests named
as such (not secret).  The tests measure the forest on forms that are not among these.

Scale.  Transition and word counts cover all documents; they are summed per task, then by key.  The dictionary holds
every word of 3 to 12 letters that makes up ``SHARE`` of all words or more, so it never holds more than ``1 / SHARE``
words, whatever the corpus.  The model is bounded, and scanning is one pass without a shuffle.

Edge cases.  Null or empty text has no candidates.  Very long candidates are scored whole.  Repeated rows get a row
each.  A null path has no path words.  An empty table gives no rows; the forest then knows no dictionary.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, hashed_fraction, map_batches, small_batches, small_parts

LEAST, LEAST_ASSIGNED = 16, 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
DOTTED = re.compile(r"[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,}){2,}")
#: Names that are given secret values.
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "credential", "auth")
ASSIGNED = re.compile(rf"(?:{'|'.join(NAMES)})[A-Za-z0-9_]{{0,16}}[\"']?[ \t]{{0,4}}(?:=>|:=|=|:)[ \t]{{0,4}}[\"'`]?([^\s\"'`,;<>]{{{LEAST_ASSIGNED},128}})", re.IGNORECASE)
ADDRESS = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]{1,15}://[^\s/:@]{1,64}:([^\s/@]{3,128})@")
KEY_OPENS, KEY_CLOSES = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
#: The least share of all words that a dictionary word has, and how often it must occur: parts of secrets are mostly seen once.
SHARE, LEAST_SEEN = 2e-6, 3
#: Different words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Labelled findings that the forest is trained on, at most (in expectation), and how many are written by rule.
MOST_FINDINGS, WRITTEN = 20_000, 8000
PLACEHOLDER = "[SECRET]"
#: Words that speak for or against a secret nearby, and in a path.
FOR = frozenset("token key apikey api_key secret password passwd pwd auth authorization bearer credential credentials private access client_secret".split())
AGAINST = frozenset("sha sha1 sha256 md5 checksum digest commit hash revision uuid example sample placeholder dummy test".split())
PATH_FOR = frozenset("config conf env secrets credentials settings deploy".split())
PATH_AGAINST = frozenset("test tests example examples doc docs fixtures vendor".split())
WORD = re.compile(r"[a-z0-9_]+")
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/=_-"
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "class_changes", "transitions", "entropy", "covered", "distinct",
    "path_for", "path_against", "word_for", "word_against", "assigned", "quoted", "dots", "other", "in_address", "opens_block",
)

_INDEX = np.full(256, len(SYMBOLS), dtype=np.int64)
for _i, _c in enumerate(SYMBOLS):
    _INDEX[ord(_c)] = _INDEX[ord(_c.upper())] = _i
_STATES = len(SYMBOLS) + 1
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 0, 1, 2
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-."]] = True


@dataclass(frozen=True)
class Finding:
    """A candidate with what stands around it; ``secret`` is its label."""

    token: str
    before: str = ""
    after: str = ""
    path: str = ""
    secret: bool = False


@dataclass
class Corpus:
    """Log-probabilities of character transitions, and the dictionary."""

    transitions: np.ndarray
    words: frozenset[str]


def corpus_statistics(docs: DataFrame) -> Corpus:
    """Counts over every whole text."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])

    def body(batches):
        pairs, seen, many = np.zeros(_STATES * _STATES, dtype=np.int64), {}, 0

        def words():
            return {"key": [w.decode() for w in seen], "n": list(seen.values())}

        for batch in batches:
            for text in batch["text"]:
                raw = (text or "").encode("utf-8", "replace").lower()
                codes = _INDEX[np.frombuffer(raw, dtype=np.uint8)]
                pairs += np.bincount(codes[:-1] * _STATES + codes[1:], minlength=_STATES * _STATES)
                for word in raw.translate(_LETTERS).split():
                    many += 1
                    if 3 <= len(word) <= 12:
                        seen[word] = seen.get(word, 0) + 1
            if len(seen) > HELD_WORDS:
                yield words()
                seen = {}
        used = np.flatnonzero(pairs)
        yield words()
        yield {"key": [f"#{i}" for i in used.tolist()] + ["*"], "n": [*pairs[used].tolist(), many]}

    counts = cut(map_batches(docs.select("text"), body, schema).groupBy("key").agg(F.sum("n").alias("n")))
    is_word = F.col("key").rlike("^[a-z]")
    pairs, total = np.ones((_STATES, _STATES)), 0
    for row in counts.where(~is_word).collect():
        if row.key == "*":
            total = row.n
        else:
            pairs[divmod(int(row.key[1:]), _STATES)] += row.n
    kept = counts.where(is_word & (F.col("n") >= max(LEAST_SEEN, total * SHARE))).select("key").collect()
    return Corpus(np.log(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(r.key for r in kept))


_LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def covered(token: str, words: frozenset[str]) -> float:
    """The share of ``token`` that dictionary words cover, taking the longest word at each place."""
    text, at, hit = token.lower(), 0, 0
    while at < len(text):
        for size in range(min(12, len(text) - at), 2, -1):
            if text[at : at + size] in words:
                hit += size
                at += size
                break
        else:
            at += 1
    return hit / len(text)


@lru_cache(maxsize=4096)
def path_words(path: str) -> tuple[int, int]:
    parts = set(WORD.findall(path.lower()))
    return len(parts & PATH_FOR), len(parts & PATH_AGAINST)


def describe(finding: Finding, corpus: Corpus) -> list[float]:
    """The numbers named in ``FEATURES``."""
    raw = np.frombuffer(finding.token.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = _KIND[raw]
    share = np.bincount(kinds, minlength=4) / len(raw)
    codes = _INDEX[raw]
    counts = np.bincount(raw, minlength=256)
    p = counts[counts > 0] / len(raw)
    near = WORD.findall(finding.before.lower())[-2:] + WORD.findall(finding.after.lower())[:1]
    path_for, path_against = path_words(finding.path)
    before = finding.before.rstrip(" \"'`")
    return [
        float(len(raw)), *share.tolist(), float((kinds[1:] != kinds[:-1]).mean()) if len(raw) > 1 else 0.0, float(corpus.transitions[codes[:-1], codes[1:]].mean()) if len(raw) > 1 else 0.0, float(-(p * np.log2(p)).sum()),
        covered(finding.token, corpus.words), len(p) / len(raw), float(path_for), float(path_against), float(sum(w in FOR for w in near)), float(sum(w in AGAINST for w in near)),
        float(before[-1:] in ("=", ":", ">")), float(finding.before[-1:] in ("\"", "'", "`") and finding.after[:1] in ("\"", "'", "`")),
        float((raw == 46).sum()), float((~_PLAIN[raw]).mean()), float(finding.after[:1] == "@" and "://" in finding.before), float(finding.token.startswith("-----BEGIN")),
    ]


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end (code points, end exclusive) of every candidate of the whole text, in order and apart."""
    found = []
    for m in CANDIDATE.finditer(text):
        found.append(m.span())
        if text[m.end() : m.end() + 1] == "." and (dotted := DOTTED.match(text, m.start())):
            found.append(dotted.span())
    lower = text.lower()
    if any(name in lower for name in NAMES):
        for m in ASSIGNED.finditer(text):
            value = m[1].rstrip(".:)]}")
            if len(value) >= LEAST_ASSIGNED:
                found.append((m.start(1), m.start(1) + len(value)))
    if "://" in text and "@" in text:
        found += [m.span(1) for m in ADDRESS.finditer(text)]
    at = 0
    while opens := KEY_OPENS.search(text, at):
        if not (closes := KEY_CLOSES.search(text, opens.end())):
            break
        found.append((opens.start(), closes.end()))
        at = closes.end()
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def candidates(text: str, path: str) -> list[tuple[int, int, Finding]]:
    """Start, end and the candidate with what stands around it."""
    return [(a, b, Finding(text[a:b], text[max(0, a - 40) : a], text[b : b + 40], path)) for a, b in spans(text)]


def findings_of(table: DataFrame, most: int = MOST_FINDINGS) -> list[Finding]:
    """Labelled findings from ``token, before, after, path, secret`` rows, about ``most`` different ones; null texts are empty."""
    names = ["token", "before", "after", "path"]
    rows = table.where("token IS NOT NULL AND token != '' AND secret IS NOT NULL")
    rows = rows.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names], F.col("secret").cast("boolean").alias("secret")).distinct()
    share = min(1.0, most / max(1, rows.count()))
    drawn = rows.where(hashed_fraction(*[F.col(n) for n in names]) < share).collect()
    return [Finding(*r) for r in sorted(map(tuple, drawn))]


def training_findings(words: frozenset[str], n: int = WRITTEN, seed: int = 7) -> list[Finding]:
    """``n`` labelled findings by rule, half of them secrets."""
    rng = random.Random(seed)
    common = sorted(words) or ["alpha", "beta", "gamma", "delta", "value", "record", "window", "table"]
    names = ["token", "api_key", "secret", "password", "client_secret", "access", "auth", "db_password"]
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    full = SYMBOLS[:36] + SYMBOLS[:26].upper()
    plain = lambda: " ".join(rng.choices(common, k=3))
    schemes = ["postgres", "mysql", "https", "redis", "amqp", "ftp"]

    def assigned(around: tuple[str, str]) -> tuple[str, str]:
        quote = rng.choice(["\"", "'", ""])
        return around[0] + rng.choice(names) + rng.choice([" = ", "=", ": "]) + quote, quote + around[1]

    def in_address() -> tuple[str, str]:
        return f"{plain()} {rng.choice(schemes)}://{rng.choice(common)}:", f"@{rng.choice(common)}.example/{rng.choice(common)}"

    def password() -> str:
        if rng.random() < 0.5:
            return draw(full + "!#$%&*?@^~", rng.randint(8, 15))
        return rng.choice(common).capitalize()[:8] + rng.choice(["", "_", "#", "!", "@"]) + draw("0123456789", rng.randint(2, 5)) + rng.choice(["", "!", "?", "$", draw(full, 3)])

    def piece() -> str:
        return rng.choice(common) if rng.random() < 0.85 else rng.choice([draw("0123456789", rng.randint(1, 4)), f"v{rng.randrange(9)}"])

    def secret(around):
        kind = rng.randrange(12)
        if kind == 8:
            lines = "\n".join(draw(full + "+/", 64) for _ in range(rng.randint(2, 12)))
            name = rng.choice(["RSA ", "EC ", "", "OPENSSH "])
            return f"-----BEGIN {name}PRIVATE KEY-----\n{lines}\n-----END {name}PRIVATE KEY-----", around
        if kind == 9:
            return password(), in_address()
        if kind == 10:
            return password(), assigned(around)
        if kind == 11:
            return f"eyJ{draw(full, rng.randint(17, 40))}.eyJ{draw(full, rng.randint(20, 90))}.{draw(full + '_-', 43)}", assigned(around) if rng.random() < 0.5 else around
        token = (
            draw("0123456789abcdef", rng.choice([32, 40, 64])), draw("0123456789abcdef", rng.randint(16, 28)), draw(full, rng.randint(16, 64)), draw(full + "+/", 40) + "=",
            "AKIA" + draw(SYMBOLS[:26].upper() + "234567", 16), draw(SYMBOLS[:36].upper(), rng.randint(18, 32)), "ghp_" + draw(full, 36), "sk-" + draw(full, 40),
        )[kind]
        return token, assigned(around) if rng.random() < 0.7 else around

    def harmless(around):
        kind = rng.choice((0, 1, 2, 2, 3, 4, 5, 6, 7, 8))
        if kind <= 1:
            token = "".join(rng.choices(common, k=6))[: rng.randint(16, 34)]
            return token.capitalize() if rng.random() < 0.2 else token.upper() if rng.random() < 0.1 else token, around
        if kind == 2:
            pieces = [piece() for _ in range(rng.randint(3, 6))]
            if rng.random() < 0.3:
                return "".join(w.capitalize() for w in pieces)[:40], around
            return rng.choice(["_", "-", "/"]).join(pieces), around
        if kind == 3:
            return draw("0123456789", rng.randint(16, 20)) if rng.random() < 0.6 else rng.choice("=-_x0a") * rng.randint(16, 60), around
        if kind == 4:
            token = rng.choice(["your_api_key_here", "REPLACE_WITH_TOKEN", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLEKEYEXAMPLEKEY", "insert-your-token-here", "********", "${PASSWORD}", "{{secret}}", "changeme"])
            return token, assigned(around)
        if kind == 5:
            return draw("0123456789abcdef", rng.choice([32, 40, 64])), (around[0] + rng.choice(["sha256", "md5", "checksum", "commit", "digest"]) + rng.choice([": ", " "]), around[1])
        if kind == 6:
            word = rng.choice([w for w in rng.choices(common, k=8) if len(w) >= LEAST_ASSIGNED] or ["required"])
            return rng.choice([word, word, "required", "optional", "undefined", "getenv(name)", "config.value", word + "." + rng.choice(common)]), assigned(around)
        if kind == 7:
            return ".".join("".join(rng.choices(common, k=3))[:14].ljust(8, "a") for _ in range(rng.randint(3, 5))), around
        return rng.choice(["password", "passwd", "<password>", "${DB_PASSWORD}", "xxxxx", "*****"]), in_address()

    out = []
    for i in range(n):
        path = rng.choice(["", "", f"src{rng.randrange(40)}", "app/config/settings", "docs/guide", "tests/data"])
        token, around = (secret if i % 2 else harmless)((plain() + " ", " " + plain()))
        if not i % 2 and around[0][-1:] == " " and len(token) < LEAST:
            token = (token * 16)[:16]
        out.append(Finding(token, around[0][-40:], around[1][:40], path, bool(i % 2)))
    return out


class Forest:
    """Binned classification trees on bootstrap rows, each split chosen among random features by Gini impurity."""

    BINS = 32

    def __init__(self, trees: int = 40, depth: int = 9, seed: int = 5):
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, self.BINS) / self.BINS)) for j in range(x.shape[1])]
        binned = self._bin(x)
        tried = max(1, round(x.shape[1] ** 0.5) + 1)
        size = 1 << (self.depth + 1)
        self.feature = np.full((self.trees, size), -1, dtype=np.int16)
        self.least = np.zeros((self.trees, size), dtype=np.uint8)
        self.value = np.zeros((self.trees, size))
        for t in range(self.trees):
            stack = [(1, rng.integers(0, len(x), len(x)))]
            while stack:
                node, rows = stack.pop()
                positive = y[rows].mean()
                self.value[t, node] = positive
                if 2 * node >= size or positive in (0.0, 1.0) or len(rows) < 8:
                    continue
                best = (1e-9, -1, 0)
                for j in rng.choice(x.shape[1], tried, replace=False).tolist():
                    everything = np.bincount(binned[rows, j], minlength=self.BINS + 1).cumsum()[:-1]
                    good = np.bincount(binned[rows, j], weights=y[rows], minlength=self.BINS + 1).cumsum()[:-1]
                    left, right = everything, len(rows) - everything
                    with np.errstate(divide="ignore", invalid="ignore"):
                        a, b = good / left, (positive * len(rows) - good) / right
                        gain = positive * (1 - positive) - (left * a * (1 - a) + right * b * (1 - b)) / len(rows)
                    gain[(left == 0) | (right == 0)] = -1
                    if gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()) + 1)
                if best[1] >= 0:
                    self.feature[t, node], self.least[t, node] = best[1], best[2]
                    goes_right = binned[rows, best[1]] >= best[2]
                    stack += [(2 * node, rows[~goes_right]), (2 * node + 1, rows[goes_right])]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(self.trees):
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                split = self.feature[t, node]
                node = np.where(split < 0, node, 2 * node + (binned[rows, np.maximum(split, 0)] >= self.least[t, node]))
            total += self.value[t, node]
        return total / self.trees


@dataclass
class SecretModel:
    corpus: Corpus
    forest: Forest

    def score(self, found: list[Finding]) -> np.ndarray:
        return self.forest.score(np.array([describe(f, self.corpus) for f in found])) if found else np.zeros(0)


def fit(docs: DataFrame, findings: DataFrame | list[Finding] | None = None) -> SecretModel:
    """Corpus statistics over all documents, and a forest from labelled findings (by rule, if none are given)."""
    corpus = corpus_statistics(docs)
    labelled = findings_of(findings) if isinstance(findings, DataFrame) else findings if findings is not None else training_findings(corpus.words)
    x = np.array([describe(f, corpus) for f in labelled])
    return SecretModel(corpus, Forest().fit(x, np.array([float(f.secret) for f in labelled])))


def find(texts: list[str | None], paths: list[str | None], model: SecretModel) -> list[tuple[int, list[tuple[int, int]], float]]:
    """For each text: number of candidates, spans of the findings, and the largest score."""
    each = [candidates(t or "", p or "") for t, p in zip(texts, paths, strict=True)]
    scores = model.score([c for found in each for _, _, c in found])
    out, at = [], 0
    for found in each:
        own = scores[at : at + len(found)]
        at += len(found)
        out.append((len(found), [(s, e) for (s, e, _), score in zip(found, own, strict=True) if score >= 0.5], float(own.max()) if len(found) else 0.0))
    return out


FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_candidates", T.LongType()),
        T.StructField("n_secrets", T.LongType()),
        T.StructField("spans", T.StringType()),
        T.StructField("max_score", T.DoubleType()),
    ]
)


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """A row per document: candidates, findings (``start:end`` in code points, comma-joined) and the largest score."""

    def body(batches):
        for batch in batches:
            found = find(batch["text"], batch["source"], model)
            yield {
                "doc_id": batch["doc_id"], "n_candidates": [n for n, _, _ in found], "n_secrets": [len(s) for _, s, _ in found],
                "spans": [",".join(f"{a}:{b}" for a, b in s) for _, s, _ in found], "max_score": [m for _, _, m in found],
            }

    return map_batches(docs.select("doc_id", "text", "source"), body, FOUND)


def redact(docs: DataFrame, model: SecretModel) -> DataFrame:
    """``docs`` with every finding replaced by ``PLACEHOLDER``; all columns stay, other texts stay as they are."""

    place = docs.columns.index("text")

    def run(batches):
        for part in small_parts(batches):
            texts = part.column("text").to_pylist()
            for i, (_, spans, _) in enumerate(find(texts, part.column("source").to_pylist(), model)):
                for start, end in reversed(spans):
                    texts[i] = texts[i][:start] + PLACEHOLDER + texts[i][end:]
            yield part.set_column(place, part.schema.field(place), pa.array(texts, type=part.schema.field(place).type))

    return small_batches(docs).mapInArrow(run, docs.schema)
