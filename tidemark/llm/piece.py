"""SentencePiece (merge type) encoding by a table of last tokens, and decoding.

Method.  Merging is deterministic, so every prefix of a text has one encoding and thereby one last token.  An
automaton over the vocabulary reports the tokens that end at each position; a token is the prefix's last one when it
is *compatible* with the last token of what stands before it, that is, when the two side by side are encoded as just
these two.  The table of last tokens is filled from left to right, and the ids are read off backwards.  A pair's
compatibility is decided by undoing merges along the seam: the pair is compatible when no token across the seam would
have been merged earlier than the tokens beside it.

A text is cut where no token can reach across: before every run of blanks that follows something else.  Runs of
blanks are special in such vocabularies (all longer blank tokens have the same, worst score, so they merge leftmost
first, after everything else); they are handled by that rule.  Characters outside the vocabulary take part in no
merge and fall back to their bytes.

Scale.  One scan without a shuffle.  A worker keeps the encodings of the parts it has met lately, ``KEPT`` in each of
two generations, so its memory is bounded; nothing depends on what is kept.

Edge cases.  Null text counts as empty; an empty text is just the begin and end ids.  The vocabulary's normaliser must
be the identity with a leading blank added, and blanks kept as they are; other models are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_batches

BLANK = "▁"
#: Parts whose encodings a worker keeps, in each of two generations; longer parts than ``LONGEST`` are not kept.
KEPT, LONGEST = 400_000, 64
PART = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: No token holds a line end, so a text may also be cut before each.
LINE = re.compile("\n?[^\n]+|\n")


class Parts(dict):
    """Ids of parts, as bytes, computed when asked for.

    A key that begins with a blank mark or a line end is a part as it stands; any other is a word with one blank before.
    """

    def __init__(self, model: PieceModel):
        self.model, self.older = model, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            part = key if key[:1] in (BLANK, "\n") else BLANK + key
            found = np.array(self.model.part_ids(part), dtype="<u4").tobytes()
        if len(key) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class PieceModel:
    """The vocabulary of a merge-type model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode(" a\t ", out_type=str)[:1] != [BLANK] or model.decode(model.encode("ﬁ  x")) != "ﬁ  x":
            raise ValueError("only models with the identity normaliser and a leading blank are supported")
        size = model.vocab_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.text = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.spelled = [b"" if special[i] else self.text[i].replace(BLANK, " ").encode() for i in range(size)]
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        usable = [i for i in range(size) if not special[i] and not model.is_byte(i)]
        self.blanks = {len(self.text[i]): i for i in usable if set(self.text[i]) == {BLANK}}
        #: Merge order: a token with a smaller rank is merged earlier.  Single characters are never merged.
        self.rank = {self.text[i]: -model.get_score(i) for i in usable if len(self.text[i]) > 1 and len(self.text[i]) not in self.blanks or set(self.text[i]) != {BLANK}}
        self.id = {self.text[i]: i for i in usable}
        if any("\n" in t for t in self.id):
            raise ValueError("only models without line ends in their tokens are supported")
        self.size = list(map(len, self.text))
        self.pair: dict[int, bool] = {}
        self.split = {}
        self.automaton = ahocorasick.Automaton()
        for token in self.rank:
            if len(token) == 1 or self._halves(token):  # others are never the result of merging
                self.automaton.add_word(token, (self.id[token], len(token)))
        self.automaton.add_word(BLANK, (self.id[BLANK], 1))
        self.automaton.make_automaton()
        self.first, self.last = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        self.parts = Parts(self)

    def _halves(self, token: str) -> tuple[str, str] | None:
        """The two tokens that the token's last merge joins, by merging its characters; None if they end otherwise."""
        if token not in self.split:
            parts = list(token)
            halves = None
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
                at = ranks.index(min(ranks))
                if ranks[at] == float("inf"):
                    break
                if len(parts) == 2:
                    halves = parts[0], parts[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[token] = halves if len(parts) == 1 else None
        return self.split[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the texts of the two tokens, side by side, are encoded as just these two."""
        if len(self.pair) > 1_000_000:
            self.pair.clear()
        known = self.pair[left << 20 | right] = self._compatible(self.text[left], self.text[right])
        return known

    def _compatible(self, left: str, right: str) -> bool:
        # Undo the later of the two merges beside the seam, again and again.  While both sides stand as they are, the
        # seam may be merged only by a token that comes later than the merge that takes one of the sides away.
        limit = float("inf")
        rank = self.rank.get
        while True:
            across = rank(left + right)
            if across is not None and across < limit:
                return False
            a, b = (rank(left) if len(left) > 1 else None), (rank(right) if len(right) > 1 else None)
            if a is None and b is None:
                return True
            # of equal ranks the leftmost is merged first: the left side, then the seam, then the right side
            if b is None or (a is not None and a > b):
                limit = a
                left = self.split[left][1] if left in self.split else self._halves(left)[1]
            else:
                limit = b + 0.5
                right = self.split[right][0] if right in self.split else self._halves(right)[0]

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix of ``text`` (by its end) the last token of its encoding; 0 where a character is unknown."""
        last = [0] * len(text)
        pair, compatible = self.pair, self.compatible
        for end, (token, size) in self.automaton.iter(text):
            if not last[end]:
                before = last[end - size] if size <= end else 0
                if before:
                    fits = pair.get(before << 20 | token)
                    if fits is None:
                        fits = compatible(before, token)
                    if not fits:
                        continue
                last[end] = token
        return last

    def tokens(self, text: str) -> list[int]:
        """The ids of a text without runs of blanks, read off the table backwards."""
        last, at, out = self.last_tokens(text), len(text) - 1, []
        size = self.size
        while at >= 0:
            token = last[at]
            if token:
                out.append(token)
                at -= size[token]
            else:
                out += [self.bytes[b] for b in reversed(text[at].encode("utf-8", "replace"))]
                at -= 1
        out.reverse()
        return out

    def blank_run(self, n: int) -> list[int]:
        """Equal scores: of all pairs whose joint size is a token, the leftmost is joined, again and again."""
        sizes, following, previous = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(i, i + 1, 2) for i in range(n - 1)] if 2 in self.blanks else []  # sorted, so already a heap
        while waiting:
            left, right, size = heapq.heappop(waiting)
            if not sizes[left] or not sizes[right] or sizes[left] + sizes[right] != size:
                continue
            sizes[left], sizes[right] = size, 0
            after = following[left] = following[right]
            if after < n:
                previous[after] = left
                if size + sizes[after] in self.blanks:
                    heapq.heappush(waiting, (left, after, size + sizes[after]))
            before = previous[left]
            if before >= 0 and sizes[before] + size in self.blanks:
                heapq.heappush(waiting, (before, left, sizes[before] + size))
        return [self.blanks[size] for size in sizes if size]

    def part_ids(self, part: str) -> list[int]:
        """Ids of one part: blanks (any number), then other characters (any number)."""
        body = part.lstrip(BLANK)
        blanks = len(part) - len(body)
        if not body:
            return self.blank_run(blanks)
        if not blanks:
            return self.tokens(body)
        found = self.tokens(BLANK + body)
        if found[0] == self.blanks[1]:  # nothing was merged with the last blank: it belongs to the run
            return self.blank_run(blanks) + found[1:]
        return (self.blank_run(blanks - 1) if blanks > 1 else []) + found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, with the begin and the end id."""
        if not text:
            return np.array([self.begin, self.end], dtype="<u4")
        if "  " in text or BLANK in text or text[0] == " ":
            text = BLANK + text.replace(" ", BLANK)
            parts = [part for line in LINE.findall(text) for part in PART.findall(line)]
        else:  # the same parts, found faster; see Parts
            parts = text.replace("\n", " \n").split(" ")
            parts[0] = parts[0] if parts[0][:1] != "\n" and parts[0] else BLANK
        return np.frombuffer(b"".join([self.first, *map(self.parts.__getitem__, parts), self.last]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: blanks for their mark, bytes joined, the leading blank of the whole text dropped."""
        raw = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("decoded", T.StringType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text."""

    def body(batches):
        model = load(path)
        for batch in batches:
            ids = [model.encode(t) for t in batch["text"]]
            yield {"doc_id": batch["doc_id"], "ids": [x.tolist() for x in ids], "decoded": [model.decode(x) for x in ids]}

    return map_batches(docs.select("doc_id", "text"), body, ENCODED)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Like ``encode``, with the number of ids and digests of ids and decoded text in their place."""

    def body(batches):
        model = load(path)
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch["text"]:
                ids = model.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield out

    return map_batches(docs.select("doc_id", "text"), body, DIGESTS)
