"""Packing token pieces into fixed-length sequences by a configuration linear program over the length histogram.

Method.  A *configuration* is a multiset of lengths whose sum is at most the capacity.  The program asks for the
least total weight of configurations that covers the histogram.  It is solved by multiplicative weights: every length
has a price, which falls as the length gets covered; an unbounded-knapsack dynamic program finds the most valuable
configurations at these prices; those within ``SLACK`` of the best receive weight.  The fractional solution is
rounded to whole multiples as far as the demand allows, the program is solved again for what is left, and the last
remainder is packed best fit, largest first, on the histogram.

Scale.  Only the histogram (one row per length) reaches the driver, and the plan's size depends on the capacity, not
on the number of pieces.  Pieces take their places by rank within their length.  Ranks come from counts by length and
salt, with the number of salts growing with the table, so that one very common length is spread over many tasks.

Token ids.  Those that ``tokenizers`` gives for the vocabulary file without adding special tokens: an added token of the
file that stands in a text is one id.  ``pieces`` alone takes such strings for ordinary text; the query and the pipeline
ask for ``added``.

Edge cases.  Null text counts as empty; an empty text is one piece of one token (the end id).  Longer texts than the
capacity are cut; the first piece takes the remainder.  An empty table gives no rows.  Repeated rows are packed each.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, map_batches

CAPACITY = 2048
END_ID = 0
#: Rounds of multiplicative weights, their rate, and how far from the best a configuration may be to get weight.
ROUNDS, RATE, SLACK = 48, 4.0, 1e-3
#: Pieces of one length and salt that meet in one task, on average.
PER_SALT = 20_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)

Configuration = tuple[tuple[int, int], ...]  # (length, how often), longest first


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """An encoder for a byte-level vocabulary file; the file's added tokens are its special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, added = content["model"], content.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that look at what stands around them are not supported")
    letters = byte_alphabet()
    special = len(model["merges"]) + 256
    ranks = {bytes(letters[c] for c in token): rank for token, rank in model["vocab"].items() if rank < special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, *, added: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``; with ``added``, added tokens in a text are one id each."""

    def body(batches):
        bpe = byte_bpe(vocabulary)
        encode = partial(bpe.encode, allowed_special="all") if added else bpe.encode_ordinary
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (start, stop) in enumerate(zip(edges, edges[1:], strict=False)):
                    for name, value in zip(out, (doc_id, k, start, stop - start, zlib.crc32(ids[start:stop])), strict=True):
                        out[name].append(value)
            yield out

    return map_batches(docs.select("doc_id", "text"), body, PIECES)


def best_configurations(prices: np.ndarray, capacity: int, slack: float) -> list[Configuration]:
    """Configurations of (nearly) the largest total price; ``prices[l]`` is that of length ``l``, -inf where none is left."""
    worth = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        values = prices[1 : room + 1] + worth[room - 1 :: -1][:room]
        best = int(values.argmax())
        if values[best] > worth[room - 1]:
            worth[room], taken[room] = values[best], best + 1
        else:
            worth[room] = worth[room - 1]
    whole = prices[1:] + worth[capacity - 1 :: -1][:capacity]
    firsts = np.flatnonzero(whole >= worth[capacity] * (1 - slack)) + 1
    found = set()
    for first in firsts.tolist():
        lengths, room = {first: 1}, capacity - first
        while room:
            if length := int(taken[room]):
                lengths[length] = lengths.get(length, 0) + 1
                room -= length
            else:
                room -= 1
        found.add(tuple(sorted(lengths.items(), reverse=True)))
    return sorted(found)


def fractional_cover(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[Configuration, float]:
    """Weights of configurations that cover ``demand`` (by length) at nearly the least total weight."""
    needed = demand > 0
    covered = np.zeros(capacity + 1)
    weights: dict[Configuration, float] = {}
    lengths = np.arange(capacity + 1, dtype=float)
    for _ in range(rounds):
        behind = covered[needed].mean() - np.divide(covered, 1, out=covered.copy(), where=needed)
        prices = np.where(needed, lengths * np.exp(np.clip(RATE * behind, -30, 30)), -np.inf)
        step: dict[Configuration, float] = {}
        gained = np.zeros(capacity + 1)
        for chosen in best_configurations(prices, capacity, SLACK):
            size = min(demand[length] / often for length, often in chosen)
            step[chosen] = size
            for length, often in chosen:
                gained[length] += size * often / demand[length]
        scale = 1 / (rounds * max(gained.max(), 1e-12)) * 4
        covered += gained * scale
        for chosen, size in step.items():
            weights[chosen] = weights.get(chosen, 0.0) + size * scale
    least = max(float(np.median(covered[needed])), 1e-9)
    return {chosen: weight / least for chosen, weight in weights.items()}


def best_fit(demand: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Best fit, longest first, with all equal pieces and equal bins handled together."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in sorted(demand, reverse=True):
        left = demand[length]
        while left:
            room = min((r for r in bins if r >= length), default=0)
            held, many = bins[room].pop() if room else ({}, left)
            room_now = room or capacity
            each = min(room_now // length, left)
            used = min(many, left // each)
            if room and not bins[room]:
                del bins[room]
            if room and used < many:
                bins.setdefault(room, []).append((held, many - used))
            bins.setdefault(room_now - each * length, []).append((held | {length: each}, used))
            left -= each * used
    return [(tuple(sorted(held.items(), reverse=True)), many) for room in sorted(bins) for held, many in bins[room]]


def plan(demand: dict[int, int], capacity: int = CAPACITY, passes: int = 3) -> list[tuple[Configuration, int]]:
    """Configurations and how often each is used, so that every piece of the histogram gets exactly one place."""
    left = np.zeros(capacity + 1)
    for length, many in demand.items():
        left[length] = many
    out = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for _ in range(passes):
        if not left.any():
            break
        cover = fractional_cover(left, capacity)
        for chosen, weight in sorted(cover.items(), key=lambda x: (-x[1], x[0])):
            if sum(length * often for length, often in chosen) < capacity:
                continue  # a configuration with a gap is left to the best fit, which may still fill the gap
            if many := int(min(np.ceil(weight), *(left[length] // often for length, often in chosen))):
                out.append((chosen, many))
                for length, often in chosen:
                    left[length] -= often * many
    return out + best_fit({int(length): int(left[length]) for length in np.flatnonzero(left)}, capacity)


def places(planned: list[tuple[Configuration, int]]) -> dict[str, np.ndarray]:
    """For runs of ranks within a length: first sequence, pieces per sequence, and the offset of the first of them."""
    rows, seen, sequence = [], {}, 0
    for chosen, many in planned:
        offset = 0
        for length, often in chosen:
            first = seen.get(length, 0)
            rows.append((length, first, sequence, often, offset))
            seen[length] = first + often * many
            offset += length * often
        sequence += many
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 44 | table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "often": table[:, 3], "offset": table[:, 4]}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.  ``cut_pieces`` is computed once, into the checkpoint folder."""
    kept = cut(cut_pieces)
    rows = kept.count()
    salts = max(8, rows // PER_SALT)
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    demand = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(demand, capacity))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.select(*PIECES.names, (F.col("rank") + F.col("before")).alias("rank"))
    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def body(batches):
        for batch in batches:
            length, rank = np.array(batch["length"], dtype=np.int64), np.array(batch.pop("rank"), dtype=np.int64)
            run = np.searchsorted(where["key"], length << 44 | rank, side="right") - 1
            instance, slot = np.divmod(rank - where["first"][run], where["often"][run])
            yield batch | {"sequence_id": where["sequence"][run] + instance, "offset": where["offset"][run] + slot * length}

    return map_batches(ranked, body, schema)
