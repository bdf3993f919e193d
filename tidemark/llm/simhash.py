"""Near-duplicate groups by SimHash fingerprints that differ in at most two bits.

Method.  A text's fingerprint takes the majority, bit by bit, over the 64-bit hashes of its word shingles.  Two bits
spread over two 32-bit segments leave one segment with at most one differing bit, so two such fingerprints share a
*one-wildcard variant*: a segment with one position blanked.  Every distinct fingerprint is indexed under its 64
variants; fingerprints that meet under a variant are verified with an exact bit count.

Scale.  Equal fingerprints are merged before anything is joined, so copies cost one row.  A variant's members arrive
sorted and are scanned as a stream; nothing is held but the current run, up to ``LEAF`` fingerprints.  A larger run
is not paired up: its members go on to a second and third level, where the other segment is cut in the same way
(16 and 8 bits).  A third-level run has at most 2 ** 11 distinct members by construction, so no pair is ever dropped
and no run is unbounded.  Within a run only links that span its verified groups are kept (a member to the group's
first), never all pairs.  Components of up to ``HELD_LINKS`` links are found in one task; of more, nodes are merged
along links until no more than that are left.

Verified groups.  ``verified_groups`` takes the usual bar for near copies, a Jaccard similarity of 0.8 of five-word
shingles.  Candidates are texts that agree in one of 16 bands of four least hashes of their shingles; a pair at 0.8
misses all bands with a probability of 0.0002, wherever its texts differ and however long they are.  Their similarity
is computed from the 128 smallest shingle hashes of each text (exact up to 128 shingles).  All pairs of a small run are
verified.  In a larger one the sketches are compared in memory, and a member leaves the rest only through a verified
link, so a run's links connect exactly what its verified pairs connect.  Texts equal word by word are one node from the
start.

Runs over ``WIDE_LEAF`` are never one task.  Keys are counted first, and members of such runs are dealt into blocks.  A
few pivots of each run go to all its blocks and link what is near them; later pivots are also the members that most
earlier ones are near.  What a run's largest component then holds needs no comparison within itself, so only the *rest*
of the run, its members of other components, is still to be compared with all others.  Hashes that no other member of a
block has bound the similarity that a member can have to any of them; pairs below the bar by that bound are passed over.  A larger rest than ``GRID``, left after ``ROUNDS`` rounds of pivots, first meets the members that agree in a second band.
Then each run's rest, whatever its size, is compared with the whole run, chunk by block: no pair that shares a band is left out.  A task holds about ``WIDE_LEAF`` and ``GRID`` members.

Edge cases.  Null or wordless text has fingerprint zero and is linked like any other.  Texts with fewer words than a
shingle hash their whole word sequence.  Repeated rows and ties fall together.  A component's id is the smallest
non-null ``doc_id`` in it.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, map_batches

SEED = 42
MAX_BITS = 2
#: Fingerprints of a run that are compared in memory; larger runs go to the next level.
LEAF = 2048
#: Links whose components one task finds (at 16 bytes each, and about 100 while they are sorted).
HELD_LINKS = 2_000_000
#: Shingles that are counted at a time.
CHUNK = 1 << 15

PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("print", T.LongType())])


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are what ASCII white space separates."""
    return (text or "").encode("utf-8", "replace").lower().split()


def fingerprint(tokens: list[bytes], size: int, seed: int = SEED) -> int:
    """The majority fingerprint as a signed 64-bit integer."""
    if not tokens:
        return 0
    n = max(1, len(tokens) - size + 1)
    digest, join = xxhash.xxh64_digest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, n, CHUNK):
        part = tokens[first : min(n, first + CHUNK) + size - 1]
        shifted = [part[k:] for k in range(size)] if len(part) >= size else [[join(part)]]
        hashes = b"".join([digest(join(s), seed) for s in zip(*shifted, strict=False)])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, print`` of every whole text."""

    def body(batches):
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "print": [fingerprint(words(t), shingle) for t in batch["text"]]}

    return map_batches(docs.select("doc_id", "text"), body, PRINTS)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links from each member to the first of its verified group; every link is a path of close pairs in the run."""
    left, links = members, []
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = hamming(left, front.pop()) <= max_bits
            reached, left = left[near], left[~near]
            links += [(int(root), int(x)) for x in reached]
            front += list(reached)
    return links


def scan_runs(batches: Iterator[pa.RecordBatch], max_bits: int, last_level: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From ``key, print`` in order of key: links (key -1) and, but on the last level, members of too large runs (their key)."""
    key_held, held, open_run = None, np.zeros(0, dtype=np.int64), False

    def close() -> list[tuple[int, int]]:
        return spanning(held, max_bits) if len(held) > 1 else []

    for batch in batches:
        keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        links: list[tuple[int, int]] = []
        passed_keys, passed = [], []
        inner = np.arange(len(starts)) > 0
        inner[-1] = False  # the first run may continue the held one, the last may go on in the next batch
        pairs = starts[inner & (sizes == 2)]
        close_pair = hamming(prints[pairs], prints[pairs + 1]) <= max_bits
        links += zip(prints[pairs[close_pair]].tolist(), prints[pairs[close_pair] + 1].tolist(), strict=True)
        whole = inner & (sizes > 2)
        ends = {0, len(starts) - 1}
        for i in [0, *np.flatnonzero(whole).tolist(), len(starts) - 1] if len(starts) > 1 else [0]:
            key, run = keys[starts[i]], prints[starts[i] : starts[i] + sizes[i]]
            if i not in ends:
                if len(run) <= LEAF or last_level:
                    links += spanning(run, max_bits)
                else:
                    passed_keys.append(np.full(len(run), key))
                    passed.append(run)
                continue
            if key != key_held:
                links += close()
                key_held, held, open_run = key, np.zeros(0, dtype=np.int64), False
            if not open_run:
                held = np.concatenate([held, run])
                if len(held) > LEAF and not last_level:
                    open_run, run, held = True, held, np.zeros(0, dtype=np.int64)
            if open_run:
                passed_keys.append(np.full(len(run), key))
                passed.append(run)
        ends_links = np.array(links, dtype=np.int64).reshape(-1, 2)
        yield np.full(len(ends_links), -1), ends_links[:, 0], ends_links[:, 1]
        if passed:
            members = np.concatenate(passed)
            yield np.concatenate(passed_keys), members, members
    last = np.array(close(), dtype=np.int64).reshape(-1, 2)
    yield np.full(len(last), -1), last[:, 0], last[:, 1]


def segment_variants(print_column, low: int, width: int, code: int):
    """Keys of the segment of ``width`` bits from bit ``low`` with each position blanked, told apart by ``code``."""
    segment = F.shiftrightunsigned(print_column, low).bitwiseAND(F.lit((1 << width) - 1))
    return [segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << p))) + F.lit((code * width + p) << width) for p in range(width)]


def close_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (``a``, ``b``) that connect exactly what pairs of at most ``max_bits`` (up to 2) differing bits connect."""
    if max_bits > 2:
        raise ValueError("two segments with one wildcard reach at most two differing bits at every level")
    schema = "key long, a long, b long"

    def level(rows: DataFrame, last_level: bool) -> DataFrame:
        names = ["key", "a", "b"]

        def run(batches):
            for columns in scan_runs(batches, max_bits, last_level):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)

        dealt = rows.select("key", "print").repartition(F.col("key")).sortWithinPartitions("key", "print")
        return dealt.mapInArrow(run, schema)

    own = F.col("print")
    first = distinct.select("print", F.explode(F.array(*segment_variants(own, 0, 32, 0), *segment_variants(own, 32, 32, 1))).alias("key"))
    found = cut(level(first, False).distinct())
    links = [found.where("key = -1")]
    over = found.where("key != -1").select("key", F.col("a").alias("print"))
    if not over.isEmpty():
        # bit 37 of a first-level key says which segment was blanked; the other one is cut into halves, then quarters
        other = F.when(F.shiftrightunsigned("key", 37) == 0, F.shiftrightunsigned(own, 32)).otherwise(own)
        halves = F.array(*segment_variants(other, 0, 16, 0), *segment_variants(other, 16, 16, 1))
        second = over.select("print", F.posexplode(halves).alias("at", "variant"), "key").select(
            "print", F.xxhash64("key", "variant").alias("key"), (F.shiftrightunsigned("key", 37) * 2 + F.floor(F.col("at") / 16)).alias("half")
        )
        # the half travels inside the key, so that the third level knows what is left
        second = second.select("print", F.shiftleft(F.shiftrightunsigned("key", 3), 2).bitwiseOR(F.col("half")).alias("key"))
        found = cut(level(second, False).distinct())
        links.append(found.where("key = -1"))
        over = found.where("key != -1").select("key", F.col("a").alias("print"))
        if not over.isEmpty():
            half = F.col("key").bitwiseAND(F.lit(3))
            rest = F.when(half == 0, F.shiftrightunsigned(own, 48)).when(half == 1, F.shiftrightunsigned(own, 32)).when(half == 2, F.shiftrightunsigned(own, 16)).otherwise(own)
            quarters = F.array(*segment_variants(rest, 0, 8, 0), *segment_variants(rest, 8, 8, 1))
            third = over.select("print", "key", F.explode(quarters).alias("variant")).select("print", F.xxhash64("key", "variant").alias("key"))
            links.append(level(third, True).distinct())
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.select("a", "b").distinct()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked nodes in order, and the least node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    first, second = at[: len(a)], at[len(a) :]
    while len(first):
        np.minimum.at(label, np.maximum(first, second), np.minimum(first, second))
        while not np.array_equal(further := label[label], label):
            label = further
        first, second = label[first], label[second]
        apart = first != second
        first, second = first[apart], second[apart]
    return nodes, nodes[label]


def components(links: DataFrame, turn: int = 0) -> DataFrame:
    """``node, label`` for every linked node: the least node that it can reach.

    Up to ``HELD_LINKS`` links are joined in one task; more are merged along links until no more than that are left.
    """
    kept = cut(links.select("a", "b"))
    if kept.count() > HELD_LINKS:
        return merged(kept, turn)

    def run(batches):
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            nodes, labels = least_reachable(*map(np.concatenate, zip(*parts, strict=True)))
            for first in range(0, len(nodes), CHUNK):
                columns = [pa.array(x[first : first + CHUNK], type=pa.int64()) for x in (nodes, labels)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "label"])

    return cut(kept.coalesce(1).mapInArrow(run, "node long, label long"))


def merged(links: DataFrame, turn: int) -> DataFrame:
    """``components``: each node merges into the first of itself and its neighbours, in an order drawn anew each turn."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("near"))
    hop = both.groupBy("a").agg(F.min(rank("b")).alias("first")).select(F.col("a").alias("node"), F.least("first", rank("a")).getField("near").alias("near"))
    hop = cut(hop)
    left, right = hop.select(F.col("node").alias("a"), F.col("near").alias("x")), hop.select(F.col("node").alias("b"), F.col("near").alias("y"))
    fewer = links.join(left, "a").join(right, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    further = components(fewer, turn + 1).select(F.col("node").alias("near"), F.col("label").alias("of"))
    named = cut(hop.join(further, "near", "left").select("node", F.coalesce("of", "near").alias("of")))
    return cut(named.join(named.groupBy("of").agg(F.min("node").alias("label")), "of").select("node", "label"))


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``print, component_id`` of the distinct fingerprints of ``doc_id, print`` rows."""
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    labels = components(close_links(distinct, max_bits))
    named = distinct.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return named.select("print", "label").join(least, "label").select("print", "component_id")


def groups(docs: DataFrame, *, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, print, component_id`` for every row of ``docs``."""
    prints = cut(fingerprints(docs, shingle))
    return prints.join(classes(prints, max_bits), "print").select("doc_id", "print", "component_id")


#: Verified groups: words per shingle, least similarity, and hashes kept of a text.
SHINGLE, SIMILARITY, SKETCH = 5, 0.8, 128
#: Bands of least hashes, and hashes in a band.
BANDS, BAND_ROWS = 16, 4
#: Members of a run whose pairs are all verified one by one.
PAIRED = 32
#: Members of a run, or of a block of a larger run, that ``verified_groups`` compares in memory.
WIDE_LEAF = 4096
#: Members of a larger run's rest that meet a block at a time, and pivots of a round, half of them from the rest.
GRID, PIVOTS, ROUNDS = 2048, 8, 3
#: Copies of a table with a row for each large run, so that its join with the members has no hot key.
SALTS = 64
#: Bytes of large runs' keys up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Multipliers and increments of the hash functions whose least values make the bands.
_MIX = np.frombuffer(b"".join(xxhash.xxh64_digest(b"%d" % i, SEED) for i in range(2 * BANDS * BAND_ROWS)), dtype="<u8").reshape(2, -1, 1) | np.uint64(1)

PROFILES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("print", T.LongType()),
        T.StructField("content_a", T.LongType()),
        T.StructField("content_b", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def shingles(tokens: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of the whole text, in order."""
    digest, join = xxhash.xxh32_digest, b" ".join
    n = max(1, len(tokens) - size + 1) if tokens else 0
    parts = [np.zeros(0, dtype=">u4")]
    for first in range(0, n, CHUNK):
        part = tokens[first : min(n, first + CHUNK) + size - 1]
        shifted = [part[k:] for k in range(size)] if len(part) >= size else [[join(part)]]
        parts.append(np.frombuffer(b"".join([digest(join(s), SEED) for s in zip(*shifted, strict=False)]), dtype=">u4"))
    return np.unique(np.concatenate(parts).astype(np.uint32))


def sketch(tokens: list[bytes], size: int = SHINGLE, kept: int = SKETCH) -> bytes:
    """The smallest distinct shingle hashes of the whole text, in order."""
    return shingles(tokens, size)[:kept].astype(">u4").tobytes()


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of least hashes; equal where all hashes of the band are."""
    least = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, dtype=np.uint64)
    for first in range(0, len(hashes), 2048):
        mixed = hashes[first : first + 2048].astype(np.uint64) * _MIX[0] + _MIX[1]
        least = np.minimum(least, mixed.min(axis=1))
    raw, width = least.tobytes(), 8 * BAND_ROWS
    # never negative: that marks a link
    return [xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) >> 1 for k in range(BANDS)]


def similarity(a: bytes, b: bytes, kept: int = SKETCH) -> float:
    """Jaccard similarity: the share of both among the smallest of the union."""
    left, right = np.frombuffer(a, dtype=">u4"), np.frombuffer(b, dtype=">u4")
    union = np.union1d(left, right)
    if len(left) >= kept or len(right) >= kept:
        union = union[:kept]
    return len(np.intersect1d(np.intersect1d(left, right, True), union, True)) / len(union) if len(union) else 1.0


def similarities(one: np.ndarray, many: np.ndarray, sizes: np.ndarray, kept: int = SKETCH) -> np.ndarray:
    """``similarity`` of a sketch to every row of ``many``, of which the first ``sizes`` values count."""
    if not len(one):
        return (sizes == 0).astype(float)
    at = np.searchsorted(one, many)
    column = np.arange(many.shape[1])
    same = (one[np.minimum(at, len(one) - 1)] == many) & (column < sizes[:, None])
    union = len(one) + sizes - same.sum(axis=1)
    union = np.where((sizes >= kept) | (len(one) >= kept), np.minimum(union, kept), union)
    place = column + at - (np.cumsum(same, axis=1) - same)
    return (same & (place < union[:, None])).sum(axis=1) / union


def profiles(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Of every whole text, in one pass: its fingerprint, a hash of its words in order, its bands, and its sketch."""

    def body(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in PROFILES}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = words(text)
                content = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(tokens)), dtype="<i8")
                hashes = shingles(tokens)
                kept = hashes[:SKETCH].astype(">u4").tobytes()
                for name, value in zip(out, (doc_id, fingerprint(tokens, shingle), int(content[0]), int(content[1]), band_keys(hashes), kept), strict=True):
                    out[name].append(value)
            yield out

    return map_batches(docs.select("doc_id", "text"), body, PROFILES)


def sketch_table(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sketches as rows of one array, and how many values of each row count."""
    sizes = np.array([len(x) // 4 for x in sketches])
    values = np.zeros((len(sketches), max(1, int(sizes.max()))), dtype=np.uint32)
    for row, raw in zip(values, sketches, strict=True):
        row[: len(raw) // 4] = np.frombuffer(raw, dtype=">u4")
    return values, sizes


def shared_values(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each row's first ``sizes`` values some other row has too."""
    row, column = np.nonzero(np.arange(values.shape[1]) < sizes[:, None])
    _, which, many = np.unique(values[row, column], return_inverse=True, return_counts=True)
    return np.bincount(row, weights=many[which] > 1, minlength=len(values)).astype(np.int64)


def most_similar(at: int, others: np.ndarray, shared: np.ndarray, sizes: np.ndarray, kept: int = SKETCH) -> np.ndarray:
    """What ``similarity`` of row ``at`` to ``others`` is at most: two rows have no more in common than either shares with any."""
    common = np.minimum(shared[others], shared[at])
    union = np.where((sizes[others] >= kept) | (sizes[at] >= kept), kept, sizes[others] + sizes[at] - common)
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def linked(sketches: list[bytes], nodes: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Verified links that span what verified pairs connect among the members.

    Members that share most with others come first; pairs that cannot reach ``least`` are passed over.
    """
    values, sizes = sketch_table(sketches)
    shared = shared_values(values, sizes)
    left, links = np.argsort(-shared, kind="stable"), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            own = values[at, : sizes[at]]
            near = most_similar(at, left, shared, sizes) >= least
            able = left[near]
            if len(able):
                near[near] = np.concatenate([similarities(own, values[part], sizes[part]) for part in np.split(able, range(4096, len(able), 4096))]) >= least
            reached, left = left[near], left[~near]
            links += [(int(nodes[at]), int(nodes[x])) for x in reached]
            front += list(reached)
    return links


def all_pairs(members: np.ndarray) -> list[tuple[int, int]]:
    first, second = np.triu_indices(len(members), 1)
    return list(zip(members[first].tolist(), members[second].tolist(), strict=True))


def run_links(rows: DataFrame, leaf: int | None, inside: Callable[[list[np.ndarray]], list[tuple[int, int]]]) -> DataFrame:
    """Of rows from ``key, node``: links (key -1) that ``inside`` finds in each run of a key, and members of runs over ``leaf``."""
    names = ["key", "a", "b"]

    def run(batches):
        def record(keys, first, second):
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (keys, first, second)], names=names)

        held: list[pa.RecordBatch] = []  # parts of the run that the last batch left open
        key_held, many, over = None, 0, False

        def close():
            """The links of the held run."""
            found = []
            if many > 1 and not over:
                columns = [np.concatenate([part.column(i).to_numpy(zero_copy_only=False) for part in held]) for i in range(1, held[0].num_columns)]
                found = inside(columns)
            return found

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
            found, passed_keys, passed = [], [], []
            for start, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != key_held:
                    found += close()
                    key_held, held, many, over = keys[start], [], 0, False
                held.append(batch.slice(start, stop - start))
                many += stop - start
                over = over or (leaf is not None and many > leaf)
                if over:  # its members go on as they come
                    passed += [part.column(1).to_numpy() for part in held]
                    passed_keys += [np.full(part.num_rows, key_held) for part in held]
                    held = []
            ends = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield record(np.full(len(ends), -1), ends[:, 0], ends[:, 1])
            if passed:
                yield record(np.concatenate(passed_keys), np.concatenate(passed), np.concatenate(passed))
        ends = np.array(close(), dtype=np.int64).reshape(-1, 2)
        yield record(np.full(len(ends), -1), ends[:, 0], ends[:, 1])

    return rows.repartition(F.col("key")).sortWithinPartitions("key", "node").mapInArrow(run, "key long, a long, b long")


def block_links(columns: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Of ``node, label, asks, sketch``: verified links that join, between all labels, what those of askers to any member join.

    Members that share most with others ask first; pairs that cannot reach ``least`` are passed over.
    """
    nodes, labels, asks, sketches = columns
    values, sizes = sketch_table(sketches)
    shared = shared_values(values, sizes)
    standing = np.unique(labels, return_inverse=True)[1]
    links = []
    askers = np.flatnonzero(asks)
    for at in askers[np.argsort(-shared[askers], kind="stable")].tolist():
        own = values[at, : sizes[at]]
        others = np.flatnonzero(standing != standing[at])
        others = others[most_similar(at, others, shared, sizes) >= least]
        for part in np.split(others, range(4096, len(others), 4096)):
            near = part[similarities(own, values[part], sizes[part]) >= least]
            for x in near[np.unique(standing[near], return_index=True)[1]].tolist():
                if standing[x] != standing[at]:
                    links.append((int(nodes[at]), int(nodes[x])))
                    standing[standing == standing[x]] = standing[at]
    return links


def asked(askers: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links of ``key, node, label`` askers with the members of their key, in blocks of members and chunks of askers."""
    sizes = askers.groupBy("key").agg(F.count("*").alias("asking")).join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    sizes = sizes.select("key", F.ceil(F.col("n") / WIDE_LEAF).alias("blocks"), F.ceil(F.col("asking") / GRID).alias("chunks"))
    sizes = cut(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salt = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int").alias("salt")
    place = lambda many, seed: F.pmod(F.xxhash64("node", F.lit(seed)), many)

    def dealt(rows: DataFrame, asks: bool) -> DataFrame:
        at = rows.select("key", "node", "label", salt).join(sizes, ["key", "salt"])
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)) if asks else place(F.col("blocks"), 2)
        at = at.select("key", "node", "label", "chunks", block.alias("block"))
        chunk = place(F.col("chunks"), 3) if asks else F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
        return at.select("key", "node", "label", "block", chunk.alias("chunk"), F.lit(asks).alias("asks"))

    rows = dealt(askers, True).unionByName(dealt(members, False))
    rows = rows.select(F.xxhash64("key", "block", "chunk").alias("key"), "node", "label", F.col("asks").cast("long").alias("asks"))
    rows = rows.groupBy("key", "node").agg(F.min("label").alias("label"), F.max("asks").alias("asks"))
    rows = rows.join(nodes.select("node", "sketch"), "node").select("key", "node", "label", "asks", "sketch")
    return run_links(rows, None, block_links).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def standings(over: DataFrame, links: DataFrame) -> DataFrame:
    """Members (``key, node, label``) of the runs that ``links`` do not connect whole, with the run's largest component, ``core``, and how many are not in it."""
    named = cut(over.join(components(links), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    runs = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
    runs = runs.agg(F.max_by("label", F.struct("n", "label")).alias("core"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    runs = cut(runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int"))
    return cut(salted.join(runs, ["key", "salt"]).select("key", "node", "label", "core", "rest"))


def pivots(members: DataFrame, turn: int) -> DataFrame:
    """A few of each run's members, half of them from its rest; other ones each turn."""
    row = lambda i: F.struct(F.xxhash64("node", F.lit(turn * PIVOTS + i)).alias("draw"), "node", "label")
    drawn = [F.min(row(i) if i % 2 else F.when(~F.col("label").eqNullSafe(F.col("core")), row(i))) for i in range(PIVOTS)]
    return cut(members.groupBy("key").agg(F.array(*drawn).alias("drawn")).select("key", F.explode("drawn").alias("one")).where("one IS NOT NULL").select("key", "one.node", "one.label").distinct())


def hubs(members: DataFrame, links: DataFrame, earlier: DataFrame) -> DataFrame:
    """The members of each run with most links so far, ``earlier`` ones left out: what many pivots are near is a group's middle."""
    linked_to = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    of = members.select("key", "node", "label").join(linked_to, "node").join(earlier.select("node").distinct(), "node", "left_anti")
    # limited to a few rows a key before the shuffle, too
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "node"))
    return cut(of.withColumn("place", place).where(F.col("place") <= PIVOTS // 2).select("key", "node", "label"))


def wide_links(over: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and those that verified pairs add within the runs of ``over`` (``key, node``), whatever their size."""
    # near copies share most bands: each member first asks in one run only
    members = cut(over.groupBy("node").agg(F.min("key").alias("key")).select("key", "node", F.col("node").alias("label"), F.lit(None).cast("long").alias("core")))
    drawn = pivots(members, 0)
    links = cut(links.unionByName(asked(drawn, members, nodes)).distinct())
    for turn in range(1, ROUNDS):
        members = standings(over, links)
        large = members.where(F.col("rest") > GRID)
        if large.isEmpty():
            break
        asking = pivots(large, turn).unionByName(hubs(large, links, drawn)).distinct()
        drawn = cut(drawn.unionByName(asking))
        links = cut(links.unionByName(asked(asking, large, nodes)).distinct())
    else:
        members = standings(over, links)
    rest = F.col("label") != F.col("core")
    large = members.where(F.col("rest") > GRID)
    if not large.isEmpty():
        # near copies mostly agree in two bands: the lesser one is the key, or that run is done
        other = large.join(nodes.select("node", "bands"), "node").select("key", "node", "label", rest.alias("asks"), F.explode("bands").alias("band")).where("band > key")
        other = cut(other.select(F.xxhash64("key", "band").alias("key"), "node", "label", "asks"))
        askers = other.where("asks").select("key", "node", "label")
        links = cut(links.unionByName(asked(askers, other.join(askers.select("key").distinct(), "key", "left_semi"), nodes)).distinct())
        members = standings(over, links)
    # whatever its size, a run's rest meets the whole run: pairs that agree in this one band alone are found here
    return cut(links.unionByName(asked(members.where(rest), members, nodes)).distinct())


def verified_links(nodes: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that span what verified pairs of ``node, bands, sketch`` rows connect within each band."""
    small, leaf = min(PAIRED, WIDE_LEAF), WIDE_LEAF

    def in_memory(columns):
        members, sketches = columns
        return linked(list(sketches), members)

    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    hot = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("key"))
    many = hot.count()
    if many:
        hot = F.broadcast(hot) if 8 * many <= BROADCAST_BYTES else hot
        over, keyed = cut(keyed.join(hot, "key", "left_semi")), keyed.join(hot, "key", "left_anti")
    first = cut(run_links(keyed, small, lambda columns: all_pairs(columns[0])))
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    out = verify(first.where("key = -1").select(*ends).distinct(), nodes)
    middle = first.where("key != -1").select("key", F.col("a").alias("node"))
    if not middle.isEmpty():
        out = out.unionByName(run_links(middle.join(nodes, "node").select("key", "node", "sketch"), None, in_memory).select(*ends))
    out = cut(out.distinct())
    return wide_links(over, nodes, out) if many else out


def verify(links: DataFrame, nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The links whose texts are similar enough."""
    left, right = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("left")), nodes.select(F.col("node").alias("b"), F.col("sketch").alias("right"))

    def body(batches):
        for batch in batches:
            rows = zip(batch["a"], batch["b"], batch["left"], batch["right"], strict=True)
            kept = [(a, b) for a, b, x, y in rows if similarity(x, y) >= least]
            yield {"a": [a for a, _ in kept], "b": [b for _, b in kept]}

    return map_batches(links.join(left, "a").join(right, "b").select("a", "b", "left", "right"), body, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def verified_classes(known: DataFrame) -> DataFrame:
    """``content_a, content_b, component_id`` of the distinct texts of ``profiles`` rows."""
    nodes = cut(known.groupBy("content_a", "content_b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    labels = components(verified_links(nodes.where("node IS NOT NULL")))
    return nodes.select("content_a", "content_b", "node").join(labels, "node", "left").select("content_a", "content_b", F.coalesce("label", "node").alias("component_id"))


def verified_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for every row: texts equal word by word, and verified near copies, fall together."""
    known = cut(profiles(docs))
    return known.select("doc_id", "content_a", "content_b").join(verified_classes(known), ["content_a", "content_b"]).select("doc_id", "component_id")


def joined_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id``: what ``groups`` or ``verified_groups`` puts together; rows with one id must have one text.

    Texts are read once for both.  Rows without an id take no part.
    """
    known = cut(profiles(docs.where("doc_id IS NOT NULL")))
    prints = known.select("doc_id", "print", "content_a", "content_b")
    one = classes(prints.select("doc_id", "print")).withColumnRenamed("component_id", "one")
    two = verified_classes(known).withColumnRenamed("component_id", "two")
    # equal texts have equal fingerprints: one row a text is enough for both
    texts = prints.groupBy("content_a", "content_b").agg(F.first("print").alias("print"))
    both = cut(texts.join(one, "print").join(two, ["content_a", "content_b"]).select("content_a", "content_b", "one", "two"))
    labels = components(both.where("one != two").select(F.col("one").alias("a"), F.col("two").alias("b")).distinct())
    named = both.join(labels.withColumnRenamed("node", "one"), "one", "left").select("content_a", "content_b", F.coalesce("label", "one").alias("component_id"))
    return prints.select("doc_id", "content_a", "content_b").join(named, ["content_a", "content_b"]).select("doc_id", "component_id")
