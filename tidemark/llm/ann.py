"""Nearest neighbours by inner product: probed lists, scanned with early abandoning over rotated dimensions.

Method.  Vectors get one more coordinate that makes all of them equally long, so that the largest inner product is the
smallest distance, and are rotated at random.  A clustering of a bounded sample gives lists.  A query probes its
nearest lists.  Within a list the rotated coordinates are read in column blocks; after each block a hypothesis test
compares the partial distance with the one that is still good enough: after b of D dimensions a candidate is abandoned
when its partial distance exceeds ``limit * b / D * (1 + EPSILON / sqrt(b)) ** 2``.  The limit starts as the distance
to the k-th neighbour within the sample (an upper bound of the true one) and falls while lists are scanned.  What
survives all blocks is scored exactly: the inner product of the original vectors, added up in double precision.

Lists.  There is one for about every ``LIST_ROWS`` vectors.  Beyond ``FIRST_LEVEL`` of them they have two levels: the
nearest centre, and the nearest of a second set of centres to what is left of the vector.  Both sets come from the
sample (``SAMPLE`` rows, less for long vectors), so the number of lists may grow to ``MOST_LISTS`` while the sample does
not.  How many lists a query probes is measured on the sample's own neighbours (``TARGET``).

Scale.  Equal vectors are merged first and keep their k + 1 smallest ids, which is all that any query can return of
them.  Neighbouring lists stand together on *shelves* of at most ``SHELF_ROWS`` vectors (a larger list is cut by hash).
A stored vector is sent to its shelf once, and only if some query asks for its list; a query is sent once to each shelf
that it asks.  On a shelf the vectors come first and stay in memory, and the queries stream past them.  Only a shelf
that more than ``SHELF_QUERIES`` queries ask is copied, once for every further ``SHELF_QUERIES``; this bounds a task
and adds at most one vector for every ``SHELF_QUERIES / SHELF_ROWS`` queries sent.  Every row is indexed.  A query
that ends with too few neighbours scans its lists again without abandoning; these hold enough rows by choice.

Edge cases.  Vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part.
Ids are taken to be unique: no row with a query's id is its candidate.  Extra columns are ignored.
Vectors of different lengths are not comparable: each length is searched for itself.  Fewer than k other vectors: all
of them.  Equal scores go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, hashed_fraction, small_parts

#: Vectors of a list on average, lists of the first level, and lists at most.
LIST_ROWS, FIRST_LEVEL, MOST_LISTS = 512, 1024, 1 << 18
#: Stored vectors of a shelf, and queries that pass it in one task.
SHELF_ROWS, SHELF_QUERIES = 8192, 32_768
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
EPSILON = 2.1
#: Column blocks per vector.
COLUMNS = 4
#: The share of the sample's true neighbours that the probed lists must hold.
TARGET = 0.96
#: Rows that are compared at a time.
STEP = 1024

RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part; single precision stays as it is, all else becomes double."""
    narrow = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    typed = vectors.select("vec_id", F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))
    return typed.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))


@dataclass
class Index:
    """Rotation, the square of the common length, centres of both levels, the rotated sample, and what to probe.

    ``cross`` is what both centres together add to a distance, ``sizes`` the vectors of each list; ``near`` says how
    many lists of the first level are looked into, ``probes`` how many lists are scanned.
    """

    rotation: np.ndarray
    length2: float
    k: int
    centres: np.ndarray
    finer: np.ndarray
    sample: np.ndarray
    cross: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    near: int = 1
    probes: int = 1

    @property
    def width(self) -> int:
        return self.rotation.shape[0] - 1

    @property
    def lists(self) -> int:
        return len(self.centres) * len(self.finer)

    def rotated(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows with the added coordinate (zero for a query), rotated."""
        extra = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.length2 - (rows * rows).sum(axis=1), 0))
        return np.column_stack([rows, extra]) @ self.rotation

    def at_once(self, near: int) -> int:
        """Queries whose lists are ranked together."""
        return max(1, min(128, (1 << 21) // (min(near, len(self.centres)) * len(self.finer))))

    def list_of(self, rows: np.ndarray) -> np.ndarray:
        """The list of each rotated row."""
        first = nearest(rows, self.centres)
        return first * len(self.finer) + nearest(rows - self.centres[first], self.finer)

    def ranked(self, rows: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """For each rotated query the lists in the ``near`` first centres, nearest first, and their sizes."""
        coarse = squared(rows, self.centres)
        near = min(near, len(self.centres))
        chosen = np.argpartition(coarse, near - 1, axis=1)[:, :near]
        base = np.take_along_axis(coarse, chosen, axis=1)
        # the distance to the sum of both centres, from products that are there already
        away = base[:, :, None] + self.cross[chosen] - 2 * (rows @ self.finer.T)[:, None, :]
        lists = (chosen[:, :, None] * len(self.finer) + np.arange(len(self.finer))).reshape(len(rows), -1)
        away = np.where(self.sizes[lists] > 0, away.reshape(len(rows), -1), np.inf)
        order = np.argsort(away, axis=1, kind="stable")
        lists = np.take_along_axis(lists, order, axis=1)
        return lists, self.sizes[lists]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    out *= -2
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)
    return np.maximum(out, 0, out=out)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if len(centres) == 1:
        return np.zeros(len(rows), dtype=np.int64)
    return np.concatenate([squared(rows[i : i + 1024], centres).argmin(axis=1) for i in range(0, len(rows), 1024)] or [np.zeros(0, dtype=np.int64)])


def cluster(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres by k-means, from evenly spaced rows."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def shelved(centres: np.ndarray) -> np.ndarray:
    """An order in which centres that are near stand near: halves along the widest direction, again and again."""
    out, open_parts = [], [np.arange(len(centres))]
    while open_parts:
        part = open_parts.pop()
        if len(part) <= 2:
            out += part.tolist()
            continue
        gaps = centres[part] - centres[part].mean(axis=0)
        along = gaps @ np.linalg.svd(gaps, full_matrices=False)[2][0]
        order = part[np.argsort(along, kind="stable")]
        open_parts += [order[len(order) // 2 :], order[: len(order) // 2]]
    return np.array(out, dtype=np.int64)


def build(distinct: DataFrame, k: int, seed: int = 1) -> Index | None:
    """Centres from a bounded sample, list sizes and the common length from all rows, and what to probe."""
    total = distinct.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("most")).first()
    if not total.n:
        return None
    bound = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * total.d)))
    drawn = distinct.where(hashed_fraction(F.col("embedding")) < min(1.0, bound / total.n)).select("rep", "embedding").collect()
    drawn = drawn or distinct.limit(1).select("rep", "embedding").collect()
    rows = np.array([r.embedding for r in sorted(drawn, key=lambda r: r.rep)], dtype=float)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(total.d + 1, total.d + 1)))[0]
    none = np.zeros((0, total.d + 1))
    index = Index(rotation, total.most * (1 + 1e-12), k, none, none, none)
    index.sample = index.rotated(rows)
    wanted = min(MOST_LISTS, -(-total.n // LIST_ROWS))
    first = min(wanted, FIRST_LEVEL, max(1, len(rows) // 8))
    shuffled = index.sample[rng.permutation(len(rows))]
    index.centres = cluster(shuffled, first)
    index.centres = index.centres[shelved(index.centres)]
    second = min(-(-wanted // first), max(1, len(rows) // 8))
    index.finer = cluster(shuffled - index.centres[nearest(shuffled, index.centres)], second) if second > 1 else np.zeros((1, total.d + 1))
    index.cross = 2 * (index.centres @ index.finer.T) + (index.finer * index.finer).sum(axis=1)
    index.sizes = list_sizes(distinct, index)
    pilots = rng.choice(len(rows), min(256, len(rows)), replace=False)
    asked = index.rotated(rows[pilots], query=True)
    own = index.list_of(index.sample)[np.argsort(squared(asked, index.sample), axis=1)[:, : min(k + 1, len(rows))]]
    places = np.argsort(squared(asked, index.centres), axis=1).argsort(axis=1)
    needed = np.take_along_axis(places, own // len(index.finer), axis=1) + 1
    index.near = int(np.quantile(needed, (1 + TARGET) / 2, method="higher"))
    deep = []
    for query, wanted in zip(asked, own, strict=True):
        lists = index.ranked(query[None, :], index.near)[0][0]
        order = np.argsort(lists)
        at = order[np.minimum(np.searchsorted(lists, wanted, sorter=order), len(lists) - 1)]
        deep.append(np.where(lists[at] == wanted, at, len(lists) - 1) + 1)
    index.probes = int(np.quantile(np.concatenate(deep), TARGET, method="higher"))
    return index


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def list_sizes(distinct: DataFrame, index: Index) -> np.ndarray:
    """How many vectors each list holds."""

    def count(batches):
        sizes = np.zeros(index.lists, dtype=np.int64)
        for batch in small_parts(batches):
            sizes += np.bincount(index.list_of(index.rotated(_matrix(batch.column(0), index.width))), minlength=index.lists)
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used])], names=["list", "n"])

    out = np.zeros(index.lists, dtype=np.int64)
    for row in distinct.select("embedding").mapInArrow(count, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
        out[row.list] = row.n
    return out


def shelves(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first shelf of each list, how many shelves it takes, and how many there are; lists stay in order."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    at, room = -1, 0
    for i, n in enumerate(sizes.tolist()):
        if n > rows:
            parts[i] = -(-n // rows)
            first[i], at, room = at + 1, at + int(parts[i]), 0
        else:
            if n > room:
                at, room = at + 1, rows
            first[i], room = max(at, 0), room - n
    return first, parts, at + 1


def dealt(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A repeatable number below ``parts`` for each key."""
    mixed = (keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def blocks_of(rows: np.ndarray, query: bool) -> list[np.ndarray]:
    """Column blocks of rotated rows with one more column, so that a query's product with a row is their partial distance
    but for the query's own part."""
    edges = np.linspace(0, rows.shape[1], COLUMNS + 1).astype(int)
    out = []
    for start, stop in zip(edges, edges[1:], strict=False):
        part = rows[:, start:stop]
        out.append(np.column_stack([-2 * part, np.ones(len(rows))] if query else [part, (part * part).sum(axis=1)]))
    return out


class Running:
    """The best rows found so far for some queries, by exact score and then by the smaller name, and the falling limits."""

    def __init__(self, index: Index, queries: np.ndarray, limits: np.ndarray):
        self.index, self.raw = index, queries
        rotated = index.rotated(queries, query=True)
        self.blocks = blocks_of(rotated, True)
        self.ends = np.linspace(0, rotated.shape[1], COLUMNS + 1).astype(int)[1:]
        self.own = np.cumsum(rotated * rotated, axis=1)[:, self.ends - 1]
        self.length2 = (queries * queries).sum(axis=1) + index.length2
        self.limit = limits.copy()
        shape = len(queries), index.k + 1
        self.score, self.row = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max)

    def bars(self, who: np.ndarray) -> np.ndarray:
        """How large the products with a row may be after each block, for each query."""
        d = self.ends[-1]
        factor = np.where(self.ends == d, 1.0, self.ends / d * (1 + EPSILON / np.sqrt(self.ends)) ** 2)
        return self.limit[who, None] * factor - self.own[who]

    def add(self, qi: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        wanted = self.score.shape[1]
        touched = np.unique(qi)
        owner = np.concatenate([qi, np.repeat(touched, wanted)])
        score = np.concatenate([score, self.score[touched].ravel()])
        row = np.concatenate([row, self.row[touched].ravel()])
        order = np.lexsort((row, -score, owner))
        owner, score, row = owner[order], score[order], row[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = rank < wanted
        self.score[owner[best], rank[best]], self.row[owner[best], rank[best]] = score[best], row[best]
        bar = self.length2[touched] - 2 * self.score[touched, -1]
        self.limit[touched] = np.minimum(self.limit[touched], bar + 1e-9 * np.abs(self.length2[touched]))


def survivors(running: Running, who: np.ndarray, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a row that no block's test abandons.

    While many pairs are left a block is one matrix product; once few are, only those are computed.
    """
    bars = running.bars(who)
    total = running.blocks[0][who] @ blocks[0].T
    alive = total <= bars[:, :1]
    qi = xi = so_far = None
    for b in range(1, len(blocks)):
        if qi is None:
            left = np.count_nonzero(alive)
            if left * 16 >= alive.size:
                total += running.blocks[b][who] @ blocks[b].T
                alive &= total <= bars[:, b : b + 1]
                continue
            qi, xi = np.nonzero(alive)
            so_far = total[qi, xi]
        so_far = so_far + np.einsum("ij,ij->i", running.blocks[b][who[qi]], blocks[b][xi])
        still = so_far <= bars[qi, b]
        qi, xi, so_far = qi[still], xi[still], so_far[still]
    return np.nonzero(alive) if qi is None else (qi, xi)


def scan(running: Running, who: np.ndarray, rows: np.ndarray, blocks: list[np.ndarray], names: np.ndarray, abandon: bool) -> int:
    """Compare the queries ``who`` with a list's rows (``blocks``: rotated), known by ``names``; returns how many pairs survive."""
    many = 0
    for q0 in range(0, len(who), 256):
        own = who[q0 : q0 + 256]
        for x0 in range(0, len(rows), STEP):
            x = slice(x0, x0 + STEP)
            qi, xi = survivors(running, own, [b[x] for b in blocks]) if abandon else np.divmod(np.arange(len(own) * len(rows[x])), len(rows[x]))
            if len(qi):
                many += len(qi)
                running.add(own[qi], names[x0 + xi], exact(running.raw[own], rows[x], qi, xi))
    return many


def exact(queries: np.ndarray, rows: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs, added up from the first component to the last: equal vectors get equal values."""
    total = np.zeros(len(qi))
    for j in range(queries.shape[1]):
        total += queries[qi, j] * rows[xi, j]
    return total


class Shelf:
    """The stored vectors of a shelf, by list."""

    def __init__(self, index: Index, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        chunk = lambda name: table.column(name).chunk(0) if table.num_rows else table.schema.field(name).type
        self.index = index
        self.rep = chunk("rep").to_numpy()
        self.rows = _matrix(chunk("embedding"), index.width)
        self.blocks = blocks_of(index.rotated(self.rows), False)
        ids = chunk("ids")
        self.offsets, self.ids = ids.offsets.to_numpy(), ids.values.to_numpy()
        self.by_rep = np.argsort(self.rep, kind="stable")  # rows go by the order of their ids, which settles ties
        self.names = np.argsort(self.by_rep)
        lists = chunk("list").to_numpy()
        starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        self.span = {int(lists[a]): (int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(lists)], strict=True)}

    def answer(self, queries: pa.RecordBatch, abandon: bool) -> pa.RecordBatch:
        """``q, vec_id, score``: the k + 1 best of this shelf for each query."""
        wanted = queries.column(queries.schema.get_field_index("lists"))
        running = Running(self.index, _matrix(queries.column(queries.schema.get_field_index("embedding")), self.index.width), queries.column(queries.schema.get_field_index("limit")).to_numpy())
        flat, many = wanted.flatten().to_numpy(), wanted.value_lengths().to_numpy()
        who = np.repeat(np.arange(len(many)), many)
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        for number in np.unique(flat).tolist():
            if number in self.span:  # a list that is cut may have no row here
                a, b = self.span[number]
                scan(running, who[np.searchsorted(flat, number) : np.searchsorted(flat, number, side="right")], self.rows[a:b], [block[a:b] for block in self.blocks], self.names[a:b], abandon)
        qi, at = np.nonzero(running.score > -np.inf)
        row, score = self.by_rep[running.row[qi, at]], running.score[qi, at]
        many = np.diff(self.offsets)[row]
        inner = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
        vec = self.ids[np.repeat(self.offsets[:-1][row], many) + inner]
        qi, score = np.repeat(qi, many), np.repeat(score, many)
        order = np.lexsort((vec, -score, qi))
        qi, vec, score = qi[order], vec[order], score[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) <= self.index.k
        asked = queries.column(queries.schema.get_field_index("rep")).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(asked[qi[keep]]), pa.array(vec[keep]), pa.array(score[keep])], names=["q", "vec_id", "score"])


def scan_shelves(batches: Iterator[pa.RecordBatch], index: Index, abandon: bool) -> Iterator[pa.RecordBatch]:
    """From rows in order of shelf and block, vectors before queries: what each query finds on each shelf."""
    key, parts, shelf = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)  # shelf, block, whether it is a query
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            own, is_query = tuple(keys[a, :2].tolist()), keys[a, 2]
            if own != key:
                key, parts, shelf = own, [], None
            if not is_query:
                parts.append(batch.slice(a, b - a))
                continue
            if not parts:
                continue  # no vector of the list stands here
            shelf = shelf or Shelf(index, parts)
            for start in range(a, b, STEP):
                yield shelf.answer(batch.slice(start, min(STEP, b - start)), abandon)


def probe(distinct: DataFrame, asked: DataFrame, index: Index, abandon: bool) -> DataFrame:
    """``q, vec_id, score``: the k + 1 best found for each query vector ``q`` of ``asked``."""
    d, k, kind = index.width, index.k, distinct.schema["embedding"].dataType.simpleString()
    first_shelf, shelf_parts, many = shelves(index.sizes, SHELF_ROWS)

    def choose(batches):
        for batch in small_parts(batches):
            step = index.at_once(index.near)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows = index.rotated(_matrix(part.column(1), d), query=True)
                lists, held = index.ranked(rows, index.near)
                enough = (np.cumsum(held, axis=1) < 4 * (k + 1)).sum(axis=1) + 1
                if (enough > lists.shape[1]).any() and index.near < len(index.centres):  # too few rows near: look everywhere
                    each = [index.ranked(row[None, :], len(index.centres)) for row in rows]
                    lists, held = (np.concatenate(x) for x in zip(*each, strict=True))
                    enough = (np.cumsum(held, axis=1) < 4 * (k + 1)).sum(axis=1) + 1
                n = np.minimum(np.maximum(index.probes, enough), (held > 0).sum(axis=1))
                limit = np.full(len(rows), np.inf)
                if abandon and len(index.sample) > k:
                    limit = np.partition(squared(rows, index.sample), k, axis=1)[:, k] * (1 + 1e-6)
                chosen = pa.array([o[:m].astype(np.int32) for o, m in zip(lists, n.tolist(), strict=True)], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(limit), chosen], names=["q", "embedding", "limit", "lists"])

    routed = cut(asked.select("q", "embedding").mapInArrow(choose, f"q long, embedding {kind}, limit double, lists array<int>"))

    def visits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, shelf and list of each visit, by row and shelf."""
        column = batch.column(batch.schema.get_field_index("lists"))
        lists, who = column.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
        copies = shelf_parts[lists]
        inner = np.arange(copies.sum()) - np.repeat(copies.cumsum() - copies, copies)
        shelf, who, lists = np.repeat(first_shelf[lists], copies) + inner, np.repeat(who, copies), np.repeat(lists, copies)
        order = np.lexsort((lists, shelf, who))
        return who[order], shelf[order], lists[order]

    def tally(batches):
        per_shelf, per_list = np.zeros(many, dtype=np.int64), np.zeros(index.lists, dtype=np.int64)
        for batch in batches:
            who, shelf, lists = visits(batch)
            new = np.r_[True, (who[1:] != who[:-1]) | (shelf[1:] != shelf[:-1])] if len(who) else np.zeros(0, dtype=bool)
            per_shelf += np.bincount(shelf[new], minlength=many)
            per_list += np.bincount(lists, minlength=index.lists)
        for code, counts in enumerate((per_shelf, per_list)):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), code)), pa.array(used), pa.array(counts[used])], names=["code", "at", "n"])

    waiting, wanted = np.zeros(many, dtype=np.int64), np.zeros(index.lists, dtype=bool)
    for row in routed.select("lists").mapInArrow(tally, "code long, at long, n long").groupBy("code", "at").agg(F.sum("n").alias("n")).collect():
        if row.code:
            wanted[row["at"]] = True
        else:
            waiting[row["at"]] = row.n
    blocks = np.maximum(1, -(-waiting // SHELF_QUERIES))
    names = ["shelf", "block", "is_query", "list", "rep", "ids", "embedding", "limit", "lists"]
    schema = f"shelf long, block long, is_query int, list long, rep long, ids array<long>, embedding {kind}, limit double, lists array<int>"

    def rows_of(shelf, block, is_query, lists, rep, ids, embedding, limit, asked_lists):
        n = len(shelf)
        fill = lambda v, t: pa.nulls(n, t) if v is None else v
        columns = [pa.array(shelf), pa.array(block), pa.array(np.full(n, is_query, dtype=np.int32)), fill(lists, pa.int64()), rep, fill(ids, pa.list_(pa.int64())), embedding, fill(limit, pa.float64()), fill(asked_lists, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def place(batches):
        for batch in small_parts(batches):
            rows = _matrix(batch.column(2), d)
            lists = index.list_of(index.rotated(rows))
            rep = batch.column(0).to_numpy()
            shelf = first_shelf[lists] + dealt(rep, shelf_parts[lists])
            copies = np.where(wanted[lists], blocks[shelf], 0)
            inner = np.arange(copies.sum()) - np.repeat(copies.cumsum() - copies, copies)
            take = np.repeat(np.arange(len(rep)), copies)
            taken = batch.take(pa.array(take))
            yield rows_of(shelf[take], inner, 0, pa.array(lists[take]), taken.column(0), taken.column(1), taken.column(2), None, None)

    def send(batches):
        for batch in small_parts(batches):
            who, shelf, lists = visits(batch)
            if not len(who):
                continue
            starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (shelf[1:] != shelf[:-1])])
            groups = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(who)].astype(np.int32)), pa.array(lists.astype(np.int32)))
            taken = batch.take(pa.array(who[starts]))
            q = taken.column(0)
            yield rows_of(shelf[starts], dealt(q.to_numpy(), blocks[shelf[starts]]), 1, None, q, None, taken.column(1), taken.column(2), groups)

    stored = distinct.select("rep", "ids", "embedding").mapInArrow(place, schema)
    sent = routed.select("q", "embedding", "limit", "lists").mapInArrow(send, schema)
    met = stored.unionByName(sent).repartition(F.col("shelf"), F.col("block")).sortWithinPartitions("shelf", "block", "is_query", "list", "rep")
    found = met.mapInArrow(lambda batches: scan_shelves(batches, index, abandon), "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` its ``k`` nearest other rows."""
    fine = usable(vectors)
    out = None
    for row in fine.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        found = search_one_length(fine.where(F.size("embedding") == row.d), is_query, k)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], RESULT) if out is None else out


def search_one_length(rows: DataFrame, is_query, k: int) -> DataFrame:
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    distinct = cut(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "embedding"))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = cut(queries.groupBy("embedding").agg(F.min("query_id").alias("q")))
    index = build(distinct, k)
    if index is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    found = cut(probe(distinct, asked, index, True))
    most = min(k + 1, distinct.select(F.size("ids").alias("n")).limit(k + 1).agg(F.sum("n")).first()[0])
    short = cut(asked.join(found.groupBy("q").agg(F.count("*").alias("n")), "q", "left").where(F.coalesce("n", F.lit(0)) < most).select("q", "embedding"))
    if not short.isEmpty():
        found = found.join(short.select("q"), "q", "left_anti").unionByName(probe(distinct, short, index, False))
    listed = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id"))).alias("near"))
    named = queries.join(asked, "embedding").select("query_id", "q")
    own = named.join(listed, "q").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.away")).alias("score"))
