"""Links of all pairs of rows that pass a test, over a grid of blocks: exact, and no pair list is ever written."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.operators.vectors import matrix_of

#: Rows of which each pair of blocks is a task; fewer are one block.
ALONE = 4096
#: Blocks at least, so that all cores have work, and bytes of the rows of one block at most, as a task holds them.
BLOCKS, BLOCK_BYTES = 8, 128 << 20
#: Bytes of the rows that pass by at once.
PASSING = 8 << 20
#: Rows of the two sides of one product, and candidates that are judged at once.
TILE, JUDGED = (1024, 2048), 1 << 15
#: Slack of products in single precision of unit vectors.
SINGLE = 1e-5

Pairs = tuple[np.ndarray, np.ndarray]


class Forest:
    """Components of numbered rows; ``top`` names each row's smallest."""

    def __init__(self, n: int = 0):
        self.top = np.arange(n)

    def grow(self, n: int) -> int:
        """``n`` more rows, each alone; the number of the first."""
        first = len(self.top)
        self.top = np.concatenate([self.top, np.arange(first, first + n)])
        return first

    def apart(self, i: np.ndarray, j: np.ndarray) -> Pairs:
        """The pairs that lie in two components."""
        some = self.top[i] != self.top[j]
        return i[some], j[some]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        top = self.top
        while True:
            i, j = self.apart(i, j)
            if not len(i):
                return
            a, b = top[i], top[j]
            np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
            while (up := top[top]).tobytes() != top.tobytes():
                top[:] = up


def near_units(one: np.ndarray, two: np.ndarray, minimum: float) -> Iterator[Pairs]:
    """Candidates of a product of ``minimum`` or more among rows of length one at most, by products in single precision.

    Of one side with itself (the same object) only tiles on and above the diagonal are taken.
    """
    for k in range(0, len(one), TILE[0]):
        for m in range(k if one is two else 0, len(two), TILE[1]):
            near = one[k : k + TILE[0]] @ two[m : m + TILE[1]].T
            at = np.flatnonzero((near >= np.float32(minimum - SINGLE)).ravel())
            yield at // near.shape[1] + k, at % near.shape[1] + m


def products(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", one[i], two[j])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow column of lists of one length."""
    sizes = len(column) and len(column[0])
    return matrix_of(column, sizes) if sizes else np.zeros((len(column), 0))


def block_count(n: int, row_bytes: int) -> int:
    """Blocks of ``n`` rows, which is how often each travels."""
    return 1 if n <= ALONE else max(BLOCKS, math.ceil(n * row_bytes / BLOCK_BYTES))


class Test(NamedTuple):
    """Which pairs of rows are links. Chunks of rows are what ``prepare`` makes of them, with no reference to their Arrow memory."""

    prepare: Callable[[pa.Table], tuple]
    #: Row numbers in two chunks: all pairs that can pass. Of a chunk with itself (the same object) one order of each pair is enough.
    candidates: Callable[[tuple, tuple], Iterator[Pairs]]
    #: Judges pairs exactly.
    passed: Callable[[tuple, tuple, np.ndarray, np.ndarray], np.ndarray]


class Meeting:
    """Two blocks in a task: the rows of one are held, those of the other pass by; only their keys and components stay."""

    def __init__(self, test: Test):
        self.test, self.forest, self.keys, self.held = test, Forest(), [], []
        self.bans: list[tuple] = []
        self.place: dict = {}
        self.banned = np.zeros(0, np.int64)

    def ban(self, pairs: pa.Table) -> None:
        self.bans += zip(pairs["k"].to_pylist(), pairs["mate"].to_pylist())

    def add(self, rows: pa.Table, stay: bool, meet: bool) -> None:
        first = self.forest.grow(len(rows))
        self.keys.append(rows["k"].combine_chunks().take(pa.array(np.arange(len(rows)))))  # a copy, so that the batch can go
        if self.bans:
            known = pa.array({k for pair in self.bans for k in pair}, self.keys[-1].type)
            at = np.flatnonzero(pc.is_in(self.keys[-1], known).to_numpy(zero_copy_only=False))
            self.place |= zip(self.keys[-1].take(pa.array(at)).to_pylist(), (at + first).tolist())
            met = [(self.place[a], self.place[b]) for a, b in self.bans if a in self.place and b in self.place]
            self.banned = np.unique(np.array([(min(p) << 32) + max(p) for p in met], np.int64))
        new = first, self.test.prepare(rows)
        if stay:
            self.held.append(new)
        if meet:
            for old in self.held:
                self.compare(*old, *new)

    def compare(self, p: int, one: tuple, q: int, two: tuple) -> None:
        waiting, size = [], 0
        for i, j in self.test.candidates(one, two):
            waiting.append(self.forest.apart(i + p, j + q))
            size += len(waiting[-1][0])
            if size >= JUDGED:
                self.judge(waiting, p, one, q, two)
                waiting, size = [], 0
        self.judge(waiting, p, one, q, two)

    def judge(self, pairs: list[Pairs], p: int, one: tuple, q: int, two: tuple) -> None:
        for n in range(0, sum(len(i) for i, _ in pairs), JUDGED):
            if not n:
                i, j = (np.concatenate(side) for side in zip(*pairs))
            a, b = self.forest.apart(i[n : n + JUDGED], j[n : n + JUDGED])
            if len(self.banned):
                free = ~np.isin((np.minimum(a, b) << 32) + np.maximum(a, b), self.banned)
                a, b = a[free], b[free]
            if len(a):
                good = self.test.passed(one, two, a - p, b - q)
                self.forest.join(a[good], b[good])

    def stars(self) -> list[pa.RecordBatch]:
        moved = np.flatnonzero(self.forest.top != np.arange(len(self.forest.top)))
        if not len(moved):
            return []
        keys = pa.concat_arrays(self.keys)
        return [pa.RecordBatch.from_arrays([keys.take(pa.array(n)) for n in (moved, self.forest.top[moved])], names=["a", "b"])]


def grid_links(rows: DataFrame, n: int, row_bytes: int, test: Test, forbidden: DataFrame | None = None) -> DataFrame:
    """``a, b``: links that connect what all pairs of rows that pass ``test`` connect.

    ``rows``: ``k`` (unique) and what the test needs; ``n`` is their number,
    ``row_bytes`` what a task holds of each. Each pair of blocks is met in one
    task: the rows of the first come before those of the second and are held, the
    others pass by in Arrow batches, so memory ends at BLOCK_BYTES and what is
    compared at once. A task judges only pairs that its links have not joined yet
    and gives a star for each component, so it writes a row for each row it meets
    at most. A row travels once for each block, and blocks only grow in number
    beyond BLOCKS * BLOCK_BYTES. ``forbidden``: ``a, b`` of pairs that are no
    links.
    """
    kind, names = dict(rows.dtypes)["k"], [c for c in rows.columns if c != "k"]
    blocks = block_count(n, row_bytes)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("own", block("k")).withColumn("other", every).withColumn("mate", F.lit(None).cast(kind))
    if forbidden is not None:
        x, y = (F.col(c).cast(kind) for c in forbidden.columns[:2])
        bans = forbidden.select(x.alias("k"), y.alias("mate")).where("k IS NOT NULL AND mate IS NOT NULL")
        dealt = dealt.unionByName(bans.withColumn("own", block("k")).withColumn("other", block("mate")), allowMissingColumns=True)
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("mate").isNotNull(), 0).when(F.col("own") == lo, 1).otherwise(2)
    dealt = dealt.select("k", "mate", *names, lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    step = max(1, PASSING // row_bytes)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meeting = None, None
        for batch in batches:
            lo, hi, side = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "side"))
            new = (np.diff(lo) != 0) | (np.diff(hi) != 0) | (np.diff(side) != 0)
            for start, end in pairwise([0, *(np.flatnonzero(new) + 1), len(lo)]):
                if now != (pair := (lo[start], hi[start])):
                    yield from meeting.stars() if meeting else ()
                    now, meeting = pair, Meeting(test)
                for k in range(start, end, step):
                    some = pa.Table.from_batches([batch.slice(k, min(step, end - k))])
                    if side[start] == 0:
                        meeting.ban(some)
                    else:
                        meeting.add(some, stay=side[start] == 1, meet=side[start] == 2 or lo[start] == hi[start])
        yield from meeting.stars() if meeting else ()

    return dealt.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "side").mapInArrow(link, f"a {kind}, b {kind}")
