"""Operator 2: SimHash near-duplicates through pivot distance tables."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from photarium.operators.graph import component_stars
from photarium.sources.scratch import materialize

SEED = 42
RADIUS = 2
#: Bit ranges of the fingerprint. At most RADIUS of them differ between linked fingerprints.
SEGMENTS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
PIVOTS_PER_SEGMENT = 8
WHOLE_PIVOTS = 16
#: Largest cell that one numpy block compares; larger ones take the neighbour route.
CELL = 256


def simhash(text: bytes, width: int = 3) -> int:
    """Majority bits over XXH64 of the ``width``-word shingles; unsigned. No words: 0."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = ends[width - 1 :] or ends[-1:]
    return majority_bits(np.array([xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts, last)], dtype="<u8"))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t.as_py() or b"") for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for each row; ``fp`` holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _pivots() -> tuple[list[list[int]], list[int]]:
    rng = random.Random(SEED)
    inside = [[rng.getrandbits(hi - lo) << lo for _ in range(PIVOTS_PER_SEGMENT)] for lo, hi in SEGMENTS]
    return inside, [rng.getrandbits(64) for _ in range(WHOLE_PIVOTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _coordinates(segment: int) -> "F.Column":
    """Distances to the segment's pivots, four bits each, in one long."""
    lo, hi = SEGMENTS[segment]
    mask = F.lit(_signed(((1 << (hi - lo)) - 1) << lo))
    out = F.lit(0).cast("long")
    for k, pivot in enumerate(_pivots()[0][segment]):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(pivot))).bitwiseAND(mask)).cast("long")
        out = out.bitwiseOR(F.shiftleft(d, 4 * k))
    return out


def whole_pivots() -> np.ndarray:
    """The reference fingerprints of the cells' distance tables."""
    return np.array(_pivots()[1], dtype=np.uint64)


def cell_labels(prints: np.ndarray, pivots: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint of a cell the smallest index it reaches inside the cell.

    A pair goes on to the exact comparison only if no coordinate of its distances
    to the pivots differs by more than ``radius`` (triangle inequality).
    """
    table = np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)
    near = np.ones((len(prints), len(prints)), dtype=bool)
    for column in table.T:
        near &= np.abs(column[:, None] - column[None, :]) <= radius
    i, j = np.nonzero(near)
    close = np.bitwise_count(prints[i] ^ prints[j]) <= radius
    i, j = i[close], j[close]
    label = np.arange(len(prints))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivots = whole_pivots()
    for batch in batches:
        a, b = [], []
        for cell in batch.column(0):
            prints = np.sort(np.array(cell.as_py(), dtype=np.int64)).view(np.uint64)
            prints = np.sort(prints)
            low = prints[cell_labels(prints, pivots)]
            moved = low != prints
            a.append(prints[moved].view(np.int64))
            b.append(low[moved].view(np.int64))
        empty = np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *a])), pa.array(np.concatenate([empty, *b]))], names=["a", "b"])


def fingerprint_links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what Hamming distance <= 2 connects.

    ``prints``: distinct column ``fp``. The pivot table holds, for each of five
    bit ranges, the distances to eight reference fingerprints. Linked prints
    differ in at most two ranges, so in the other three every coordinate
    difference is 0: pairs that agree on no three ranges are discarded by an
    equality join on the coordinates of the ten triples. Survivors of a cell face
    sixteen whole-width pivots and then the exact distance; each cell gives a
    spanning star, not its pairs. Cells above ``cell`` prints meet instead on the
    65 values within one bit of each print, since two prints within two bits
    share such a value: linear in rows, at most 65 prints a value, nothing lost.
    """
    coords = prints.select("fp", *(_coordinates(k).alias(f"c{k}") for k in range(len(SEGMENTS))))
    keys = [F.xxhash64(F.lit(n), *(F.col(f"c{k}") for k in chosen)) for n, chosen in enumerate(combinations(range(len(SEGMENTS)), len(SEGMENTS) - RADIUS))]
    keyed = coords.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    members = keyed.join(crowded, "key")
    cells = members.where(F.col("n") <= cell).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    small = cells.mapInArrow(_cell_batches, "a long, b long")

    hot = members.where(F.col("n") > cell).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)) for k in range(64)))
    near = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    low = near.groupBy("z").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("z", "low")
    large = near.join(low, "z").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return small.union(large).distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with a null id take part and never name a component (a component of
    such rows alone has a null id). Repeated rows are repeated in the result.
    Extra columns are ignored. Empty input: no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    unique = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "unique")
    stars = component_stars(fingerprint_links(unique.select("fp")))
    joined = materialize(stars.join(unique, F.col("vertex") == F.col("fp")).select("fp", "component", "low_id"), "stars")
    least = joined.groupBy("component").agg(F.min("low_id").alias("component_id"))
    labels = joined.join(least, "component").select("fp", "component_id")
    # Fingerprints outside every star are labelled by their own smallest id.
    labels = unique.join(labels, "fp", "left").select("fp", F.coalesce("component_id", "low_id").alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
