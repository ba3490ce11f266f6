"""Operator 9: sum-of-squares packing of documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.llm.tokens import slices, text_batches, tokenizer_path, word_tokenizer
from photarium.sources.scratch import materialize

CAPACITY = 4096
END_ID = 1
#: Pieces that one group packs, about; each group leaves a few sequences unfilled.
GROUP = 40_000
#: Places (32 bytes each) that are broadcast to the pieces' ids; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length.

    With N(g) open bins of residual gap g, an item of length s goes to the open
    gap, or to a new bin, that makes the sum of N(g)**2 smallest (full bins are
    closed and count nothing); ties take the smallest gap. Items come longest
    first, equal ones in the given order.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    gaps = np.zeros(0, np.int64)  # open gaps, ascending
    stale = True
    for i in order:
        s = int(lengths[i])
        if s >= capacity:
            where[i], used = used, used + 1
            continue
        if stale:
            gaps, stale = np.flatnonzero(count), False
        fit = gaps[np.searchsorted(gaps, s) :]
        best, change = 0, 2 * count[capacity - s] + 1
        if len(fit):
            rest = fit - s
            delta = np.where(rest > 0, 2 * count[rest] + 1, 0) - 2 * count[fit] + 1
            k = int(delta.argmin())
            if delta[k] <= change:
                best = int(fit[k])
        if best:
            b = open_bins[best].pop()
            count[best] -= 1
            stale |= count[best] == 0
        else:
            b, best, used = used, capacity, used + 1
        where[i], offset[i] = b, capacity - best
        gap = best - s
        if gap:
            stale |= count[gap] == 0
            count[gap] += 1
            open_bins[gap].append(b)
    return where, offset


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked).

    Ids of the whole text and then ``end_id``; only documents above ``capacity``
    are cut. ``row`` tells rows apart whose ids are equal or null. Null text
    counts as empty: one piece of the end id.
    """
    tokenizer = tokenizer or tokenizer_path()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_tokenizer(tokenizer), TaskContext.get().partitionId() << 40
        for batch in it:
            at = 0
            for texts in slices(t.as_py() for t in batch.column(1)):
                tokens, cuts = encoder.encode_flat(texts)
                data = np.insert(tokens, cuts[1:], end_id).astype("<u4").tobytes()
                stops = cuts + np.arange(len(cuts))
                size = np.diff(stops)
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(size[row] - piece * capacity, capacity)
                first = 4 * (stops[row] + piece * capacity)
                part = [data[i:j] for i, j in zip(first.tolist(), (first + 4 * length).tolist())]
                columns = [pa.array(seen + at + row), batch.column(0).take(pa.array(at + row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(map(zlib.crc32, part), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(part, pa.binary())] if with_ids else [])], names=names)
                at += len(texts)
            seen += at

    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``.

    ``pieces`` has ``row, piece, length`` and is read twice, so pass a written
    table. Pieces are dealt by a hash into groups of about ``group`` and each
    group is packed by one task; a sequence never spans groups.
    """
    groups = max(1, -(-pieces.count() // group))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "piece"], ignore_index=True)
        where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 32) + where, offset=offset).drop(columns="pack_group")

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return dealt.groupBy("pack_group").applyInPandas(place, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked) of every piece of ``docs``.

    Null text is an empty document, which is one piece of the end id; rows with
    null or repeated ids are packed as rows of their own; long texts are cut into
    pieces; extra columns are ignored; an empty table gives no rows. ``ids``
    holds little-endian unsigned 32-bit numbers; they stay where they were
    encoded while the places of all pieces can be broadcast.
    """
    with text_batches(docs.sparkSession):
        pieces = materialize(token_pieces(docs, capacity, with_ids=with_ids), "pieces")
    placed = pack(pieces.drop("ids"), capacity)
    if with_ids:
        places = materialize(placed.select("row", "piece", "sequence_id", "offset"), "places")
        placed = pieces.join(F.broadcast(places) if places.count() <= BROADCAST_ROWS else places, ["row", "piece"])
    return placed.drop("row")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
