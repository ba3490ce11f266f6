"""Operator 8: token ids in Arrow files of fixed-size lists."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photarium.llm.tokens import slices, text_batches, tokenizer_path, word_tokenizer
from photarium.sources.scratch import materialize, scratch_path

SEQUENCE = 2048
#: Sequences of one record batch.
BATCH = 256
END_ID = 2


def file_schema(sequence: int, wide: bool = False) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class SequenceWriter:
    """Cuts a stream of ids into equal sequences; only the last is padded (mask false)."""

    def __init__(self, sink, sequence: int = SEQUENCE, wide: bool = False):
        self.sequence, self.dtype = sequence, np.uint32 if wide else np.uint16
        self.schema = file_schema(sequence, wide)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and ids.max() > np.iinfo(self.dtype).max:
            raise ValueError("an id doesn't fit the file's width: write it with wide=True")
        self.parts.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= self.sequence * BATCH:
            self._flush(self.held // (self.sequence * BATCH) * self.sequence * BATCH)

    def _flush(self, count: int) -> None:
        flat = np.concatenate(self.parts)
        self.parts, self.held = [flat[count:].copy()], len(flat) - count
        for k in range(0, count, self.sequence * BATCH):
            self._batch(flat[k : min(count, k + self.sequence * BATCH)])

    def _batch(self, flat: np.ndarray) -> None:
        real = len(flat)
        rows = -(-real // self.sequence)
        flat = np.pad(flat, (0, rows * self.sequence - real))
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self.writer.close()


class SequenceReader:
    """Random access to a file of sequences; a memory map where the store is local."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.sequence = self.file.schema.field("ids").type.list_size

    def batch(self, k: int) -> np.ndarray:
        """Ids of batch ``k`` as a view of the file, (rows, sequence)."""
        ids = self.file.get_batch(k).column("ids")
        return ids.flatten().to_numpy(zero_copy_only=True).reshape(-1, self.sequence)

    def masks(self, k: int) -> np.ndarray:
        mask = self.file.get_batch(k).column("mask")
        return mask.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.sequence)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids of the stream from ``start``."""
        per, out = self.sequence * BATCH, []
        while count > 0:
            flat = self.batch(start // per).reshape(-1)
            part = flat[start % per : start % per + count]
            out.append(part)
            start, count = start + len(part), count - len(part)
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint16), *out])


def open_sequences(folder: str, name: str) -> SequenceReader:
    store, path = pafs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    return SequenceReader(pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` in ascending id order; returns the manifest.

    Rows are range-partitioned by id; each task sorts its range, encodes whole
    texts, appends ``end_id`` to each and writes one file ``part-<n>.arrow``, the
    files being in order of n. A file is written under the attempt's own name
    and then moved, so a retried task replaces it whole. Ids take 16 bits if the
    tokenizer's vocabulary allows it and ``wide`` isn't set. Manifest columns:
    ``file, doc_id, file_start, n_tokens``. Null texts count as empty; null ids
    come first; rows that share an id follow each other.
    """
    tokenizer = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = word_tokenizer(tokenizer), TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        part, attempt = context.partitionId(), context.taskAttemptId()
        temporary, final = f"{root}/.{part}-{attempt}", f"{root}/part-{part:06d}.arrow"
        writer, start = None, 0
        for batch in it:
            ids, texts, counts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], []
            if writer is None:
                width = wide or max(encoder.largest, end_id) > np.iinfo(np.uint16).max
                sink = store.open_output_stream(temporary)
                writer = SequenceWriter(sink, sequence, width)
            for rows in slices(texts):
                tokens, cuts = encoder.encode_flat(rows)
                writer.add(np.insert(tokens, cuts[1:], end_id))
                counts.append(np.diff(cuts) + 1)
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), ids, pa.array(start + np.cumsum(n) - n), pa.array(n)], names=["file", "doc_id", "file_start", "n_tokens"])
            start += int(n.sum())
        if writer is not None:
            writer.close()
            sink.close()
            store.move(temporary, final)

    # Some ten thousand rows a file at least, and no fewer files than Spark's own partition count once there is enough.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    with text_batches(spark):
        return materialize(ranged.mapInArrow(write, "file long, doc_id long, file_start long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every manifest row, from the files.

    ``start`` counts the ids of all documents before; it comes from the files'
    totals, one row each.
    """
    totals = manifest.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    offsets = totals.select("file", F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rows = manifest.join(F.broadcast(offsets), "file").select("file", "doc_id", "file_start", "n_tokens", "offset")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in it:
            file, start, count, offset = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
            sums = np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                if file[k] != name:
                    name, reader = file[k], open_sequences(folder, f"part-{file[k]:06d}.arrow")
                sums[k] = zlib.crc32(reader.ids(int(start[k]), int(count[k])).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(offset + start), batch.column(3), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.repartition("file").sortWithinPartitions("file", "file_start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(docs, folder), folder)
