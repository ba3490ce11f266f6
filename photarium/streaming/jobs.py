"""Incremental loops as Structured Streaming jobs.

Every job writes one snapshot folder per micro-batch, named by the batch id, so
that a replayed batch replaces its own output: exactly once by idempotence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from photarium.operators.dedup import content_key
from photarium.operators.identity import assign
from photarium.operators.vectors import add_sums, centroids_of_sums, vector_sums
from photarium.sources.scratch import discard, exists, materialize, temporary
from photarium.streaming.tables import KeyedTable


def _run(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def _first_seen(ttl_ms: int):
    """Rows of one content and its record: the key it was first seen with, and when it last came."""

    def run(content: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        first, last = state.get if state.exists else (None, None)
        keys = [k for some in rows for k in some["key"].tolist()]
        if last is None or now - last >= ttl_ms:
            first = min(keys)
            yield pd.DataFrame({"key": [first], "content": [content[0]]})
        state.update((first, now))
        state.setTimeoutDuration(ttl_ms)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their micro-batch, which Spark hands to every task; a replayed batch has the same."""
    number = int(TaskContext.get().getLocalProperty("streaming.sql.batchId"))
    for batch in batches:
        yield batch.append_column("batch", pa.array([number] * batch.num_rows, pa.int64()))


@contextmanager
def _state_settings(spark):
    """State on RocksDB; and no batches without data, since an open timeout would ask for them without end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, key: str = "doc_id", md5: str = "md5", ttl_ms: int | None = None) -> StreamingQuery:
    """First row of each content over the life of the stream, as ``key, md5`` under ``out``.

    Within a batch the smallest key wins, across batches the earlier batch. Each
    content has a record of the key it was first seen with, in keyed state on
    RocksDB, so that neither clocks nor replays decide, and a batch touches its own
    contents only. The record is the least pair of batch number and key, kept by
    Spark's own aggregation; a content is new if its first batch is its last. With
    ``ttl_ms`` a record goes once its content has not come for so long, which bounds
    the state; a copy that comes later is first again. Such records take a Python
    call a content. A row without a hash is a content of its own, as in a batch.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("key"), content_key(md5, key).alias("content"))
    with _state_settings(stream.sparkSession):
        if ttl_ms:
            seen = rows.groupBy("content").applyInPandasWithState(_first_seen(ttl_ms), f"key {kind}, content string", f"first {kind}, last long", "update", GroupStateTimeout.ProcessingTimeTimeout)
        else:
            numbered = rows.mapInArrow(_numbered, f"key {kind}, content string, batch long")
            kept = numbered.groupBy("content").agg(F.min(F.struct("batch", "key")).alias("first"), F.max("batch").alias("last"))
            seen = kept.where("first.batch = last").select("first.key", "content")

        def step(batch: DataFrame, number: int) -> None:
            hashed = F.when(F.col("content").startswith("md5:"), F.substring("content", 5, 1 << 30))
            batch.select(F.col("key").alias(key), hashed.alias(md5)).write.mode("overwrite").parquet(f"{out}/batch={number}")

        return _run(seen, checkpoint, step, "update")


def _sums(rows: DataFrame) -> DataFrame:
    """STATE of rows ``group_id, embedding``; vectors of different lengths don't mix."""
    return vector_sums(rows, "group_id")


STATE = "group_id string, size int, total array<double>, n long"


def assign_stream(stream: DataFrame, grouped: DataFrame, out: str, checkpoint: str, embedding_type: str = "primary", threshold: float = 0.79, margin: float = 0.02, keys: list[str] | None = None, every: int = 8) -> StreamingQuery:
    """Decisions on each batch of unassigned detections, by groups that learn from batch to batch.

    Each group's running vector sum and count are a keyed table under
    ``out/groups``, begun from ``grouped`` when the stream first runs. A batch
    reads one frozen copy of it, decides its rows against those centroids, and
    writes the sums of the groups it touched: what joins moves a centroid, and a
    group founded in one batch can be joined in the next, not before. Detections
    in conflict stay open and are decided again with the next batch, whose
    decision replaces the last one. A key that was seen in an earlier batch is
    not decided anew (streaming state).

    Writes ``out/decisions/batch=n``; ``assigned(spark, out, keys)`` reads the
    last decision of each detection. Nothing but the touched groups, the open
    conflicts and the batch itself is written, whatever the groups' sizes.
    """
    keys, spark = keys or ["image_path", "detection_index"], stream.sparkSession
    groups = KeyedTable(spark, f"{out}/groups", STATE, ["group_id", "size"], every=every)
    if not groups.started():
        typed = grouped.where((F.col("embedding_type") == embedding_type) & (F.col("group_id") != ""))
        groups.start(_sums(typed))
    fresh = stream.where((F.col("embedding_type") == embedding_type) & (F.col("group_id") == "")).select(*keys, F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(keys)
    fields = ", ".join(f"`{n}` {t}" for n, t in fresh.dtypes)

    def step(batch: DataFrame, number: int) -> None:
        groups.fold(number)
        state = materialize(groups.read(number), "groups")
        # Conflicts that the last batch has left; a replay finds the same ones.
        left = f"{out}/open/batch={number - 1}"
        waiting = spark.read.schema(fields).parquet(left) if number and exists(spark, left) else spark.createDataFrame([], fields)
        rows = materialize(batch.select(*keys, "embedding").union(waiting.select(*keys, "embedding")), "batch")
        decided = materialize(assign(rows, centroids_of_sums(state, "group_id"), threshold, margin, keys), "decided")
        vectors = rows.join(decided, keys)
        gained = _sums(vectors.where("decision IN ('join', 'create')").select("group_id", "embedding"))
        touched = state.join(gained.select("group_id", "size"), ["group_id", "size"], "left_semi").unionByName(gained)
        groups.write(number, add_sums(touched, ["group_id", "size"]))
        vectors.where("decision = 'conflict'").select(*keys, "embedding").write.mode("overwrite").parquet(f"{out}/open/batch={number}")
        decided.write.mode("overwrite").parquet(f"{out}/decisions/batch={number}")
        if number > 1:
            discard(spark, f"{out}/open/batch={number - 2}")

    def run(batch: DataFrame, number: int) -> None:
        with temporary(spark):
            step(batch, number)

    return _run(fresh, checkpoint, run)


def assigned(spark, out: str, keys: list[str] | None = None) -> DataFrame:
    """The last decision of each detection of an ``assign_stream``."""
    keys, rows = keys or ["image_path", "detection_index"], spark.read.parquet(f"{out}/decisions")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def latest_table(spark, out: str, schema: str, key: str = "doc_id", order: str = "seq", every: int = 8) -> KeyedTable:
    return KeyedTable(spark, out, schema, [key], [order], every)


def latest_table_stream(stream: DataFrame, out: str, checkpoint: str, key: str = "doc_id", order: str = "seq", value: str = "human_category", every: int = 8) -> StreamingQuery:
    """The last ``value`` of each key by ``order``, as a keyed table under ``out``: a snapshot and the changes of at most ``every`` batches.

    Late rows lose against what the table holds; of equal orders the larger
    value wins, and across batches the later batch. Read it with
    ``latest_table(...).read()``.
    """
    kinds, spark = dict(stream.dtypes), stream.sparkSession
    kept = latest_table(spark, out, f"`{key}` {kinds[key]}, `{value}` {kinds[value]}, `{order}` {kinds[order]}", key, order, every)

    def step(batch: DataFrame, number: int) -> None:
        kept.fold(number)
        last = batch.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value), F.max(order).alias(order))
        kept.write(number, last)

    return _run(stream, checkpoint, step)
