"""Tables that a stream keeps: a snapshot and the changes of the batches since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.sources.scratch import discard


class KeyedTable:
    """The last row of each key, written batch by batch under ``path``.

    Batch n writes its rows to ``changes/batch=n``. Every ``every`` batches the
    changes are folded into ``snapshot/version=m``, the state after batch m, and
    what lies before is deleted; so reading costs the snapshot and ``every``
    folders at most. A row replaces another of its key if it is later by
    ``order``, or without one if it comes from a later batch.

    Batches may be replayed: batch n reads what batches before n have left, and
    writes its own folder anew. Folding happens at the beginning of a batch, over
    batches that can't be replayed any more; a folder counts once its writer has
    finished, so a fold that is cut short is done again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str] | None = None, every: int = 8):
        self.spark, self.path, self.schema, self.keys, self.order, self.every = spark, path, schema, keys, order or [], every

    def _folders(self, kind: str) -> dict[int, str]:
        """Number -> folder, of what is written whole."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return {}
        found = [x.getPath() for x in files.listStatus(root) if x.isDirectory()]
        done = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(p.getName().split("=")[1]): p.toString() for p in done}

    def _version(self, before: int) -> int | None:
        return max((v for v in self._folders("snapshot") if v < before), default=None)

    def _frame(self, folders: dict[int, str]) -> DataFrame:
        """Rows with the number of the folder they stand in."""
        empty = self.spark.createDataFrame([], self.schema).withColumn("batch_", F.lit(0).cast("long"))
        for number, folder in sorted(folders.items()):
            empty = empty.unionByName(self.spark.read.schema(self.schema).parquet(folder).withColumn("batch_", F.lit(number).cast("long")))
        return empty

    def read(self, before: int = 1 << 62) -> DataFrame:
        """The table as the batches before number ``before`` have left it."""
        version = self._version(before)
        changes = {n: f for n, f in self._folders("changes").items() if n < before and (version is None or n > version)}
        base = {} if version is None else {version: self._folders("snapshot")[version]}
        rows = self._frame(base | changes)
        values = [c for c in rows.columns if c not in (*self.keys, "batch_")]
        last = F.max_by(F.struct(*values), F.struct(*self.order, "batch_")).alias("last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, *(F.col(f"last.{c}").alias(c) for c in values))

    def fold(self, number: int) -> None:
        """At the beginning of batch ``number``: fold what is due, drop what no reader needs."""
        version, changes = self._version(number), self._folders("changes")
        due = [n for n in changes if n < number and (version is None or n > version)]
        if len(due) >= self.every:
            self.start(self.read(number), number - 1)
            version = number - 1
        if version is not None:
            old = [f for n, f in changes.items() if n <= version] + [f for n, f in self._folders("snapshot").items() if n < version]
            for folder in old:
                discard(self.spark, folder)

    def start(self, rows: DataFrame, version: int = -1) -> None:
        """Write ``rows`` as the state after batch ``version``; -1 stands before the first."""
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshot/version={version}")

    def started(self) -> bool:
        return bool(self._folders("snapshot"))

    def write(self, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
