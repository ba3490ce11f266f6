"""Detections as a table of buckets, of which a batch rewrites those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.operators.identity import complete_assets, upsert_detections
from photarium.sources.scratch import discard, exists, materialize, temporary


class DetectionTable:
    """Detections under ``path``, dealt by a hash of image_path into folders ``bucket=k``.

    A batch is worked out in scratch tables first and then written in one job that
    replaces the folders of its own buckets (dynamic partition overwrite): if
    anything fails before, the old rows are all there, and the files of other
    buckets are never touched. Running a batch again gives the same table. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("image_path"), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        schema = f"{self.schema}, bucket int"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def of_assets(self, paths: list[str]) -> DataFrame:
        """Rows of some assets; only their buckets are read."""
        asked = self._dealt(self.spark.createDataFrame([(p,) for p in paths], "image_path string"))
        wanted = [r[0] for r in asked.select("bucket").distinct().collect()]
        return self._stored().where(F.col("bucket").isin(wanted) & F.col("image_path").isin(paths)).drop("bucket")

    def upsert(self, batch: DataFrame, expected: DataFrame | None = None) -> None:
        """New rows replace old ones of their (image_path, detection_index).

        With ``expected`` (image_path, n) an asset's rows enter all together or,
        while some are missing, not at all.
        """
        with temporary(self.spark):
            whole = batch if expected is None else complete_assets(batch, expected)
            new = materialize(self._dealt(whole), "batch")
            touched = self._touched(new)
            if touched:
                old = self._stored().where(F.col("bucket").isin(touched))
                self._replace(upsert_detections(old, new), touched)

    def remove(self, gone: DataFrame) -> None:
        """Drop the rows of ``gone``: image_path, or image_path and detection_index."""
        with temporary(self.spark):
            gone = materialize(self._dealt(gone), "gone")
            touched = self._touched(gone)
            if touched:
                old = self._stored().where(F.col("bucket").isin(touched))
                self._replace(old.join(gone, gone.columns, "left_anti"), touched)

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets, of which there are no more than the table has."""
        return sorted(r[0] for r in rows.select("bucket").distinct().collect())

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        rows = materialize(rows, "merged")  # nothing is read from the table while it is written
        kept = {r[0] for r in rows.select("bucket").distinct().collect()}
        columns = [*(c for c in rows.columns if c != "bucket"), "bucket"]
        rows.select(columns).hint("rebalance", "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        for bucket in set(touched) - kept:
            discard(self.spark, f"{self.path}/bucket={bucket}")
