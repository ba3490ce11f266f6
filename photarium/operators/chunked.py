"""A vector index that is built in chunks, each of which is kept once it is written."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.operators.dedup import content_key
from photarium.operators.vectors import encode
from photarium.sources.scratch import discard, materialize, temporary

#: Assets of a chunk: what a lost run encodes again at most.
CHUNK_ROWS = 1 << 20


class ChunkedIndex:
    """Vectors under ``path``: folders ``chunk=n``, numbered in the order of writing.

    A chunk holds the rows it encoded: the signature (key, md5, size, mtime), the
    vector and, for a row that failed, its error. It counts once its writer has
    finished. A build encodes what no finished chunk holds, chunk by chunk, so a
    run that is lost goes on behind the last written chunk and encodes nothing
    twice but what failed. Rows of gone or changed assets are not read any more;
    ``compact`` writes the live ones as one chunk.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "path", key_type: str = "string"):
        self.spark, self.path, self.key = spark, path, key
        self.schema = f"`{key}` {key_type}, md5 string, size long, mtime long, vector array<float>, error string"

    def _chunks(self) -> dict[int, str]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in files.listStatus(root) if x.isDirectory()] if files.exists(root) else []
        return {int(p.getName().split("=")[1]): p.toString() for p in found if p.getName().startswith("chunk=") and files.exists(jvm.Path(p, "_SUCCESS"))}

    def _written(self) -> DataFrame:
        chunks = list(self._chunks().values())
        return self.spark.read.schema(self.schema).parquet(*chunks) if chunks else self.spark.createDataFrame([], self.schema)

    def vectors(self, assets: DataFrame) -> DataFrame:
        """Signature and vector of live, unchanged assets; of a row in several chunks one."""
        sig = [self.key, "md5", "size", "mtime"]
        now = assets.select(*(F.col(c).alias(f"{c}_") for c in sig))
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in sig]
        live = self._written().where("vector IS NOT NULL").join(now, same, "left_semi")
        return live.groupBy(*sig).agg(F.first("vector").alias("vector"))

    def build(self, assets: DataFrame, encoder: Callable[[], Callable], dim: int, content: str = "content", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        """Encode what is missing; ``key, status`` in skipped_existing, skipped_md5, new, failed.

        Of assets with one content the first is encoded, and none if the index
        holds that content; an asset without a hash is a content of its own.
        Vectors of another length than ``dim`` fail.
        """
        key, sig = self.key, [self.key, "md5", "size", "mtime"]
        # What a run finds written is settled before it adds to it.
        held = materialize(self.vectors(assets).select(sig), "held")
        todo = assets.join(held.select(key), key, "left_anti")
        known = todo.join(held.select("md5").distinct(), "md5", "left_semi").select(key)
        fresh = todo.join(held.select("md5").distinct(), "md5", "left_anti")
        firsts = materialize(fresh.groupBy(content_key("md5", key).alias("c")).agg(F.min(key).alias(key)).select(key), "firsts")
        chunks = math.ceil(firsts.count() / chunk_rows)
        begin = max(self._chunks(), default=-1) + 1
        for n in range(chunks):
            mine = firsts.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == n)
            rows = assets.join(mine, key, "left_semi").withColumns({"md5": F.col("md5").cast("string"), "size": F.col("size").cast("long"), "mtime": F.col("mtime").cast("long")})
            with temporary(self.spark):
                coded = materialize(encode(rows, encoder, key, content), "coded")  # encoders are dear: once a row
                good = F.size("vector") == dim
                error = F.when(F.col("vector").isNotNull() & ~good, F.concat(F.size("vector").cast("string"), F.lit(" components"))).otherwise(F.col("error"))
                found = rows.select(sig).join(coded, key).select(*sig, F.when(good, F.col("vector")).alias("vector"), error.alias("error"))
                found.write.mode("overwrite").parquet(f"{self.path}/chunk={begin + n}")
        added = self.vectors(assets).join(firsts, key, "left_semi").select(key, F.lit("new").alias("status"))
        coded = firsts.join(added.select(key, F.lit(1).alias("ok")), key, "left").select(key, F.when(F.col("ok") == 1, "new").otherwise("failed").alias("status"))
        status = held.select(key, F.lit("skipped_existing").alias("status")).union(known.select(key, F.lit("skipped_md5")))
        return status.union(fresh.join(firsts, key, "left_anti").select(key, F.lit("skipped_md5"))).union(coded)

    def compact(self, assets: DataFrame) -> None:
        """The live rows as one chunk; the others go once it is written."""
        old = self._chunks()
        sig = [self.key, "md5", "size", "mtime"]
        rows = self.vectors(assets).select(*sig, "vector", F.lit(None).cast("string").alias("error"))
        rows.write.mode("overwrite").parquet(f"{self.path}/chunk={max(old, default=-1) + 1}")
        for folder in old.values():
            discard(self.spark, folder)
