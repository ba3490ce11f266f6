"""Substring search by postings of short grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photarium.sources.scratch import bounded, materialize, scratch_path

#: Characters of a gram; shorter words and queries have grams of one and two.
GRAM = 3
#: Entries that one query may fetch by its rarest gram; a query beyond is answered by an ordered scan.
BROAD = 10_000
#: Ranges of the ordered scan: this many more at each turn.
WIDER = 8
#: Entries of one range, about.
PART_ROWS = 1 << 14
#: Queries that are broadcast.
QUERIES = 10_000


def normal(text: Column) -> Column:
    """Lower case without blanks around; null is empty."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _grams(text: Column, size: int) -> Column:
    """Distinct grams of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(text, k, F.lit(size)))))


class SubstringIndex:
    """Entries in their order, and for each gram of one to GRAM characters the entries that hold it.

    ``build`` writes the tables once; they serve any number of searches and any
    filter. A query is looked up by its rarest gram, whose entries are tested for
    the whole query; nothing else is read (both tables are sorted, so Parquet skips
    what lies between). A query whose rarest gram has more than ``broad`` entries
    is likely to find its hits early: it scans the entries in order, range by
    range, until it has enough, and so do all queries if their lookups together
    would fetch more than there are entries. A scan tests the entries that hold a
    query's rarest gram. Equal queries are answered once. Either way the hits are
    those of testing every entry.
    """

    def __init__(self, entries: DataFrame, postings: DataFrame, counts: DataFrame):
        self.entries, self.postings, self.counts = entries, postings, counts

    @classmethod
    def build(cls, rows: DataFrame, haystack: str, order: list[Column | str], path: str | None = None) -> SubstringIndex:
        """``rows``: any columns, among them the text to search; ``order``: a total order, in which hits are ranked."""
        spark = rows.sparkSession
        path = path or scratch_path(spark, "search-index")
        text = F.lower(F.coalesce(F.col(haystack), F.lit("")))
        parts = max(1, -(-rows.count() // PART_ROWS))
        ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"hay_": text, "no_": F.monotonically_increasing_id(), "part_": F.spark_partition_id()})
        entries = materialize(ranged, "entries", f"{path}/entries")
        grams = entries.select("no_", F.explode(F.concat(*(_grams(F.col("hay_"), n) for n in range(1, GRAM + 1)))).alias("gram"))
        postings = materialize(grams.repartitionByRange("gram", "no_").sortWithinPartitions("gram", "no_"), "postings", f"{path}/postings")
        counts = materialize(postings.groupBy("gram").agg(F.count("*").alias("n")), "counts", f"{path}/counts")
        return cls(entries, postings, counts)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SubstringIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("entries", "postings", "counts")))

    def planned(self, queries: DataFrame) -> DataFrame:
        """``query_id, text, gram, n``: the rarest gram and its entries; an empty query has none, an unknown gram 0."""
        asked = queries.select("query_id", normal(F.col("text")).alias("text"))
        size = F.least(F.length("text"), F.lit(GRAM))
        grams = F.when(size == 1, _grams(F.col("text"), 1)).when(size == 2, _grams(F.col("text"), 2)).otherwise(_grams(F.col("text"), GRAM))
        each = asked.select("query_id", "text", F.explode_outer(grams).alias("gram")).join(self.counts, "gram", "left")
        best = each.groupBy("query_id", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        return best.select("query_id", "text", "best.gram", F.when(F.col("best.gram").isNotNull(), F.col("best.n")).alias("n"))

    def search(self, queries: DataFrame, limit: int, where: Column | None = None, broad: int = BROAD) -> DataFrame:
        """``query_id, rank`` and the entries' columns: the first ``limit`` entries, in order, that contain each query and pass ``where``.

        ``queries``: query_id (unique), text; case and blanks around don't count,
        an empty or null text matches everything. Equal entries are all found.
        """
        queries = materialize(queries.select("query_id", normal(F.col("text")).alias("text")), "queries")
        asked = materialize(self.planned(queries.select(F.col("text").alias("query_id"), "text").distinct()).select("text", "gram", "n"), "asked")
        kept = (self.entries if where is None else self.entries.where(where)).select("no_", "part_", "hay_")
        narrow = F.col("n").between(1, broad)
        if (asked.where(narrow).agg(F.sum("n")).first()[0] or 0) > self.entries.count():
            narrow = F.lit(False)  # together they would fetch more than a scan reads
        met = self.postings.join(bounded(asked.where(narrow), QUERIES), "gram").select("text", "no_")
        hits = self._ranked(kept.join(met, "no_").where(F.contains("hay_", "text")).select("text", "no_"), limit)
        first = kept.select("no_").orderBy("no_").limit(limit)
        hits = hits.unionByName(self._ranked(asked.where("gram IS NULL").select("text").crossJoin(first), limit))  # the empty text, if asked
        parts = self.entries.agg(F.max("part_")).first()[0]
        low, high = -1, 0
        left = materialize(asked.where(~narrow & (F.col("n") > 0)).select("text", "gram", F.lit(0).cast("long").alias("got")), "wide")
        while parts is not None and low < parts and (sizes := sorted(r[0] for r in left.select(F.length("gram")).distinct().collect())):
            some = kept.where((F.col("part_") > low) & (F.col("part_") <= high))
            some = some.select("no_", "hay_", F.explode(F.concat(*(_grams(F.col("hay_"), n) for n in sizes))).alias("gram"))
            some = some.join(bounded(left.select("text", "gram"), QUERIES), "gram").where(F.contains("hay_", "text"))
            some = materialize(self._ranked(some.select("text", "no_"), limit), "scanned")
            hits = hits.unionByName(some)
            counts = some.groupBy("text").agg(F.count("*").alias("more"))
            left = left.join(counts, "text", "left").select("text", "gram", (F.col("got") + F.coalesce("more", F.lit(0))).alias("got"))
            left, low, high = materialize(left.where(F.col("got") < limit), "wide"), high, (high + 1) * WIDER
        found = materialize(self._ranked(hits.drop("rank"), limit), "hits")
        return queries.join(found, "text").join(self.entries, "no_").drop("no_", "part_", "hay_", "text")

    @staticmethod
    def _ranked(found: DataFrame, limit: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("text").orderBy("no_"))
        return found.withColumn("rank", rank).where(F.col("rank") <= limit)
