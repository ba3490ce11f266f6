"""Operator 3: benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.sources.scratch import materialize

WIDTH = 5
THRESHOLD = 0.8
#: Rows of item sketches (24 bytes each) and bytes of item shingles that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _shingles(words: Column, width: int = WIDTH) -> Column:
    """Runs of ``width`` words as structs; a shorter sequence of words is one run, filled with blanks."""
    n = F.size(words)
    filled = F.when(n == 0, words).when(n < width, F.concat(words, F.array_repeat(F.lit(""), width - n))).otherwise(words)
    count = F.size(filled) - (width - 1)
    zipped = F.arrays_zip(*(F.when(count > 0, F.slice(filled, k + 1, F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias(f"w{k}") for k in range(width)))
    return zipped


def _exploded(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """One row per shingle with columns w0.., and their hash h."""
    rows = df.select(*keep, _shingles(_words(F.col(text_col))).alias("all")).select(*keep, F.explode("all").alias("s"))
    parts = [F.col(f"s.w{k}").alias(f"w{k}") for k in range(WIDTH)]
    return rows.select(*keep, *parts).withColumn("h", F.xxhash64(*(f"w{k}" for k in range(WIDTH))))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs ``doc_id, item_id, shared, item_shingles, containment`` with containment >= ``threshold``.

    Containment is the share of an item's distinct five-word shingles that the
    document has; words are lower-case runs of letters and digits, and a text of
    fewer than five words is one shingle of all its words.

    Items fall into size classes by doubling shingle count. An item keeps its
    bottom-k MinHash sketch, k = floor((1 - threshold) * upper bound of its
    class) + 1. A document that holds the threshold's share misses fewer than k
    shingles of the item, so it has one of any k of them, the k smallest hashes
    included: candidate search by sketch lookup has full recall whatever the
    length of the document, which MinHash of the whole document can't give.
    Each class has its own k and thus its own part of the lookup table. Candidates
    are then verified on the words themselves, not on hashes.

    Rows that share an id count as one document. Null and empty texts and items
    without words match nothing. Extra columns are ignored.
    """
    own = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    words = [f"w{k}" for k in range(WIDTH)]
    item_shingles = materialize(_exploded(own, ["item_id"], "text").distinct(), "item-shingles")
    sizes = item_shingles.groupBy("item_id").agg(F.count("*").alias("item_shingles"), F.array_sort(F.collect_list("h")).alias("hashes"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("item_shingles"))))
    slack = F.floor(F.lit(1 - threshold) * upper + F.lit(1e-9)).cast("int") + 1
    sketch = sizes.select("item_id", F.explode(F.slice("hashes", F.lit(1), slack)).alias("h"))
    sketch = materialize(sketch, "item-sketches")
    small = sketch.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = _exploded(rows, ["doc_id"], "text").select("doc_id", "h").join(hint(sketch), "h")
    candidates = materialize(hits.select("doc_id", "item_id").distinct(), "candidates")

    suspects = rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    item_rows = item_shingles.drop("h")
    size = item_rows.agg(F.count("*").alias("n"), F.sum(sum(F.octet_length(w) + 24 for w in words)).alias("size")).first()
    hint = F.broadcast if size["n"] <= BROADCAST_ROWS and (size["size"] or 0) <= BROADCAST_BYTES else (lambda df: df)
    found = _exploded(suspects, ["doc_id"], "text").drop("h").join(hint(item_rows), words).select("doc_id", "item_id", *words).distinct()
    shared = found.join(candidates, ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    counted = shared.join(sizes.select("item_id", "item_shingles"), "item_id")
    return counted.withColumn("containment", F.col("shared") / F.col("item_shingles")).where(F.col("containment") >= threshold).select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda w: w <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda w: w <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM dw WHERE len(ws) > 0)),
its AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM its GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE shared / item_shingles >= 0.8
"""
