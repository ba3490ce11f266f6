"""Operator 6: embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.operators.graph import component_stars
from photarium.sources.scratch import materialize

#: Tables at least; larger inputs take more (see ``plan``).
TABLES = 32
MOST_TABLES = 256
#: Collisions that a pair needs at least; the calibrated count can be higher.
LEAST = 2
#: Vectors a bucket holds on average; the number of sign bits follows from it and the row count.
BUCKET = 192
#: Rows of one block of a crowded bucket.
BLOCK = 1024
#: Queries of a bucket that are multiplied with their windows at once.
QUERIES = 256
#: Bucket sizes (16 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
RECALL = 0.98
SEED = 5


class Projections:
    """For each table some half-space projections (the bucket) and one sorted projection (the window)."""

    def __init__(self, dim: int, bits: int, threshold: float, tables: int = TABLES):
        rng = np.random.default_rng(SEED)
        self.bits, self.tables, self.threshold = bits, tables, threshold
        self.planes = rng.standard_normal((dim, tables * bits)) if bits else np.zeros((dim, 0))
        self.lines = rng.standard_normal((dim, tables))
        # A pair at the threshold is at distance sqrt(2 - 2 t): its projections differ by that times a normal deviate.
        self.window = 1.75 * math.sqrt(2 - 2 * threshold)
        self.need = calibrated_count(tables, collision(bits, threshold), RECALL)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros((len(unit), self.tables), np.int64)
        signs = (unit @ self.planes > 0).reshape(len(unit), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))


def collision(bits: int, threshold: float) -> float:
    """Chance that a pair at the threshold collides in one table."""
    return (1 - math.acos(threshold) / math.pi) ** bits * math.erf(1.75 / math.sqrt(2))


def plan(n: int, threshold: float, tables: int = TABLES, bucket: int = BUCKET, bits: int | None = None) -> tuple[int, int]:
    """Sign bits and tables for ``n`` rows: a pair at the threshold collides LEAST times or more with probability RECALL.

    More bits take more tables. Beyond MOST_TABLES there are fewer bits instead,
    and the block pairs carry the larger buckets.
    """
    bits = max(0, math.ceil(math.log2(max(1, n / bucket)))) if bits is None else bits
    enough = lambda t: 1 - sum(math.comb(t, k) * (p := collision(bits, threshold)) ** k * (1 - p) ** (t - k) for k in range(LEAST)) >= RECALL
    while bits and not enough(max(tables, MOST_TABLES)):
        bits -= 1
    while not enough(tables):
        tables += 1
    return bits, tables


def calibrated_count(tables: int, p: float, recall: float) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall``; 1 at least."""
    below = 0.0
    for count in range(tables):
        below += math.comb(tables, count) * p**count * (1 - p) ** (tables - count)
        if below > 1 - recall:
            return max(1, count)
    return tables


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of large components stay finite
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def block_links(left: np.ndarray, right: np.ndarray | None, table: int, proj: Projections) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked vectors for which ``table`` is the first table where they collide.

    Left and right share the table's bucket (right None: left with itself). Both
    are sorted by the table's projection, and each query takes the window centred
    on it. Pairs in the window are sifted by their product; for the rows that are
    left, few in most buckets, collisions over all tables are counted, and pairs
    that reach the calibrated count are verified in double precision.
    """
    lu = _unit(left)
    ru = lu if right is None else _unit(right)
    lp, rp = lu @ proj.lines[:, table], ru @ proj.lines[:, table]
    queries, order = np.argsort(lp, kind="stable"), np.argsort(rp, kind="stable")
    low = np.searchsorted(rp[order], lp[queries] - proj.window, "left")
    high = np.searchsorted(rp[order], lp[queries] + proj.window, "right")
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(queries), QUERIES):
        some, span = queries[k : k + QUERIES], order[low[k] : high[min(k + QUERIES, len(queries)) - 1]]
        near = lu[some] @ ru[span].T >= proj.threshold - 1e-9
        i, j = np.nonzero(near)
        inside = np.abs(lp[some[i]] - rp[span[j]]) <= proj.window
        i, j = some[i[inside]], span[j[inside]]
        if right is None:
            i, j = i[i < j], j[i < j]
        found_i.append(i)
        found_j.append(j)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    keep_i, keep_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 21) // max(proj.tables, lu.shape[1]))
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        (ra, at), (rb, bt) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        same = (proj.buckets(lu[ra])[at] == proj.buckets(ru[rb])[bt]) & (np.abs((lu[ra] @ proj.lines)[at] - (ru[rb] @ proj.lines)[bt]) <= proj.window)
        same[:, table] = True  # this table has found the pair
        take = (same.sum(axis=1) >= proj.need) & ~same[:, :table].any(axis=1)
        a, b = a[take], b[take]
        close = np.einsum("ij,ij->i", lu[a], ru[b]) >= proj.threshold
        keep_i.append(a[close])
        keep_j.append(b[close])
    return np.concatenate(keep_i), np.concatenate(keep_j)


def embedding_links(classes: DataFrame, threshold: float = 0.9, tables: int = TABLES, bucket: int = BUCKET, bits: int | None = None) -> DataFrame:
    """``(a, b, n)``: per class ``a`` partial link counts ``n`` weighted by class size, with one linked class ``b`` each.

    ``classes``: ``class_id, embedding, members``, all of one length. Projections alone
    would pair a fixed share of all rows; so each table nests its sorted
    projection in a bucket of sign bits, as many as leave some ``bucket`` rows.
    Bucket sizes are counted first; a crowded bucket is dealt as pairs of blocks
    of BLOCK rows, so no task holds more than two blocks. A pair is reported by
    the first table in which it collides, so nothing is counted twice and no
    pair is shuffled: a task emits for each of its vectors one row with the
    number of linked members and the smallest linked class.
    """
    stats = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not stats["n"]:
        return classes.sparkSession.createDataFrame([], "a long, b long, n long")
    bits, tables = plan(stats["n"], threshold, tables, bucket, bits)
    kind = dict(classes.dtypes)["embedding"]
    proj = Projections(stats["dim"], bits, threshold, tables)

    def keyed_rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = max(1, 10_000 * TABLES // proj.tables)
        for batch in (b.slice(k, step) for b in it for k in range(0, b.num_rows, step)):
            unit = _unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
            yield batch, proj.buckets(unit) + (np.arange(proj.tables, dtype=np.int64) << 48)

    def sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key in keyed_rows(it):
            names, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["key", "size"])

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, key in keyed_rows(it):
            flat = pa.array(np.repeat(np.arange(batch.num_rows), proj.tables))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), *(batch.column(k).take(flat) for k in range(3))], names=["key", "class_id", "embedding", "members"])

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(cell, rows):
            sides = [[r for r in rows if r[4] == s] for s in ((cell[1],) if cell[1] == cell[2] else (cell[1], cell[2]))]
            if not all(sides) or len(rows) < 2:
                return None
            ids, sizes = [np.array([r[k] for r in s], np.int64) for s in sides for k in (1,)], [np.array([r[3] for r in s], np.int64) for s in sides]
            vecs = [np.array([r[2] for r in s], np.float64) for s in sides]
            i, j = block_links(vecs[0], vecs[1] if len(sides) == 2 else None, cell[0] >> 48, proj)
            if not len(i):
                return None
            li, ri, ls, rs = ids[0], ids[-1], sizes[0], sizes[-1]
            a = np.concatenate([li[i], ri[j]])
            b = np.concatenate([ri[j], li[i]])
            n = np.concatenate([rs[j], ls[i]])
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            first = np.append(0, np.flatnonzero(np.diff(a)) + 1)
            return a[first], b[first], np.add.reduceat(n, first)

        cell, rows = None, []
        for batch in it:
            cols = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), list(batch.column(2).to_numpy(zero_copy_only=False)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()]
            out = []
            for r in zip(*cols):
                if (r[0], r[5], r[6]) != cell:
                    out.append(emit(cell, rows) if rows else None)
                    cell, rows = (r[0], r[5], r[6]), []
                rows.append(r)
            out = [o for o in out if o]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b", "n"])
        last = emit(cell, rows) if rows else None
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=["a", "b", "n"])

    keyed = classes.select("class_id", "embedding", "members").mapInArrow(keys, f"key long, class_id long, embedding {kind}, members long")
    # Only keys with more than a block of rows are split; those are few, and the vectors are shuffled once.
    counts = classes.select("class_id", "embedding").mapInArrow(sizes, "key long, size long").groupBy("key").agg(F.sum("size").alias("size"))
    crowds = materialize(counts.where(F.col("size") > BLOCK), "buckets")
    crowds = F.broadcast(crowds) if crowds.count() <= BROADCAST_ROWS else crowds
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    dealt = keyed.join(crowds, "key", "left").withColumn("own", F.pmod(F.xxhash64("class_id"), blocks).cast("int"))
    other = dealt.select("key", "class_id", "embedding", "members", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = other.select("key", "class_id", "embedding", "members", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    sorted_cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "class_id")
    return sorted_cells.mapInArrow(links, "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", bits: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Equal vectors form one class and take part once; a row's links are the
    members of linked classes and the rest of its own class. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing,
    and vectors link with those of their own length. Rows with a null id
    link but name no component. ``bits`` fixes the sign bits of a bucket, which
    else follow from the row count. Repeated rows count as rows. Extra columns are
    ignored.
    """
    # Floats stay floats while they are moved; everything is computed in double precision.
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col).cast(kind), lambda x: x + F.lit(0).cast(kind[6:-1])).alias("embedding"))  # -0.0 becomes 0.0
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # A class is known by its number, and by all 128 bits where classes and rows are joined.
    digest = F.md5(F.array_join("embedding", ",").cast("binary"))
    rows = rows.withColumn("valid", valid).withColumn("digest", F.when(F.col("valid"), digest))
    grouped = rows.where("valid").groupBy("digest").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("low_id"), F.count("*").alias("members"))
    classes = materialize(grouped.withColumn("class_id", F.xxhash64("digest")), "classes")
    sizes = classes.groupBy(F.size("embedding").alias("dim")).count().where("count > 1").orderBy("dim").collect()
    found = [embedding_links(classes.where(F.size("embedding") == r["dim"]), threshold, bits=bits) for r in sizes]
    links = materialize(reduce(DataFrame.union, found, vectors.sparkSession.createDataFrame([], "a long, b long, n long")), "links")
    stars = component_stars(links.select("a", "b"))
    low = stars.join(classes, F.col("vertex") == F.col("class_id")).groupBy("component").agg(F.min("low_id").alias("component_id"))
    counts = links.groupBy("a").agg(F.sum("n").alias("linked"))
    labels = (
        classes.drop("embedding")
        .join(counts, F.col("class_id") == F.col("a"), "left")
        .join(stars, F.col("class_id") == F.col("vertex"), "left")
        .join(low, "component", "left")
        .select("digest", (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component_id", "low_id").alias("component_id"))
    )
    good = rows.where("valid").join(labels, "digest").select("vec_id", "n_links", "component_id")
    bad = rows.where("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
