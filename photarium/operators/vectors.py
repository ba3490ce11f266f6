"""Vectors: norms, centroids, blocked threshold joins, exact top-k and index maintenance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one side of a block pair.
BLOCK_ROWS = 2048
#: Components of all queries together that go to the tasks as one matrix: 64 MB.
QUERY_CELLS = 8_000_000
#: Cells of one product of vectors in a task: 8 MB.
PRODUCT = 1_000_000
#: Components of the sums that a task holds before it passes them on: 16 MB.
SUM_CELLS = 2_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 when either norm is 0."""
    norm = l2_norm(a) * l2_norm(b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    norm = l2_norm(v)
    return F.transform(v, lambda x: x.cast("double") / norm)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def matrix_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of an Arrow column of lists of ``dim`` numbers; null numbers are nan."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def vector_sums(vectors: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """``by, size, total, n``: element-wise sum and count of each group's vectors of each length.

    Sums are taken in Arrow batches before anything is shuffled, so a task sends
    one row a group, whatever the rows. Vectors that are null, empty or not
    finite are left out.
    """
    partial = vectors.select(by, F.col(vec).cast("array<double>").alias("total"), F.lit(1).cast("long").alias("n"))
    return add_sums(_added(partial, [by]).withColumn("size", F.size("total")).select(by, "size", "total", "n"), [by, "size"])


def add_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Sums (keys, total, n) of the same keys added up: one row each."""
    return _added(sums.repartition(*keys).sortWithinPartitions(*keys), keys, True)


def _added(rows: DataFrame, keys: list[str], ordered: bool = False) -> DataFrame:
    """Rows keys, total, n summed by keys and length within tasks; ``ordered`` rows come key by key and give one row each."""
    kinds = {n: t for n, t in rows.dtypes}
    schema = rows.select(*keys, "total", "n").limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        cells = 0

        def flush(names: list[tuple]) -> pa.RecordBatch:
            rows = [(k, held.pop(k)) for k in names]
            columns = [pa.array([k[i] for k, _ in rows], schema.types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v[0].tolist() for _, v in rows], schema.field("total").type), pa.array([v[1] for _, v in rows], pa.int64())], schema=schema)

        for batch in batches:
            sizes = pc.list_value_length(batch.column(len(keys))).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[sizes > 0]):
                some = batch.filter(pa.array(sizes == n))
                x = matrix_of(some.column(len(keys)), int(n))
                good = np.isfinite(x).all(axis=1)
                names = list(zip(*(some.column(i).filter(pa.array(good)).to_pylist() for i in range(len(keys)))))
                x, counts = x[good], some.column(len(keys) + 1).to_numpy(zero_copy_only=False)[good]
                codes: dict[tuple, int] = {}
                code = np.array([codes.setdefault(k, len(codes)) for k in names], np.int64)
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                totals, ns = (np.add.reduceat(v[order], starts) for v in (x, counts)) if len(order) else ((), ())
                for k, total, m in zip(codes, totals, ns):
                    key = (*k, int(n))
                    if key in held:
                        held[key][0] += total
                        held[key][1] += int(m)
                    else:
                        held[key], cells = [total.copy(), int(m)], cells + int(n)
            if cells > SUM_CELLS:
                # The last key of ordered rows may go on in the next batch.
                done = list(held)[: len(held) - ordered]
                yield flush(done)
                cells = sum(len(v[0]) for v in held.values())
        if held:
            yield flush(list(held))

    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "total array<double>, n long"])
    return rows.select(*keys, "total", "n").mapInArrow(run, ddl)


def centroids(vectors: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """``by, centroid, members``: element-wise mean in double, then unit length; a zero mean is dropped.

    Sums by ``vector_sums``. Of a group with vectors of several lengths the most
    frequent length counts, of equals the longer.
    """
    return centroids_of_sums(vector_sums(vectors, by, vec), by)


def centroids_of_sums(sums: DataFrame, by: str) -> DataFrame:
    """``by, centroid, members`` of rows by, size, total, n."""
    most = sums.groupBy(by).agg(F.max_by(F.struct("total", "n"), F.struct("n", "size")).alias("s")).select(by, F.transform("s.total", lambda x: x / F.col("s.n")).alias("mean"), F.col("s.n").alias("members"))
    return most.where(l2_norm(F.col("mean")) > 0).select(by, unit(F.col("mean")).alias("centroid"), "members")


def _best_of_block(keys: pa.Array, x: np.ndarray, queries: np.ndarray, starts: np.ndarray, own: dict, top: np.ndarray, min_sim: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, query, similarity)`` of rows that are among the best of each query so far, all ties included; a query is the run of ``queries`` from its start.

    ``own``: key -> queries that leave it out. ``top``: a row for each rank, a
    column for each query; the best similarities so far, -inf at first, brought up
    to date. Rows are taken in slices, so that a product has PRODUCT cells at most.
    """
    held, k = [], len(top)
    names = keys.to_pylist() if own else ()
    step = max(k, PRODUCT // max(1, len(queries)))
    for low in range(0, len(x), step):
        sim = x[low : low + step] @ queries.T
        fused = np.maximum.reduceat(sim, starts, axis=1) if len(starts) < len(queries) else sim
        np.copyto(fused, -np.inf, where=np.isnan(fused))
        for i, name in enumerate(names[low : low + step]):
            for q in own.get(name, ()):
                fused[i, q] = -np.inf
        best = np.partition(fused, -k, axis=0)[-k:] if len(fused) > k else fused
        top[:] = np.partition(np.vstack([top, best]), -k, axis=0)[-k:]
        # equal scores at the border all stay, so that ties end as in a full sort
        i, q = np.nonzero((fused >= top.min(axis=0)) & (fused > -np.inf) & ((fused >= min_sim) if min_sim is not None else True))
        held.append((i + low, q, fused[i, q]))
    return tuple(np.concatenate([h[n] for h in held]) if held else np.zeros(0, np.int64) for n in range(3))


def _asked(table: pa.Table, dim: int, exclude_self: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, dict]:
    """Queries ``g, q, v`` as ``(names, matrix, starts, own)``: variants of a query stand together."""
    table = table.sort_by("g").combine_chunks()
    matrix = matrix_of(table["v"], dim)
    codes: dict = {}
    groups = table["g"].to_pylist()
    place = np.array([codes.setdefault(g, len(codes)) for g in groups], np.int64)
    own: dict = {}
    if exclude_self:
        for g, q in set(zip(groups, table["q"].to_pylist())):
            own.setdefault(q, []).append(codes[g])
    return pa.array(list(codes), table.schema.field("g").type), matrix, np.flatnonzero(np.diff(place, prepend=-1)), own


def _topk_in_blocks(vectors: DataFrame, queries: DataFrame, dim: int, k: int, exclude_self: bool, min_sim: float | None) -> DataFrame:
    """``query_id, key, similarity`` candidates of more queries than fit one matrix: blocks of queries against blocks of vectors.

    ``vectors``: key, vector; ``queries``: g, q, v. A task holds a block of each
    and keeps the top k of each query (all ties included) in its block.
    """
    vb, qb = (max(1, math.ceil(df.count() / BLOCK_ROWS)) for df in (vectors, queries))
    left = vectors.withColumn("vb", F.pmod(F.xxhash64("key"), F.lit(vb)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("g"), F.lit(qb)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))))
    kind, out = dict(vectors.dtypes)["key"], dict(queries.dtypes)["g"]

    def score(one: pa.Table, two: pa.Table) -> pa.Table:
        one = one.combine_chunks()
        if not (one.num_rows and two.num_rows):
            names, i, q, sim = pa.array([], two.schema.field("g").type), *(np.zeros(0, np.int64),) * 2, np.zeros(0)
        else:
            names, matrix, starts, own = _asked(two, dim, exclude_self)
            i, q, sim = _best_of_block(one["key"], matrix_of(one["vector"], dim), matrix, starts, own, np.full((k, len(starts)), -np.inf), min_sim)
        return pa.table({"query_id": names.take(pa.array(q)), "key": one["key"].take(pa.array(i)), "similarity": sim})

    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(score, f"query_id {out}, key {kind}, similarity double")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "key", vec: str = "vector", fuse_by: str | None = None, exclude_self: bool = True, alive: DataFrame | None = None, min_sim: float | None = None) -> DataFrame:
    """``query_id, key, similarity, rank``: exact inner-product top-k of each query.

    ``queries``: ``query_id, vector`` and, with ``fuse_by``, that column: an
    asset's similarity is then its maximum over the variants of a query. Queries
    go to the tasks as one matrix of up to QUERY_CELLS components, or beyond in
    blocks; a task only passes on what is among its k best so far, and one window
    ranks what is left. ``alive`` (column ``key``) drops dead rows before the ranking,
    so k hits stay k. Queries of different lengths are an error; a query without
    a vector has no hits, vectors of another length or null are no hits, and a
    similarity that is no number counts as none.
    """
    if alive is not None:
        vectors = vectors.join(alive.select(F.col(alive.columns[0]).alias(key)), key, "left_semi")
    group = fuse_by or "query_id"
    asked = queries.select(F.col(group).alias("g"), F.col("query_id").alias("q"), F.col("vector").cast("array<double>").alias("v")).where("size(v) > 0")
    kind, out = dict(vectors.dtypes)[key], dict(queries.dtypes)[group]
    shape = asked.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("dim")).first()
    if not shape["n"]:
        return vectors.sparkSession.createDataFrame([], f"query_id {out}, key {kind}, similarity double, rank int")
    if shape["low"] != shape["dim"]:
        raise ValueError(f"queries of {shape['low']} to {shape['dim']} components")
    dim = shape["dim"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key"))
    rows = vectors.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vector")).where(F.size("vector") == dim)
    if shape["n"] * dim > QUERY_CELLS:
        return _topk_in_blocks(rows, asked, dim, k, exclude_self, min_sim).withColumn("rank", rank).where(F.col("rank") <= k)
    names, matrix, starts, own = _asked(asked.toArrow(), dim, exclude_self)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((k, len(starts)), -np.inf)
        for batch in it:
            i, q, sim = _best_of_block(batch.column(0), matrix_of(batch.column(1), dim), matrix, starts, own, top, min_sim)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch.column(0).take(pa.array(i)), pa.array(sim)], names=["query_id", "key", "similarity"])

    best = rows.mapInArrow(scan, f"query_id {out}, key {kind}, similarity double")
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def check_model(vectors: DataFrame, model_id: str, column: str = "model_id") -> DataFrame:
    """``vectors`` if they all come from ``model_id``; else an error."""
    others = [r[0] for r in vectors.where(~F.col(column).eqNullSafe(model_id)).select(column).distinct().limit(5).collect()]
    if others:
        raise ValueError(f"index holds vectors of {others}, the query is from {model_id}")
    return vectors


def encode(assets: DataFrame, loader: Callable[[], Callable], key: str, content: str, max_failures: int = 3) -> DataFrame:
    """``key, vector, error`` by a user's encoder, loaded once a partition.

    A failing row has a null vector and its error; after ``max_failures``
    failures in a row the rest of the partition is not tried.
    """
    kind = dict(assets.dtypes)[key]

    def run(it):
        model, bad = loader(), 0
        for pdf in it:
            vectors, errors = [], []
            for item in pdf[content]:
                if bad >= max_failures:
                    vectors.append(None)
                    errors.append("skipped: too many failures in a row")
                    continue
                try:
                    vectors.append([float(x) for x in model(item)])
                    errors.append(None)
                    bad = 0
                except Exception as e:
                    vectors.append(None)
                    errors.append(str(e)[:200])
                    bad += 1
            yield pdf[[key]].assign(vector=vectors, error=errors)

    return assets.select(key, content).mapInPandas(run, f"`{key}` {kind}, vector array<float>, error string")


def index_delta(assets: DataFrame, vectors: DataFrame, encoder: Callable[[], Callable], dim: int, key: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """``(vectors, status)`` after one incremental build.

    ``assets``: key, md5, size, mtime and ``content``; ``vectors``: key, md5,
    size, mtime, vector. Dead and changed rows go, unchanged ones stay, a content
    hash already held (or met earlier in the batch) is skipped, the rest is
    encoded and rows of another dimension fail. ``status``: key, status in
    skipped_existing, skipped_md5, new, failed.
    """
    sig = [key, "md5", "size", "mtime"]
    now = assets.select(*(F.col(c).alias(f"{c}_now") for c in sig))
    kept = vectors.join(now, [F.col(c).eqNullSafe(F.col(f"{c}_now")) for c in sig], "left_semi")
    first = F.row_number().over(Window.partitionBy(F.coalesce(F.concat(F.lit("md5:"), "md5"), F.concat(F.lit("key:"), F.col(key).cast("string")))).orderBy(key)) == 1
    todo = assets.join(kept.select(key), key, "left_anti")
    known = todo.join(kept.select("md5").distinct(), "md5", "left_semi")
    fresh = todo.join(kept.select("md5").distinct(), "md5", "left_anti").withColumn("first", first)
    coded = encode(fresh.where("first"), encoder, key, content)
    good = coded.where(F.col("vector").isNotNull() & (F.size("vector") == dim))
    added = fresh.where("first").select(sig).join(good.select(key, "vector"), key)
    status = (
        kept.select(key, F.lit("skipped_existing").alias("status"))
        .union(known.select(key, F.lit("skipped_md5")))
        .union(fresh.where("NOT first").select(key, F.lit("skipped_md5")))
        .union(coded.select(key, F.when(F.col("vector").isNotNull() & (F.size("vector") == dim), "new").otherwise("failed")))
    )
    return kept.select(*sig, "vector").unionByName(added.select(*sig, "vector")), status


def index_prune(vectors: DataFrame, alive: DataFrame, key: str = "path") -> DataFrame:
    return vectors.join(alive.select(key), key, "left_semi")


def index_status(vectors: DataFrame, assets: DataFrame, dim: int, model_id: str | None = None, key: str = "path") -> DataFrame:
    """One row ``state, indexed, total, stale``."""
    counts = vectors.join(assets.select(key, F.lit(1).alias("live")), key, "left").agg(
        F.count("*").alias("rows"), F.count("live").alias("indexed"), F.count_if(F.col("live").isNull()).alias("stale"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != dim).alias("broken"),
        (F.count_if(~F.col("model_id").eqNullSafe(model_id)) if model_id else F.lit(0)).alias("other"),
    )
    total = assets.agg(F.count("*").alias("total"))
    state = F.when(F.col("rows") == 0, "missing").when(F.col("broken") > 0, "corrupt").when(F.col("other") > 0, "mismatch").when(F.col("indexed") < F.col("total"), "incomplete").otherwise("ready")
    return counts.crossJoin(total).select(state.alias("state"), "indexed", "total", "stale")  # one row each
