"""Threshold joins of vectors: exact by cells around pivots, and approximate by random projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.operators.grid import Test, block_count, grid_links, near_units, products
from photarium.operators.vectors import PRODUCT, l2_norm, matrix_of, unit, units
from photarium.sources.scratch import materialize

#: Rows of a cell that one task holds while the others pass by.
CELL_ROWS = 2048
#: Rows that share a pivot on average, and components of all pivots together, which every task holds.
PIVOT_ROWS, PIVOT_CELLS = 256, 4_000_000
#: Angles are compared with this slack, so that rounding loses no pair.
SLACK = 1e-6
#: Rows by which it is told how many cells a row visits.
ASKED_ROWS = 4096


class Cells:
    """Vectors of one length, dealt so that each pair that can reach the threshold meets in one cell.

    A vector belongs to the cell of its nearest pivot, which has the largest angle
    of its members as radius. Two vectors within the angle t of each other obey
    the triangle inequality, so a vector only visits cells whose pivot lies within
    radius + t of it, and of two cells the first visits the second. Cells of more
    than CELL_ROWS rows, such as many copies of a vector, are cut into parts.
    A task holds one part and lets its visitors pass by.
    """

    def __init__(self, vectors: DataFrame, key: str, vec: str, minimum: float, dim: int, pivots: int | None = None):
        kind = dict(vectors.dtypes)[key]
        self.kind, self.dim, self.minimum = kind, dim, minimum
        rows = vectors.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).where(F.size("v") == dim)
        rows = materialize(rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))), "vectors")
        self.keyed = rows.select("k").limit(0).toArrow().schema.types[0]
        n = rows.count()
        self.rows, self.n = rows, n
        pivots = pivots or max(1, min(math.ceil(n / PIVOT_ROWS), PIVOT_CELLS // dim))
        picked = rows.orderBy(F.xxhash64("k"), "k").limit(pivots).select("v").toArrow()  # a bounded sample
        heads = units(matrix_of(picked["v"], dim)) if picked.num_rows else np.zeros((1, dim))

        def angles(column: pa.Array) -> Iterator[np.ndarray]:
            x = units(matrix_of(column, dim))
            for k in range(0, len(x), step := max(1, PRODUCT // len(heads))):
                yield np.arccos(np.clip(x[k : k + step] @ heads.T, -1, 1))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(a.argmin(axis=1), a.min(axis=1)) for a in angles(batch.column(1))]
                cell, angle = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(angle)], names=["k", "v", "cell", "angle"])

        placed = materialize(rows.mapInArrow(own, f"k {kind}, v array<double>, cell long, angle double"), "placed")
        facts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toArrow()  # a row a pivot
        parts, radius = np.zeros(len(heads), np.int64), np.full(len(heads), -math.inf)
        at = facts["cell"].to_numpy()
        parts[at], radius[at] = -(-facts["n"].to_numpy() // CELL_ROWS), facts["radius"].to_numpy()
        reach = radius + math.acos(max(-1.0, min(1.0, minimum))) + SLACK
        first = np.cumsum(parts) - parts  # number of a cell's first part

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, part, low = batch.column(2).to_numpy(), batch.column(3).to_numpy(), 0
                targets: list[np.ndarray] = []
                for some in angles(batch.column(1)):
                    for a in some:
                        i, s = cell[low], part[low] % parts[cell[low]]
                        later = np.flatnonzero(a[i + 1 :] <= reach[i + 1 :]) + i + 1
                        mine = np.arange(first[i] + s, first[i] + parts[i])
                        others = np.repeat(first[later], parts[later]) + np.arange(parts[later].sum()) - np.repeat(np.cumsum(parts[later]) - parts[later], parts[later])
                        targets.append(np.concatenate([mine, others]))
                        low += 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([t.tolist() for t in targets], pa.list_(pa.int64()))], names=["k", "v", "targets"])

        spread = placed.select("k", "v", "cell", F.pmod(F.xxhash64("k"), F.lit(1 << 40)).alias("part"))
        shape = f"k {kind}, v array<double>, targets array<long>"
        dealt = spread.mapInArrow(deal, shape)
        self.asked = spread.where(F.pmod(F.xxhash64("k", F.lit(1)), F.lit(max(1, n // ASKED_ROWS))) == 0).mapInArrow(deal, shape)
        self.dealt = dealt.select("k", "v", F.posexplode("targets").alias("pos", "cell")).select("cell", (F.col("pos") > 0).alias("visitor"), "k", "v")

    def pruned(self) -> bool:
        """Whether rows travel less often by cells than in a grid of blocks; told by a bounded sample, the links are the same."""
        visits = self.asked.agg(F.avg(F.size("targets"))).first()[0]
        return (visits or 0) <= block_count(self.n, self.row_bytes())

    def grid(self) -> DataFrame:
        """``links`` over a grid of blocks, for vectors between which pivots tell little."""
        minimum, dim = self.minimum, self.dim

        def prepare(table: pa.Table) -> tuple:
            x = units(matrix_of(table["v"], dim))
            return x.astype(np.float32), x

        test = Test(prepare, lambda one, two: near_units(one[0], two[0], minimum), lambda one, two, i, j: products(one[1], two[1], i, j) >= minimum)
        return grid_links(self.rows, self.n, self.row_bytes(), test)

    def row_bytes(self) -> int:
        """Of a row that a task of the grid holds: in double and in single precision."""
        return 32 + 12 * self.dim

    def compared(self) -> DataFrame:
        """``cell, own, visitors, pairs``: what each task compares."""
        counts = self.dealt.groupBy("cell").agg(F.count_if(~F.col("visitor")).alias("own"), F.count_if("visitor").alias("visitors"))
        return counts.withColumn("pairs", F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("visitors"))

    def _streamed(self, answer, ddl: str) -> DataFrame:
        """``answer(own keys, own units)`` gives a function of each batch: keys, units, whether they are the cell's own."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held, tell = None, [], None
            for batch in batches:
                cells, visitor, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                rows = units(matrix_of(batch.column(3), dim))
                edges = np.flatnonzero(np.diff(cells) | np.diff(visitor.astype(np.int8))) + 1
                for low, high in zip([0, *edges], [*edges, len(cells)]):
                    if low == high:
                        continue
                    if cells[low] != cell:
                        if held:
                            yield from alone(held)
                        cell, held, tell = cells[low], [], None
                    if not visitor[low]:
                        held.append((keys[low:high], rows[low:high]))
                        continue
                    if tell is None and not held:  # a part without rows of its own
                        continue
                    if tell is None:
                        tell = answer(*(np.concatenate([h[n] for h in held]) for n in (0, 1)))
                        yield from tell(None, None)
                        held = []
                    for k in range(low, high, 1024):
                        yield from tell(keys[k : min(k + 1024, high)], rows[k : min(k + 1024, high)])
            if held:
                yield from alone(held)

        def alone(held: list) -> Iterator[pa.RecordBatch]:
            return answer(*(np.concatenate([h[n] for h in held]) for n in (0, 1)))(None, None)

        ordered = self.dealt.repartition("cell").sortWithinPartitions("cell", "visitor")
        return ordered.mapInArrow(run, ddl)

    def pairs(self) -> DataFrame:
        kind, minimum, keyed = self.kind, self.minimum, self.keyed

        def answer(own: np.ndarray, sides: np.ndarray):
            def tell(keys, others):
                if keys is None:
                    found = []
                    for k in range(0, len(own), 1024):
                        sim = sides[k : k + 1024] @ sides.T
                        i, j = np.nonzero(sim >= minimum)
                        up = i + k < j
                        found.append((own[i[up] + k], own[j[up]], sim[i[up], j[up]]))
                    a, b, s = (np.concatenate([f[n] for f in found]) for n in range(3))
                else:
                    sim = others @ sides.T
                    i, j = np.nonzero(sim >= minimum)
                    a, b, s = keys[i], own[j], sim[i, j]
                if len(a):
                    swap = a > b
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a).tolist(), keyed), pa.array(np.where(swap, a, b).tolist(), keyed), pa.array(s)], names=["a", "b", "similarity"])

            return tell

        return self._streamed(answer, f"a {kind}, b {kind}, similarity double")

    def links(self) -> DataFrame:
        kind, minimum, keyed = self.kind, self.minimum, self.keyed

        def answer(own: np.ndarray, sides: np.ndarray):
            label = np.arange(len(own))

            def top(x: np.ndarray) -> np.ndarray:
                while (label[x] != x).any():
                    x = label[x]
                return x

            def joined(rows: np.ndarray) -> list[tuple]:
                """Make the components of some own rows one; the links that say so."""
                tops = np.unique(top(rows))
                label[tops[1:]] = tops[0]
                return [(own[t], own[tops[0]]) for t in tops[1:]]

            def tell(keys, others):
                out: list[tuple] = []
                if keys is None:
                    for k in range(len(own)):
                        near = np.flatnonzero(sides[k:] @ sides[k] >= minimum) + k
                        if len(near) > 1 or (len(near) and near[0] != k):
                            out += joined(np.union1d(near, [k]))
                else:
                    near = others @ sides.T >= minimum
                    for i in np.flatnonzero(near.any(axis=1)):
                        rows = np.flatnonzero(near[i])
                        out += joined(rows)
                        out.append((keys[i], own[top(rows[:1])[0]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], keyed), pa.array([x for _, x in out], keyed)], names=["a", "b"])

            return tell

        return self._streamed(answer, f"a {kind}, b {kind}")


def _lengths(vectors: DataFrame, vec: str) -> list[int]:
    """Lengths of the vectors; a vector only meets those of its own."""
    return sorted(r[0] for r in vectors.select(F.size(vec)).where(F.size(vec) > 0).distinct().collect())


def threshold_cells(vectors: DataFrame, key: str, vec: str, minimum: float, pivots: int | None = None) -> list[Cells]:
    return [Cells(vectors, key, vec, minimum, dim, pivots) for dim in _lengths(vectors, vec)]


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    for f in frames:
        empty = empty.union(f)
    return empty


def threshold_pairs(vectors: DataFrame, key: str, vec: str, minimum: float, pivots: int | None = None) -> DataFrame:
    """``a, b, similarity`` of all pairs a < b with cosine >= ``minimum``: the exact self join; see ``Cells``.

    Vectors that are null, empty or not finite have no pair, a zero vector has
    cosine 0 with all. Keys are unique.
    """
    kind = dict(vectors.dtypes)[key]
    return _union([c.pairs() for c in threshold_cells(vectors, key, vec, minimum, pivots)], vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double"))


def threshold_links(vectors: DataFrame, key: str, vec: str, minimum: float, pivots: int | None = None) -> DataFrame:
    """``a, b``: links that connect what pairs with cosine >= ``minimum`` connect.

    The cells of ``threshold_pairs``, but of each cell only what joins its
    components: at most one row for each row it holds and each that passes by.
    Where a row would visit more cells than there are blocks in a grid, all pairs
    of blocks are compared instead (``Cells.pruned``), unless ``pivots`` are given.
    Of equal vectors one takes part, the others are linked to it.
    """
    kind, rows = dict(vectors.dtypes)[key], vectors.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).where(F.size(vec) > 0)
    distinct = materialize(rows.groupBy("v").agg(F.min("k").alias("k"), F.count("*").alias("n")), "distinct")
    links = [c.links() if pivots or c.pruned() else c.grid() for c in threshold_cells(distinct.select("k", "v"), "k", "v", minimum, pivots)]
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    some = F.exists("v", lambda x: x != 0) if minimum > 0 else F.lit(True)
    repeats = rows.join(distinct.where("n > 1").where(finite & some).select(F.col("v").alias("w"), F.col("k").alias("first")), F.col("v") == F.col("w")).where("k <> first").select(F.col("k").alias("a"), F.col("first").alias("b"))
    return _union([*links, repeats], vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}"))


def threshold_pairs_lsh(vectors: DataFrame, key: str, vec: str, minimum: float, bucket_length: float = 1.0, tables: int = 8, seed: int = 42) -> DataFrame:
    """``a, b, similarity``: the approximate self join by bucketed random projections, for data where pivots prune little.

    On unit vectors cosine >= c is a distance up to sqrt(2 - 2c). Each found pair
    is exact; a pair that shares no bucket of any table is missed. More tables or
    longer buckets find more and compare more.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).where((F.size("v") > 0) & (l2_norm(F.col("v")) > 0))
    rows = materialize(rows.select("k", unit(F.col("v")).alias("v")), "units").select("k", array_to_vector("v").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="buckets", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(rows)
    near = model.approxSimilarityJoin(rows, rows, math.sqrt(max(0.0, 2 - 2 * minimum)) + 1e-9, "distance").where("datasetA.k < datasetB.k")
    return near.select(F.col("datasetA.k").alias("a"), F.col("datasetB.k").alias("b"), (1 - F.col("distance") ** 2 / 2).alias("similarity")).where(F.col("similarity") >= minimum - 1e-12)
