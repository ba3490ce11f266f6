"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.sources.scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def component_stars(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(vertex, component)`` of every vertex with an edge; component = its smallest member.

    ``edges``: two columns of one orderable type. Loops, nulls and repeats are
    ignored. Each round is one large-star and one small-star step and is written
    to the shared folder; rounds grow with the logarithm of the longest path.
    Only a row count and a hash sum reach the driver.
    """
    x, y = edges.columns[:2]
    edges = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        edges = materialize(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = edges.select(F.col("b").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(own)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(vertex, component)`` of every vertex; one without edges is its own component."""
    vertex = vertices.select(F.col(vertices.columns[0]).alias("vertex")).distinct()
    return vertex.join(component_stars(edges), "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
