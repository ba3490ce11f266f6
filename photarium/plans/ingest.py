"""Ingest pipelines: what a batch of incoming assets becomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photarium.functions.labels import route
from photarium.operators.identity import apply_assignment, group_view, incremental_assign, upsert_detections, validate_detections


def batch_plan(incoming: DataFrame, library: DataFrame, known: DataFrame, key: str = "doc_id", in_batch: bool = True) -> DataFrame:
    """``key, status``: known (path), library_duplicate, batch_duplicate (not the first of its content) or process.

    ``in_batch=False`` is the directory form, which drops copies of the library
    only. Rows with no hash are their own content.
    """
    new = incoming.join(known.select(key), key, "left_anti")
    seen = incoming.join(known.select(key), key, "left_semi").select(key, F.lit("known").alias("status"))
    hashes = library.join(new.select("size").distinct(), "size", "left_semi").select("md5").distinct()
    copies = new.join(hashes, "md5", "left_semi").select(key, F.lit("library_duplicate").alias("status"))
    rest = new.join(hashes, "md5", "left_anti")
    content = F.coalesce("md5", F.concat(F.lit("key:"), F.col(key).cast("string")))
    first = F.row_number().over(Window.partitionBy(content).orderBy(key)) == 1 if in_batch else F.lit(True)
    return seen.union(copies).union(rest.withColumn("first", first).select(key, F.when(F.col("first"), "process").otherwise("batch_duplicate")))


def detect(assets: DataFrame, detector: Callable[[DataFrame], DataFrame], dim: int) -> tuple[DataFrame, DataFrame]:
    """``(detections, rejects)``: a detector adds ``found`` (array of structs), one row per element follows."""
    found = detector(assets).select("image_path", F.posexplode("found").alias("detection_index", "d")).select("image_path", "detection_index", "d.*")
    return validate_detections(found, dim)


def ingest(incoming: DataFrame, library: DataFrame, detections: DataFrame, detector: Callable[[DataFrame], DataFrame], labels: DataFrame, dim: int, key: str = "image_path", thresholds: tuple[tuple[str, float, float], ...] = (("primary", 0.79, 0.02), ("face", 0.92, 0.02))) -> tuple[DataFrame, DataFrame]:
    """``(detections, status)`` after one batch.

    Eliminate known paths and contents, route by label, detect, validate, upsert,
    then assign each embedding type against the groups as they stand.
    """
    plan = batch_plan(incoming, library, detections.select(key).distinct(), key)
    todo = incoming.join(plan.where("status = 'process'"), key).drop("status").join(labels, key, "left")
    routed = todo.withColumn("route", route(F.coalesce("category", F.lit("")), F.coalesce("label", F.lit(""))))
    good, bad = detect(routed.where("route IS NOT NULL"), detector, dim)
    table = upsert_detections(detections, good.withColumn("group_id", F.lit("")))
    for kind, threshold, margin in thresholds:
        table = apply_assignment(table, incremental_assign(table, kind, threshold, margin))
    status = plan.where("status <> 'process'").union(routed.select(key, F.coalesce(F.concat(F.lit("routed_"), "route"), F.lit("no_route")))).union(bad.select(key, F.lit("rejected")))
    return table, status


def folder_groups(detections: DataFrame, groups: DataFrame, order: list[str]) -> DataFrame:
    return group_view(detections, groups, order)


def organise(analysis: DataFrame, detections: DataFrame, groups: DataFrame, paths: DataFrame) -> DataFrame:
    """Analysis with the last group (in list order) of each asset; ``paths``: doc_id, image_path."""
    listed = groups.select(F.col("id").alias("group_id"), "created_at")
    last = detections.join(listed, "group_id").groupBy("image_path").agg(F.max_by("group_id", F.struct("created_at", "group_id")).alias("group_id"))
    return analysis.join(paths, "doc_id", "left").join(last, "image_path", "left").select("doc_id", "category", "human_category", "group_id")
