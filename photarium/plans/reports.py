"""Catalogue reports and data health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.operators.dedup import content_key


def category_histogram(analysis: DataFrame, category: str = "category", human: str = "human_category") -> DataFrame:
    """``category, n``: the human label first, most frequent first."""
    return analysis.groupBy(F.coalesce(human, category).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def overview(analysis: DataFrame, assets: DataFrame, groups: DataFrame, feedback: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: assets, analysed (catalogue assets with a result), mean quality, groups by type, feedback records."""
    live = analysis.join(assets.select(key), key, "left_semi")
    a = live.agg(F.countDistinct(key).alias("analysed"), F.avg(F.when(F.isnan("confidence"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))).alias("mean_quality"), F.count_if(F.col("category") == "character").alias("n_character"), F.count_if(F.col("category") == "person").alias("n_person"), F.count_if(~F.col("category").isin("character", "person")).alias("n_other"))
    g = groups.agg(F.count_if(F.col("type") == "character").alias("character_groups"), F.count_if(F.col("type") == "person").alias("person_groups"))
    return assets.agg(F.countDistinct(key).alias("n_assets")).crossJoin(a).crossJoin(g).crossJoin(feedback.agg(F.count("*").alias("n_feedback")))  # one row each


def pending_summary(incoming: DataFrame, library: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: total, ingested (key known), duplicate (content in the library), new.

    Contents are compared only for rows that share a size with the library.
    """
    state = _pending_state(incoming, library, known, key)
    return state.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "duplicate").alias("duplicate"), F.count_if(F.col("status") == "ingested").alias("ingested"))


def _pending_state(incoming: DataFrame, library: DataFrame, known: DataFrame, key: str) -> DataFrame:
    ingested = incoming.join(known.select(key), key, "left_semi")
    rest = incoming.join(known.select(key), key, "left_anti")
    sized = rest.join(library.select("size").distinct(), "size", "left_semi")
    duplicate = sized.join(library.select("md5").distinct(), "md5", "left_semi").select(key)
    status = lambda df, s: df.select(key, F.lit(s).alias("status"))
    return status(ingested, "ingested").union(status(duplicate, "duplicate")).union(status(rest.join(duplicate, key, "left_anti"), "new"))


def catalogue_statistics(detections: DataFrame, assets: DataFrame, analysis: DataFrame, key: str = "image_path") -> DataFrame:
    """One row; '' is not counted as a group."""
    d = detections.agg(F.count("*").alias("detections"), F.countDistinct(F.when(F.col("group_id") != "", F.col("group_id"))).alias("groups"), F.count_if(F.col("embedding_type") == "face").alias("faces"))
    dup = assets.groupBy(content_key("md5", "doc_id")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_copies"))
    n = assets.agg(F.count("*").alias("assets"))
    a = analysis.join(assets.select("doc_id"), "doc_id", "left").agg(F.countDistinct("doc_id").alias("analysed"))
    return d.crossJoin(n).crossJoin(a).crossJoin(dup).withColumn("unanalysed", F.greatest(F.lit(0), F.col("assets") - F.col("analysed")))  # one row each


def multi_group_assets(detections: DataFrame) -> DataFrame:
    from photarium.operators.identity import asset_group_counts

    return asset_group_counts(detections).where("n_groups > 1")


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


def health_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``key, status, count, detail``: one row per data check.

    ``tables``: detections, assets (image_path, md5), groups and, optionally,
    cache, fingerprints and vectors (each with image_path). A check warns when
    its count is above 0; a vector index that does not exist is fine.
    """
    det, live = tables["detections"], tables["assets"].select("image_path").distinct()
    paths = det.select("image_path").distinct()
    total = paths.agg(F.count("*").alias("total"))
    none = F.lit("")

    def row(name: str, counted: DataFrame, total: DataFrame | None = None, count: Column | None = None) -> DataFrame:
        n = counted.agg((F.count("*") if count is None else count).alias("count"))
        detail = none if total is None else F.concat_ws("/", F.col("count").cast("string"), F.col("total").cast("string"))
        return (n if total is None else n.crossJoin(total)).select(F.lit(name).alias("key"), F.when(F.col("count") > 0, "warn").otherwise("ok").alias("status"), "count", detail.alias("detail"))

    members = det.where("group_id <> ''").select("group_id", "image_path").distinct().join(live.withColumn("live", F.lit(1)), "image_path", "left").groupBy("group_id").agg(F.count("live").alias("n_live"))
    orphan = members.where("n_live = 0").join(tables["groups"].select(F.col("id").alias("group_id")), "group_id", "left_semi")
    out = row("missing_files", paths.join(live, "image_path", "left_anti"), total)
    out = out.union(row("unassigned", det.where("group_id = ''"), det.agg(F.count("*").alias("total"))))
    out = out.union(row("orphan_groups", orphan))
    out = out.union(row("pending", live.join(paths, "image_path", "left_anti"), live.agg(F.count("*").alias("total"))))
    for name in ("cache", "fingerprints"):
        if name in tables:
            out = out.union(row(f"stale_{name}", tables[name].join(live, "image_path", "left_anti"), tables[name].agg(F.count("*").alias("total"))))
    if "vectors" in tables:
        gap = row("index_gap", live.join(tables["vectors"].select("image_path"), "image_path", "left_anti"), live.agg(F.count("*").alias("total")))
        any_vector = tables["vectors"].agg((F.count("*") > 0).alias("built"))
        out = out.union(gap.crossJoin(any_vector).select("key", F.when(F.col("built"), F.col("status")).otherwise("ok").alias("status"), "count", "detail"))
    surplus = tables["assets"].groupBy(content_key("md5", "image_path")).agg(F.count("*").alias("n"))
    return out.union(row("surplus_copies", surplus, count=F.coalesce(F.sum(F.col("n") - 1), F.lit(0))))
