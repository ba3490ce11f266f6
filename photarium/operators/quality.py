"""Photo quality: scores from metrics and best of group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TECHNICAL = {"sharpness": 0.35, "exposure": 0.25, "contrast": 0.15, "saturation": 0.10, "edge": 0.15}
AESTHETIC = {"sharpness": 0.40, "exposure": 0.25, "edge": 0.20, "contrast": 0.10, "saturation": 0.05}
TOTAL = {"aesthetic": 0.55, "technical": 0.45}
GROUP_PICK, SINGLE_PICK = 0.50, 0.55


def _weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + w * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return out


def _tidy(x: Column) -> Column:
    """Four decimals; a tie goes up whatever the last bit of the sum is."""
    return F.round(x + 1e-9, 4)


def quality_scores(metrics: DataFrame, model: str | None = None) -> DataFrame:
    """Adds technical, aesthetic and score; ``model`` names an optional column from 0 to 1 blended 0.55 / 0.45."""
    heuristic = _weighted(AESTHETIC)
    aesthetic = heuristic if model is None else F.when(F.col(model).isNotNull(), 0.55 * F.col(model) + 0.45 * heuristic).otherwise(heuristic)
    out = metrics.withColumns({"technical": _tidy(_weighted(TECHNICAL)), "aesthetic": _tidy(aesthetic)})
    return out.withColumn("score", _tidy(_weighted(TOTAL)))


def pick_reason(group_size: Column) -> Column:
    m = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    text = F.concat_ws(
        "；",
        F.when(m("sharpness") >= 0.6, "清晰度高").when(m("sharpness") < 0.3, "清晰度一般"),
        F.when(m("exposure") >= 0.7, "曝光良好").when(m("exposure") < 0.3, "曝光偏差"),
        F.when(m("contrast") >= 0.6, "对比度佳"),
        F.when(m("saturation") >= 0.5, "色彩饱满"),
        F.when(group_size > 1, F.concat(F.lit("相似组 "), group_size.cast("string"), F.lit(" 张中最佳"))),
    )
    return F.when(text == "", "综合表现均衡").otherwise(text)


def select_best(scores: DataFrame, groups: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """``(picks, groups)``.

    ``scores``: key, score and metrics; ``groups``: group_id, key. Groups with
    two scored members or more show their best by (score, sharpness, smallest
    key), picked from GROUP_PICK on; single assets are picked from SINGLE_PICK
    on; the other members of a group never are.
    """
    best = Window.partitionBy("group_id").orderBy(F.desc("score"), F.desc("sharpness"), key)
    per = Window.partitionBy("group_id")
    grouped = groups.select("group_id", key).join(scores, key).withColumns({"rn": F.row_number().over(best), "group_size": F.count("*").over(per)}).where("group_size > 1")
    info = grouped.groupBy("group_id").agg(F.array_sort(F.collect_list(key)).alias("members"), F.min_by(key, "rn").alias("best"), F.min_by("score", "rn").alias("best_score"))
    winners = grouped.where((F.col("rn") == 1) & (F.col("score") >= GROUP_PICK)).select(key, "score", "group_id", "group_size", pick_reason(F.col("group_size")).alias("reason"))
    singles = scores.join(grouped.select(key), key, "left_anti").where(F.col("score") >= SINGLE_PICK).select(key, "score", F.lit("").alias("group_id"), F.lit(1).cast("long").alias("group_size"), pick_reason(F.lit(1)).alias("reason"))
    return winners.union(singles).orderBy(F.desc("score"), key), info


def reuse_scores(assets: DataFrame, old: DataFrame, compute, version: int, key: str = "path") -> DataFrame:
    """Scores of live assets: kept if key, version, size and mtime agree, else through ``compute``."""
    sig = [key, "version", "size", "mtime"]
    current = assets.withColumn("version", F.lit(version))
    kept = old.join(current.select(*sig), sig, "left_semi")
    return kept.select(*old.columns).unionByName(compute(current.join(kept.select(*sig), sig, "left_anti")), allowMissingColumns=True)
