"""Labels: routes, names, zero-shot scores, advice, human feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.operators.vectors import dot
from photarium.sources.scratch import bounded

# Fixed values.
TYPE_LABELS = {"character": "角色", "person": "人物"}
GENERIC = "兽装人物"
TAGS = {
    "兽装人物": ["Furry", "兽装"], "普通人物": ["人物", "肖像"], "真实动物": ["动物"], "插画/绘画": ["插画", "绘画"], "风景/物品": ["风景", "物品"],
    "狼兽装": ["狼", "Furry", "兽装"], "狐狸兽装": ["狐狸", "Furry", "兽装"], "犬兽装": ["犬", "Furry", "兽装"], "猫兽装": ["猫", "Furry", "兽装"], "虎兽装": ["虎", "Furry", "兽装"],
    "豹兽装": ["豹", "Furry", "兽装"], "熊兽装": ["熊", "Furry", "兽装"], "兔兽装": ["兔", "Furry", "兽装"], "龙兽装": ["龙", "Furry", "兽装"], "其他兽装": ["Furry", "兽装"],
}

# The labels of the three layers and how they are shown.
LABELS = {
    "a person wearing a fursuit or furry animal costume": "🦁 兽装人物",
    "a normal person in casual clothing": "👤 普通人物",
    "a real animal": "🐾 真实动物",
    "a digital illustration or cartoon artwork": "🎨 插画/绘画",
    "a landscape, building, or still object": "🏞 风景/物品",
    "wolf fursuit": "🐺 狼兽装",
    "fox fursuit": "🦊 狐狸兽装",
    "dog fursuit": "🐶 犬兽装",
    "cat fursuit": "🐱 猫兽装",
    "tiger fursuit": "🐯 虎兽装",
    "leopard fursuit": "🐆 豹兽装",
    "bear fursuit": "🐻 熊兽装",
    "rabbit fursuit": "🐰 兔兽装",
    "dragon fursuit": "🐉 龙兽装",
    "other species fursuit": "🐾 其他兽装",
    "a close-up headshot portrait": "📷 大头照",
    "a half-body portrait": "📷 半身照",
    "a full-body standing photo": "📷 全身照",
    "a group photo with multiple people": "👥 多人合照",
    "a stage or convention performance photo": "🎪 舞台/展会",
    "a selfie photo": "🤳 自拍",
    "an indoor photo": "🏠 室内",
    "an outdoor photo": "🌳 室外",
}


def shown_label(category: Column) -> Column:
    """How a label is shown, sign and name; one that is not known is shown as it is."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[category], category)


def label_name(category: Column) -> Column:
    """The shown name without its sign: what a person picks and what tags hang on."""
    return strip_emoji(shown_label(category))


def human_categories(spark) -> DataFrame:
    """``position, category``: the names a person may pick, in the order of the labels, each once."""
    names = list(dict.fromkeys(x.split(" ", 1)[1] for x in LABELS.values()))
    return spark.createDataFrame(list(enumerate(names)), "position int, category string")


def route(category: Column, label: Column) -> Column:
    """person, fursuit or null; person wins."""
    return F.when(F.lower(category).contains("normal person") | label.contains("普通人物"), "person").when(F.lower(category).contains("fursuit") | label.contains("兽装"), "fursuit")


def display_name(name: Column, kind: Column, serial: Column, count: Column | None = None) -> Column:
    """The name, else 未命名 with the type label and three-digit serial."""
    label = F.create_map(*(F.lit(x) for kv in TYPE_LABELS.items() for x in kv))[kind]
    label = F.coalesce(label, F.lit("角色"))
    base = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.when(serial.isNotNull(), F.concat(F.lit("未命名"), label, F.lit(" #"), F.lpad(serial.cast("string"), 3, "0"))).otherwise(F.concat(F.lit("未命名"), label)))
    return base if count is None else F.concat(base, F.lit(" · "), count.cast("string"), F.lit(" 张照片"))


def source_text(types: Column) -> Column:
    """Names of a group's embedding types, joined."""
    names = F.create_map(*(F.lit(x) for x in ("primary", "角色特征", "face", "人脸特征", "legacy", "旧特征")))
    return F.array_join(F.array_sort(F.transform(types, lambda t: F.coalesce(names[t], t))), " + ")


def strip_emoji(text: Column) -> Column:
    """Drops a leading run of non-ASCII characters that a blank ends."""
    return F.regexp_replace(text, "^[^\\x00-\\x7F]* ", "")


def zero_shot(vectors: DataFrame, label_vectors: DataFrame, key: str = "key", scale: float = 5.0) -> DataFrame:
    """``key, label, position, p``: sigmoid(scale * cos), normalised over labels, rounded to 4.

    ``label_vectors``: label, position, vector; a handful of rows.
    """
    labels = bounded(label_vectors, 1000)
    s = vectors.select(key, F.col("vector").alias("v")).crossJoin(labels).select(key, "label", "position", (1 / (1 + F.exp(-scale * dot(F.col("v"), F.col("vector"))))).alias("s"))
    total = F.sum("s").over(Window.partitionBy(key))
    return s.withColumn("p", F.round(F.col("s") / total, 4)).select(key, "label", "position", "p")


def top_label(scores: DataFrame, key: str = "key") -> DataFrame:
    """``key, category, confidence, gap, scores``: argmax (first of equals) and distance to the second."""
    packed = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("np"), "position", "label"))).alias("s"))
    gap = F.when(F.size("s") > 1, F.get("s", F.lit(1))["np"] - F.get("s", F.lit(0))["np"]).otherwise(1.0)
    return packed.select(key, F.get("s", F.lit(0))["label"].alias("category"), (-F.get("s", F.lit(0))["np"]).alias("confidence"), F.round(gap, 4).alias("gap"), F.map_from_entries(F.transform("s", lambda x: F.struct(x["label"], -x["np"]))).alias("scores"))


def hierarchical(layer1: DataFrame, layer2: DataFrame, gate: str, key: str = "key") -> DataFrame:
    """Final label: layer 2 where layer 1 is the gated label, else layer 1."""
    second = layer2.select(key, F.col("category").alias("category2"), F.col("confidence").alias("confidence2"), F.col("gap").alias("gap2"))
    gated = F.col("category") == gate
    return layer1.join(second, key, "left").select(
        key, F.col("category").alias("layer1"), F.when(gated, F.col("category2")).alias("layer2"), F.when(gated, F.coalesce("category2", "category")).otherwise(F.col("category")).alias("final"),
        F.when(gated, F.coalesce("confidence2", "confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(gated, F.col("gap2")).alias("gap2"),
    )


def uncertain(confidence: Column, gap: Column) -> Column:
    return (confidence < 0.40) | (gap < 0.08)


def better_of(first: Column, second: Column) -> Column:
    """A retried result (struct with confidence) only if it is more confident."""
    return F.when(second.isNotNull() & (second["confidence"] > first["confidence"]), second).otherwise(first)


def detection_filter(rows: DataFrame, classes: list[str], threshold: float) -> DataFrame:
    return rows.where(F.col("label").isin(classes) & (F.col("confidence") >= threshold)).orderBy(F.desc("confidence"))


def append_feedback(feedback: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """The log with ``new`` records behind it; they come in their own ``order`` and are numbered on from the last."""
    last = feedback.agg(F.coalesce(F.max(order), F.lit(-1)).alias("last_"))  # one row
    numbered = new.crossJoin(F.broadcast(last)).withColumn(order, F.col("last_") + 1 + F.col(order)).drop("last_")
    return feedback.unionByName(numbered, allowMissingColumns=True)


#: Names of the two group types, and the words of the categories' texts.
CATEGORY_TEXT = {"character": "角色", "person": "人物"}


def category_text(categories: Column) -> Column:
    """Distinct category names of a group's members, in order, joined."""
    names = F.create_map(*(F.lit(x) for kv in CATEGORY_TEXT.items() for x in kv))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(categories, lambda c: c.isNotNull()), lambda c: F.coalesce(names[c], c)))), "、")


def latest_feedback(feedback: DataFrame, key: str = "doc_id", order: str = "seq", value: str = "human_category") -> DataFrame:
    return feedback.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def feedback_for_assets(assets: DataFrame, feedback: DataFrame) -> DataFrame:
    """``path, human_category``: the last record whose path is the asset's or whose rel_path ends it.

    Suffix matches meet on the file name, so the join stays an equi join.
    """
    file = lambda c: F.element_at(F.split(c, "/"), -1)
    a = assets.select("path")
    f = feedback.select(F.regexp_replace("image_path", r"\\", "/").alias("fp"), F.regexp_replace(F.coalesce("rel_path", F.lit("")), r"\\", "/").alias("rel"), "human_category", "seq")
    exact = a.join(f, a["path"] == f["fp"]).select("path", "human_category", "seq")
    by_name = a.withColumn("file", file(F.col("path"))).join(f.where("rel <> ''").withColumn("file", file(F.col("rel"))), "file").where(F.expr("endswith(path, rel)")).select("path", "human_category", "seq")
    return exact.union(by_name).groupBy("path").agg(F.max_by("human_category", "seq").alias("human_category"))


def stars(quality: Column) -> Column:
    out = F.lit("★☆☆☆☆")
    for least, text in ((30, "★★☆☆☆"), (50, "★★★☆☆"), (70, "★★★★☆"), (90, "★★★★★")):
        out = F.when(quality >= least, text).otherwise(out)
    return out


def advise(analysis: DataFrame, feedback: DataFrame, tags: dict[str, list[str]] | None = None, species: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """``key, category, detection, suggestion, tags, stars``.

    ``analysis``: key, category, label, quality (percent), scores (map, may be
    null). The latest human label wins. A species label whose two best species
    scores are closer than 0.05 falls back to the generic label. Quality below
    60 asks for confirmation.
    """
    tags = TAGS if tags is None else tags
    human = latest_feedback(feedback, key).select(key, F.col("human_category").alias("human"))
    rows = analysis.join(human, key, "left").withColumn("clean", strip_emoji(F.col("label")))
    own = F.map_filter("scores", lambda k, v: k.isin(species or []))
    ranked = F.sort_array(F.map_values(own), asc=False)
    near = F.coalesce((F.size(ranked) >= 2) & (F.col("scores")[F.col("category")] == F.get(ranked, F.lit(0))) & (F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)) < 0.05), F.lit(False))
    rows = rows.withColumn("corrected", F.when(near, GENERIC).otherwise(F.col("clean")))
    unsure = F.col("human").isNull() & (F.col("quality") < 60)
    category = F.coalesce("human", "corrected")
    detection = (
        F.when(F.col("human").isNotNull(), F.concat(F.lit("根据历史人工标注，这是一张"), "human", F.lit("照片。")))
        .when(unsure, F.lit("AI对此图片判断不够确定。"))
        .when(F.col("corrected") != F.col("clean"), F.concat(F.lit("AI认为这是一张兽装照片，但无法确定具体物种（可能是"), "clean", F.lit("）。")))
        .otherwise(F.concat(F.lit("AI认为这是一张"), "corrected", F.lit("照片。")))
    )
    suggestion = F.when(unsure, F.lit("建议人工确认分类。")).otherwise(F.concat(F.lit("建议归档到【"), category, F.lit("】分类。")))
    table = F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), F.array(*(F.lit(t) for t in v))))) if tags else None
    tag = F.coalesce(table[category], F.array(category)) if tags else F.array(category)
    return rows.select(key, category.alias("category"), detection.alias("detection"), suggestion.alias("suggestion"), tag.alias("tags"), stars(F.col("quality")).alias("stars"))


def overlay_feedback(analysis: DataFrame, feedback: DataFrame, key: str = "doc_id") -> DataFrame:
    """Analysis with ``final_category``: the latest human label, else the machine's."""
    human = latest_feedback(feedback, key).select(key, F.col("human_category").alias("latest_human"))
    return analysis.join(human, key, "left").withColumn("final_category", F.coalesce("latest_human", "category")).drop("latest_human")
