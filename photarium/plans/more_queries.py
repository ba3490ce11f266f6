"""Registered queries of the catalogue's upkeep: caches, curation, indexes and the ingest loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from photarium.functions import labels
from photarium.operators import dedup, identity, quality, vectors
from photarium.plans import ingest, reports, search
from photarium.plans.queries import _FP, _QUALITY, _ZERO, _centroid_sql, _metrics, _zero_shot, fingerprints, query
from photarium.sources import catalog
from photarium.sources.fixtures import table


@query("SELECT doc_id, name FROM assets WHERE backend = 'src3' ORDER BY doc_id LIMIT 20 OFFSET 2", "assets")
def asset_page(spark, d):
    return catalog.list_assets(table(spark, d, "assets"), "src3", 20, 2).select("doc_id", "name")


@query("SELECT backend, count(*) AS n FROM assets GROUP BY 1", "assets")
def backend_counts(spark, d):
    return catalog.backend_counts(table(spark, d, "assets"))


@query("SELECT doc_id FROM assets WHERE backend <> 'src0'", "assets")
def purged_assets(spark, d):
    return catalog.purge(catalog.with_reference(table(spark, d, "assets"), path="name"), "src0", "none").select("doc_id")


@query("""SELECT doc_id, substr(sha256(concat(backend, ':a/', name)), 1, 16) AS photo_id, name AS filename, regexp_extract(name, '\\.([^./]+)$', 1) AS extension,
  CASE WHEN name LIKE '%.jpg' THEN 'jpeg' ELSE 'png' END AS format, true AS supported, concat(backend, '://a/', name) AS uri FROM assets""", "assets")
def asset_references(spark, d):
    rows = table(spark, d, "assets").withColumn("path", F.concat(F.lit("a\\"), "name"))
    return catalog.with_reference(rows).select("doc_id", "photo_id", "filename", "extension", "format", "supported", "uri")


@query("SELECT doc_id, 'new' AS status FROM assets", "assets")
def forced_rescan(spark, d):
    a = table(spark, d, "assets")
    return catalog.classify_changes(a, a, "doc_id", ["size", "mtime"], force=True)


@query("""+ o AS (SELECT doc_id, category, human_category AS override FROM analysis WHERE doc_id % 2 = 0), n AS (SELECT doc_id, concat(category, '2') AS category FROM analysis WHERE doc_id % 3 = 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.category, o.category) AS category, o.override FROM o FULL JOIN n ON o.doc_id = n.doc_id""", "analysis")
def cache_upsert(spark, d):
    """Results replace results; human overrides stay."""
    a = table(spark, d, "analysis").select("doc_id", "category", F.col("human_category").alias("override"))
    return catalog.upsert_keep_override(a.where("doc_id % 2 = 0"), a.where("doc_id % 3 = 0").select("doc_id", F.concat("category", F.lit("2")).alias("category")), "doc_id", "override")


@query("""+ o AS (SELECT doc_id, category, human_category AS override FROM analysis WHERE doc_id % 2 = 0), n AS (SELECT doc_id FROM analysis WHERE doc_id % 5 = 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, category, CASE WHEN n.doc_id IS NOT NULL THEN 'fixed' ELSE override END AS override FROM o FULL JOIN n ON o.doc_id = n.doc_id""", "analysis")
def overrides_set(spark, d):
    a = table(spark, d, "analysis").select("doc_id", "category", F.col("human_category").alias("override"))
    return catalog.set_override(a.where("doc_id % 2 = 0"), a.where("doc_id % 5 = 0").select("doc_id", F.lit("fixed").alias("override")), "doc_id")


@query("""SELECT seq, doc_id, human_category FROM feedback UNION ALL SELECT (SELECT max(seq) FROM feedback) + 1 + doc_id, doc_id, 'fixed' FROM assets WHERE doc_id % 20 = 0""", "feedback", "assets")
def appended_feedback(spark, d):
    old = table(spark, d, "feedback").select("seq", "doc_id", "human_category")
    return labels.append_feedback(old, table(spark, d, "assets").where("doc_id % 20 = 0").select(F.col("doc_id").alias("seq"), "doc_id", F.lit("fixed").alias("human_category")))


@query("SELECT image_path, detection_index, confidence + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS confidence FROM detections WHERE vec_id % 2 = 0 OR vec_id % 3 = 0", "detections")
def upserted_detections(spark, d):
    """A batch that holds a worse copy of each of its rows as well."""
    rows = table(spark, d, "detections").select("vec_id", "image_path", "detection_index", "confidence")
    new = rows.where("vec_id % 3 = 0").drop("vec_id").withColumn("confidence", F.col("confidence") + 1)
    return identity.upsert_detections(rows.where("vec_id % 2 = 0").drop("vec_id"), new.union(new.withColumn("confidence", F.col("confidence") - 0.5)))


@query("""+ b AS (SELECT vec_id, image_path FROM detections WHERE vec_id % 7 <> 0), w AS (SELECT image_path FROM b JOIN (SELECT image_path, count(*) AS n FROM detections GROUP BY 1) USING (image_path) GROUP BY image_path, n HAVING count(*) = n)
SELECT vec_id FROM b WHERE image_path IN (SELECT image_path FROM w)""", "detections")
def complete_assets(spark, d):
    det = table(spark, d, "detections")
    return identity.complete_assets(det.where("vec_id % 7 <> 0"), det.groupBy("image_path").agg(F.count("*").alias("n"))).select("vec_id")


@query("SELECT vec_id FROM detections WHERE image_path NOT IN (SELECT image_path FROM detections WHERE vec_id % 9 = 0)", "detections")
def removed_detections(spark, d):
    det = table(spark, d, "detections")
    return identity.remove_detections(det, det.where("vec_id % 9 = 0").select("image_path")).select("vec_id")


@query("SELECT name, mtime AS created_at FROM assets WHERE (doc_id % 7 = 0 OR doc_id % 10 = 0) AND doc_id % 14 <> 0", "assets")
def favorites_after(spark, d):
    a = table(spark, d, "assets").select("doc_id", "name", F.col("mtime").alias("created_at"))
    more = catalog.add_favorites(table(spark, d, "favorites"), a.where("doc_id % 10 = 0").drop("doc_id"))
    return catalog.remove_favorites(more, a.where("doc_id % 14 = 0"))


@query("SELECT substr(sha256(name), 1, 20) AS job_key, CAST(doc_id AS BIGINT) AS at_ms, backend AS source FROM assets", "assets")
def provenance(spark, d):
    a = table(spark, d, "assets").withColumn("job_key", F.substring(F.sha2("name", 256), 1, 20))
    outputs = a.select(F.concat("job_key", F.lit("_"), F.col("doc_id").cast("string"), F.lit("ms.jpg")).alias("name"))
    return catalog.provenance(outputs, a.select("job_key", F.col("backend").alias("source"))).select("job_key", "at_ms", "source")


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'person' WHEN lang = 'fr' OR doc_id % 7 = 0 THEN 'fursuit' END AS route FROM documents""")
def routes(spark, d):
    category = F.when(F.col("lang") == "en", "a Normal Person photo").when(F.col("lang") == "fr", "Fursuit").otherwise("x")
    label = F.when(F.col("doc_id") % 7 == 0, "兽装人物").otherwise("")
    return table(spark, d, "documents").select("doc_id", labels.route(category, label).alias("route"))


@query("""SELECT image_path, string_agg(DISTINCT CASE embedding_type WHEN 'primary' THEN '角色特征' WHEN 'face' THEN '人脸特征' ELSE '旧特征' END, ' + ' ORDER BY CASE embedding_type WHEN 'primary' THEN '角色特征' WHEN 'face' THEN '人脸特征' ELSE '旧特征' END) AS sources FROM detections GROUP BY 1""", "detections")
def source_texts(spark, d):
    return table(spark, d, "detections").groupBy("image_path").agg(labels.source_text(F.collect_set("embedding_type")).alias("sources"))


@query("""SELECT backend, string_agg(DISTINCT CASE category WHEN 'character' THEN '角色' WHEN 'person' THEN '人物' ELSE category END, '、' ORDER BY CASE category WHEN 'character' THEN '角色' WHEN 'person' THEN '人物' ELSE category END) AS categories FROM assets JOIN analysis USING (doc_id) GROUP BY 1""", "assets", "analysis")
def category_texts(spark, d):
    rows = table(spark, d, "assets").join(table(spark, d, "analysis"), "doc_id")
    return rows.groupBy("backend").agg(labels.category_text(F.collect_set("category")).alias("categories"))


@query(f"""WITH RECURSIVE {_FP},
qp AS (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.bits, y.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS h, list_dot_product(x.hist, y.hist) / sqrt(list_dot_product(x.hist, x.hist) * list_dot_product(y.hist, y.hist)) AS c FROM fp x JOIN fp y ON x.vec_id < y.vec_id),
ql AS (SELECT a, b FROM qp WHERE 0.6 * (1 - h / 64) + 0.3 * c + 0.1 >= 0.75),
qs AS (SELECT a, b FROM ql UNION ALL SELECT b, a FROM ql),
qr AS (SELECT vec_id AS a, vec_id AS b FROM fp UNION SELECT qr.a, qs.b FROM qr JOIN qs ON qr.b = qs.a)
SELECT a AS vertex, min(b) AS component FROM qr GROUP BY a""")
def quality_side_groups(spark, d):
    return dedup.quality_groups(fingerprints(spark, d), "vec_id", 0.75)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND (doc_id * 53) % 100 > (doc_id * 37) % 100 THEN 'retry' ELSE category END AS category FROM analysis""", "analysis")
def retried_labels(spark, d):
    retry = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("retry").alias("category"), ((F.col("doc_id") * 53 % 100).cast("double") / 100).alias("confidence")))
    return table(spark, d, "analysis").select("doc_id", labels.better_of(F.struct("category", "confidence"), retry)["category"].alias("category"))


@query(f"""WITH {_QUALITY}, t AS (SELECT vec_id, concat_ws('；', CASE WHEN sharpness >= 0.6 THEN '清晰度高' WHEN sharpness < 0.3 THEN '清晰度一般' END, CASE WHEN exposure >= 0.7 THEN '曝光良好' WHEN exposure < 0.3 THEN '曝光偏差' END,
  CASE WHEN contrast >= 0.6 THEN '对比度佳' END, CASE WHEN saturation >= 0.5 THEN '色彩饱满' END, CASE WHEN vec_id % 3 > 0 THEN concat('相似组 ', CAST(1 + vec_id % 3 AS STRING), ' 张中最佳') END) AS r FROM qs)
SELECT vec_id, CASE r WHEN '' THEN '综合表现均衡' ELSE r END AS reason FROM t""")
def pick_reasons(spark, d):
    return quality.quality_scores(_metrics(spark, d)).select("vec_id", quality.pick_reason(1 + F.col("vec_id") % 3).alias("reason"))


@query(f"""WITH {_QUALITY} SELECT label, vec_id % 40 AS part, CASE WHEN max(sharpness) - min(sharpness) > 0.12 THEN '清晰度差异（可能有轻微糊片）' WHEN max(exposure) - min(exposure) > 0.15 THEN '曝光差异' ELSE '连拍/构图相似' END AS reason FROM qs GROUP BY 1, 2""")
def group_reasons(spark, d):
    rows = _metrics(spark, d).select("label", (F.col("vec_id") % 40).alias("part"), F.struct("sharpness", "exposure").alias("tech"))
    return rows.groupBy("label", "part").agg(dedup.group_reason().alias("reason"))


@query("SELECT vec_id FROM detections WHERE embedding_type IN ('face', 'primary') AND confidence >= 0.5", "detections")
def kept_detections(spark, d):
    return labels.detection_filter(table(spark, d, "detections").withColumn("label", F.col("embedding_type")), ["face", "primary"], 0.5).select("vec_id")


@query("""+ l AS (SELECT image_path, arg_max(group_id, concat(created_at, ' ', id)) AS group_id FROM detections JOIN groups ON group_id = id GROUP BY 1)
SELECT doc_id, category, human_category, group_id FROM analysis LEFT JOIN l ON image_path = concat('photos/', lpad(CAST(doc_id AS STRING), 6, '0'), '.jpg')""", "analysis", "groups")
def organised(spark, d):
    a = table(spark, d, "analysis")
    paths = a.select("doc_id", F.concat(F.lit("photos/"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".jpg")).alias("image_path"))
    return ingest.organise(a, table(spark, d, "detections"), table(spark, d, "groups"), paths)


@query("""+ s AS (SELECT CASE WHEN md5 IN (SELECT md5 FROM assets WHERE side = 'library') THEN 'library_duplicate' ELSE 'process' END AS status FROM assets WHERE side = 'incoming') SELECT status, count(*) AS n FROM s GROUP BY 1""", "assets")
def ingest_counters(spark, d):
    """The directory form: copies inside the batch are processed too."""
    a = table(spark, d, "assets")
    return reports.status_counts(ingest.batch_plan(a.where("side = 'incoming'"), a.where("side = 'library'"), a.where("false"), in_batch=False))


@query("""+ n AS (SELECT group_id, count(DISTINCT image_path) AS n_assets FROM detections WHERE group_id <> '' GROUP BY 1) SELECT id, n_assets FROM groups JOIN n ON id = group_id WHERE type = 'character' AND contains(lower(name), 'name 0')""", "groups")
def group_list(spark, d):
    view = identity.group_view(table(spark, d, "detections"), table(spark, d, "groups"), ["vec_id"])
    return search.sort_groups(view, "updated_desc", "character", "Name 0").select("id", "n_assets")


@query("SELECT doc_id, size, mtime, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN 'old' ELSE 'new' END AS print FROM assets", "assets")
def refreshed_prints(spark, d):
    a = table(spark, d, "assets").select("doc_id", "size", "mtime")
    old = a.where("doc_id % 2 = 0").withColumn("mtime", F.when(F.col("doc_id") % 4 == 0, F.col("mtime") - 1).otherwise(F.col("mtime"))).withColumn("print", F.lit("old"))
    return dedup.refresh_fingerprints(a, old, lambda rows: rows.withColumn("print", F.lit("new")), "doc_id")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN 0.25 ELSE 0.75 END AS DOUBLE) AS score FROM assets", "assets")
def reused_scores(spark, d):
    """Scores of an older version are made again."""
    a = table(spark, d, "assets").select("doc_id", "size", "mtime")
    old = a.where("doc_id % 2 = 0").withColumns({"version": F.when(F.col("doc_id") % 6 == 0, 1).otherwise(2), "score": F.lit(0.25)})
    return quality.reuse_scores(a, old, lambda rows: rows.withColumn("score", F.lit(0.75)), 2, "doc_id").select("doc_id", "score")


def _coder():
    return lambda text: [float(len(text)), 1.0] if len(text) % 10 else [1.0]


@query("""+ k AS (SELECT DISTINCT md5 FROM assets WHERE doc_id % 2 = 0), f AS (SELECT doc_id, size, row_number() OVER (PARTITION BY md5 ORDER BY doc_id) AS r FROM assets WHERE doc_id % 2 <> 0 AND md5 NOT IN (SELECT md5 FROM k))
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'skipped_existing' WHEN f.doc_id IS NULL OR r > 1 THEN 'skipped_md5' WHEN f.size % 10 = 0 THEN 'failed' ELSE 'new' END AS status FROM assets LEFT JOIN f USING (doc_id)""", "assets")
def index_build(spark, d):
    a = table(spark, d, "assets").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    held = a.where("doc_id % 2 = 0").select("doc_id", "md5", "size", "mtime", F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>").alias("vector"))
    return vectors.index_delta(a, held, _coder, 2, "doc_id", "text")[1]


@query("""SELECT CASE WHEN (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0) < count(*) THEN 'incomplete' ELSE 'ready' END AS state, (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0) AS indexed, count(*) AS total, (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 = 0) AS stale FROM embeddings WHERE vec_id % 5 <> 0""")
def index_state(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return vectors.index_status(e.where("vec_id % 3 <> 0"), e.where("vec_id % 5 <> 0"), 64, key="vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0")
def index_pruned(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.index_prune(vectors.check_model(e.where("vec_id % 3 <> 0").withColumn("model_id", F.lit("m")), "m"), e.where("vec_id % 5 <> 0"), "vec_id").select("vec_id")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT CAST(floor(q.vec_id / 100) AS INT) AS query_id, v.vec_id AS key, max(list_dot_product(q.e, v.e)) AS s FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id % 7 = 0 GROUP BY 1, 2)
SELECT query_id, 'semantic' AS section, rank, CAST(key AS STRING) AS key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, CAST(key AS STRING)) AS rank FROM s) WHERE rank <= 4""")
def semantic_favorites(spark, d):
    """Favourites-only semantic search; words match nothing."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "vec_id", F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 100).cast("int").alias("query_id"), "vector")
    tables = {"groups": table(spark, d, "groups"), "assets": table(spark, d, "assets"), "favorites": e.where("vec_id % 7 = 0").select(F.col("key").alias("name")), "vectors": e.select("key", "vector"), "query_vectors": asked}
    queries = asked.select("query_id", F.lit("no such word").alias("text")).distinct()
    return search.catalog_search(tables, queries, favorite_only=True)


@query("""SELECT id, CASE WHEN id LIKE 'g00%' THEN concat('M ', id) WHEN type = 'person' THEN concat('N ', id) ELSE name END AS name FROM groups""", "groups")
def edited_groups(spark, d):
    g = table(spark, d, "groups")
    edit = lambda rows, word, seq: rows.select("id", F.lit("name").alias("field"), F.concat(F.lit(word), "id").alias("value"), F.lit(seq).alias("seq"))
    return identity.apply_edits(g, edit(g.where("type = 'person'"), "N ", 1).union(edit(g.where("id LIKE 'g00%'"), "M ", 2))).select("id", "name")


@query("SELECT DISTINCT group_id AS id FROM detections WHERE group_id <> '' AND group_id NOT LIKE '%f' AND vec_id % 4 = 1", "detections")
def groups_left(spark, d):
    """Groups of persons are deleted, then groups that lost their last member."""
    g = table(spark, d, "groups")
    det, left = identity.delete_groups(table(spark, d, "detections"), g, g.where("type = 'person'").select("id"))
    return identity.drop_empty_groups(left, det.where("vec_id % 4 = 1")).select("id")


@query("SELECT 'g00p' AS a, id AS b FROM groups WHERE id <> 'g00p' AND type <> 'person'", "groups")
def pruned_decisions(spark, d):
    g = table(spark, d, "groups")
    decided = g.where("id <> 'g00p'").select(F.lit("g00p").alias("a"), F.col("id").alias("b"))
    return identity.prune_decisions(decided, g.where("type = 'person'"))


@query("""+ n AS (SELECT group_id, count(*) AS n FROM detections WHERE group_id <> '' GROUP BY 1), p AS (SELECT id, coalesce(n, 0) > coalesce((SELECT n FROM n WHERE group_id = 'g03p'), 0) AS swap FROM groups LEFT JOIN n ON id = group_id WHERE id <> 'g03p')
SELECT 'g03p' AS a, id AS b, CASE WHEN swap THEN id ELSE 'g03p' END AS target, CASE WHEN swap THEN 'g03p' ELSE id END AS source FROM p""", "groups")
def merge_directions(spark, d):
    g = table(spark, d, "groups")
    counts = identity.group_counts(table(spark, d, "detections")).select("group_id", F.col("n_detections").alias("n"))
    return identity.merge_direction(g.where("id <> 'g03p'").select(F.lit("g03p").alias("a"), F.col("id").alias("b")), counts)


@query("""+ m AS (SELECT md5, min(doc_id) AS a FROM assets GROUP BY 1), v AS (SELECT a, doc_id AS b FROM assets JOIN m USING (md5) WHERE doc_id <> a AND doc_id % 4 <> 0 AND a % 9 <> 0)
SELECT b AS candidate, min(a) AS kept FROM v WHERE b NOT IN (SELECT a FROM v) AND b % 9 <> 0 GROUP BY 1""", "assets")
def pending_cleanup(spark, d):
    a = table(spark, d, "assets")
    first = a.groupBy("md5").agg(F.min("doc_id").alias("a"))
    log = a.join(first, "md5").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    log = log.select(F.lit("resolve").alias("kind"), "a", "b", F.lit(1).alias("at")).union(log.where("b % 4 = 0").select(F.lit("ignore"), "a", "b", F.lit(2)))
    return dedup.pending_cleanup(log, a.where("doc_id % 9 <> 0").select("doc_id"))


@query("SELECT 'analysis' AS name, count(*) AS n FROM analysis WHERE doc_id % 6 <> 0 UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM assets WHERE doc_id % 6 = 0)", "analysis", "feedback", "assets")
def cascade_counts(spark, d):
    left = dedup.cascade_delete(table(spark, d, "assets").where("doc_id % 6 = 0").select("doc_id"), {n: table(spark, d, n) for n in ("analysis", "feedback")}, {"analysis": "doc_id", "feedback": "doc_id"})
    a, b = (left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("analysis", "feedback"))
    return a.union(b)


@query("SELECT id FROM groups WHERE trim(coalesce(name, '')) = ''", "groups")
def unnamed_groups(spark, d):
    return identity.unnamed_groups(table(spark, d, "groups")).select("id")


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'box' WHEN vec_id % 7 = 0 THEN 'confidence' WHEN vec_id % 11 = 0 THEN 'dimension' WHEN vec_id % 3 = 0 THEN 'norm' ELSE 'ok' END AS reason FROM embeddings""")
def validated_detections(spark, d):
    k = F.col("vec_id")
    vector = F.when(k % 11 == 0, F.slice("embedding", 1, 63)).when(k % 3 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))
    box = F.array(F.lit(1), F.lit(1), F.when(k % 5 == 0, 1).otherwise(9), F.lit(9)).cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", box.alias("bbox"), F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("confidence"), vector.alias("embedding"))
    good, bad = identity.validate_detections(rows, 64)
    return good.select("vec_id", F.lit("ok").alias("reason")).union(bad.select("vec_id", "reason"))


@query("SELECT concat('root/', backend, '/', name) AS path, CASE WHEN doc_id % 3 = 0 THEN 'by name' ELSE 'by path' END AS human_category FROM assets WHERE doc_id % 2 = 0 OR doc_id % 3 = 0", "assets")
def feedback_of_assets(spark, d):
    a = table(spark, d, "assets").select("doc_id", F.concat_ws("/", F.lit("root"), "backend", "name").alias("path"), F.concat_ws("\\", "backend", "name").alias("rel"))
    by_path = a.where("doc_id % 2 = 0").select(F.col("path").alias("image_path"), F.lit(None).cast("string").alias("rel_path"), F.lit("by path").alias("human_category"), F.lit(1).alias("seq"))
    by_name = a.where("doc_id % 3 = 0").select(F.lit("elsewhere"), "rel", F.lit("by name"), F.lit(2))
    return labels.feedback_for_assets(a.select("path"), by_path.union(by_name))


@query(f"WITH {_ZERO} SELECT vec_id, category AS layer1, CASE WHEN category = 'L00' THEN concat('S', CAST(vec_id % 4 AS STRING)) END AS layer2, CASE WHEN category = 'L00' THEN concat('S', CAST(vec_id % 4 AS STRING)) ELSE category END AS final, CASE WHEN category = 'L00' THEN 0.5 ELSE confidence END AS confidence FROM z")
def two_layer_labels(spark, d):
    second = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("S"), (F.col("vec_id") % 4).cast("string")).alias("category"), F.lit(0.5).alias("confidence"), F.lit(0.1).alias("gap"))
    return labels.hierarchical(_zero_shot(spark, d), second, "L00", "vec_id").select("vec_id", "layer1", "layer2", "final", "confidence")


_TODO = "md5 NOT IN (SELECT md5 FROM assets WHERE side = 'library')"


@query(f"""+ {_centroid_sql("embedding_type = 'primary' AND group_id <> ''")},
i AS (SELECT doc_id, concat('in/', lpad(CAST(doc_id AS STRING), 8, '0')) AS image_path, md5, lang FROM assets JOIN documents USING (doc_id) WHERE side = 'incoming'),
f AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY image_path) AS r FROM i WHERE {_TODO}),
st AS (SELECT image_path, i.doc_id, CASE WHEN f.doc_id IS NULL THEN 'library_duplicate' WHEN r > 1 THEN 'batch_duplicate' WHEN i.lang = 'en' THEN 'routed_person' WHEN i.lang = 'fr' THEN 'routed_fursuit' ELSE 'no_route' END AS status FROM i LEFT JOIN f USING (image_path)),
pend AS (SELECT image_path, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM st JOIN embeddings ON vec_id = doc_id WHERE status LIKE 'routed%' AND doc_id % 10 <> 0),
sc AS (SELECT image_path, group_id, list_dot_product(e, v) / (n * sqrt(list_dot_product(e, e))) AS c FROM pend, cen),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY c DESC, group_id) AS r FROM sc),
t AS (SELECT a.image_path, CASE WHEN a.c < 0.2 THEN substr(sha256(concat(a.image_path, ':0')), 1, 16) WHEN a.c - b.c < 0.02 THEN '' ELSE a.group_id END AS g FROM (SELECT * FROM rk WHERE r = 1) a LEFT JOIN (SELECT * FROM rk WHERE r = 2) b USING (image_path))
SELECT image_path, status, g AS group_id FROM st LEFT JOIN t USING (image_path)
UNION ALL SELECT image_path, 'rejected', NULL FROM st JOIN embeddings ON vec_id = doc_id WHERE status LIKE 'routed%' AND doc_id % 10 = 0""", "detections", "assets")
def ingest_loop(spark, d):
    """Scan, eliminate, route, detect, validate, upsert and assign one batch; every tenth asset gets an empty box and is rejected."""
    a = table(spark, d, "assets").withColumn("image_path", F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")))
    e = table(spark, d, "embeddings")
    named = table(spark, d, "documents").select(F.concat(F.lit("in/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("image_path"), F.when(F.col("lang") == "en", "normal person").when(F.col("lang") == "fr", "fursuit").alias("category"), F.lit(None).cast("string").alias("label"))

    def detector(rows):
        right = F.when(F.col("doc_id") % 10 == 0, 1).otherwise(9)
        found = F.struct(F.array(F.lit(1), F.lit(1), right, F.lit(9)).cast("array<double>").alias("bbox"), F.lit(0.9).alias("confidence"), F.lit("primary").alias("embedding_type"), F.col("vector").alias("embedding"))
        with_vector = rows.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
        return with_vector.withColumn("found", F.when(F.col("vector").isNotNull(), F.array(found)))

    out, status = ingest.ingest(a.where("side = 'incoming'"), a.where("side = 'library'"), table(spark, d, "detections"), detector, named, 64, thresholds=(("primary", 0.2, 0.02),))
    groups = out.where("image_path LIKE 'in/%'").select("image_path", "group_id")
    return status.join(groups, "image_path", "left").select("image_path", "status", F.when(F.col("status") != "rejected", F.col("group_id")).alias("group_id"))
