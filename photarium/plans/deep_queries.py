"""Registered queries at default thresholds, over assets without hashes, and by indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from photarium.functions import labels
from photarium.operators import dedup, identity
from photarium.operators.chunked import ChunkedIndex
from photarium.plans import reports, search
from photarium.plans.queries import _FP, fingerprints, query
from photarium.plans.search_index import SubstringIndex
from photarium.sources import catalog
from photarium.sources.detections import DetectionTable
from photarium.sources.fixtures import table
from photarium.sources.scratch import scratch_path

# Each fourth print again, with 0 to 15 bits in a row turned over.
_NEAR = _FP.replace("fp AS (", "fp0 AS (").replace(",\npr AS", """,
fp AS (SELECT vec_id, hist, c, bits FROM fp0 UNION ALL SELECT vec_id + 1000000, hist, c, list_transform(bits, lambda b, i: CASE WHEN i - 1 >= vec_id % 40 AND i - 1 < vec_id % 40 + vec_id % 16 THEN 1 - b ELSE b END) FROM fp0 WHERE vec_id % 4 = 1),
pr AS""")
_DEFAULT = _NEAR.replace("h <= 18", "h <= 14").replace("score >= 0.55", "score >= 0.86 OR 1 - h / 64 >= 0.90")


def near_prints(spark, d):
    fp = fingerprints(spark, d)
    turned = F.expr("shiftleft(shiftleft(1L, CAST(vec_id % 16 AS INT)) - 1, CAST(vec_id % 40 AS INT))")
    copies = fp.where("vec_id % 4 = 1").withColumn("dhash", F.col("dhash").bitwiseXOR(turned)).withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return fp.union(copies)


@query(f"""WITH RECURSIVE {_DEFAULT},
mem AS (SELECT group_id, vec_id, count(*) OVER (PARTITION BY group_id) AS group_size, row_number() OVER (PARTITION BY group_id ORDER BY vec_id) AS rn FROM cc),
sh AS (SELECT * FROM mem WHERE rn <= 8),
gs AS (SELECT x.group_id, avg(score) AS score FROM ok JOIN sh x ON ok.a = x.vec_id JOIN sh y ON ok.b = y.vec_id GROUP BY 1)
SELECT sh.group_id, vec_id, group_size, round(coalesce(score, 0), 4) AS score FROM sh LEFT JOIN gs USING (group_id)""")
def near_duplicates_default(spark, d):
    """At the default thresholds, with planted near prints."""
    return dedup.near_duplicate_groups(near_prints(spark, d), "vec_id").withColumn("score", F.round("score", 4))


@query(f"""WITH RECURSIVE {_NEAR},
qp AS (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.bits, y.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS h, list_dot_product(x.hist, y.hist) / sqrt(list_dot_product(x.hist, x.hist) * list_dot_product(y.hist, y.hist)) AS s FROM fp x JOIN fp y ON x.vec_id < y.vec_id),
ql AS (SELECT a, b FROM qp WHERE h <= 21 AND 0.6 * (1 - h / 64) + 0.3 * s + 0.1 >= 0.80),
qs AS (SELECT a, b FROM ql UNION ALL SELECT b, a FROM ql),
qr AS (SELECT vec_id AS a, vec_id AS b FROM fp UNION SELECT qr.a, qs.b FROM qr JOIN qs ON qr.b = qs.a)
SELECT a AS vertex, min(b) AS component FROM qr GROUP BY a""")
def quality_groups_default(spark, d):
    return dedup.quality_groups(near_prints(spark, d), "vec_id")


# Assets of which some could not be read, so they have no hash.
_UNREAD = "u AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 1 THEN NULL ELSE md5 END AS md5), coalesce('md5:' || CASE WHEN doc_id % 3 = 1 THEN NULL ELSE md5 END, 'key:' || doc_id) AS content FROM assets)"


def _unread(spark, d):
    return table(spark, d, "assets").withColumn("md5", F.when(F.col("doc_id") % 3 != 1, F.col("md5")))


@query(f"+ {_UNREAD} SELECT min(doc_id) AS doc_id FROM u GROUP BY content", "assets")
def first_per_hash_unread(spark, d):
    return dedup.first_per_hash(_unread(spark, d)).select("doc_id")


@query(f"""+ {_UNREAD}, k AS (SELECT doc_id FROM u WHERE doc_id % 17 = 0), g AS (SELECT content, count(*) AS n FROM u GROUP BY 1),
s AS (SELECT u.doc_id, n, count(*) OVER (PARTITION BY content) AS ns, row_number() OVER (PARTITION BY content ORDER BY size DESC, u.doc_id) AS rn FROM u JOIN g USING (content) WHERE doc_id % 7 <> 2),
x AS (SELECT s.doc_id, CASE WHEN k.doc_id IS NOT NULL THEN 'kept' WHEN n < 2 THEN 'no copy' WHEN ns = n AND rn = 1 THEN 'last copy' ELSE 'duplicate' END AS reason FROM s LEFT JOIN k USING (doc_id))
SELECT doc_id, CASE reason WHEN 'duplicate' THEN 'delete' ELSE 'keep' END AS action, reason FROM x""", "assets")
def cleanup_plan_unread(spark, d):
    a = _unread(spark, d)
    return dedup.cleanup_plan(a.where("doc_id % 7 <> 2"), a.select("doc_id", "md5", "size"), a.where("doc_id % 17 = 0"), "doc_id")


@query(f"""+ {_UNREAD}, ex AS (SELECT DISTINCT md5 FROM u WHERE side = 'library' AND md5 IS NOT NULL),
x AS (SELECT doc_id, md5, content, concat('img', CAST(doc_id % 9 AS STRING), '.jpg') AS name FROM u WHERE side = 'incoming'),
f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id) AS r FROM x WHERE md5 IS NULL OR md5 NOT IN (SELECT md5 FROM ex)),
c AS (SELECT f.doc_id, name, coalesce(human_category, category) AS category FROM f JOIN analysis USING (doc_id) WHERE r = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY doc_id) - 1 AS k FROM c)
SELECT doc_id, concat('archive/', category, '/', CASE WHEN k = 0 THEN name ELSE concat(regexp_replace(name, '\\.jpg$', ''), '_', CAST(k AS STRING), '.jpg') END) AS dest, 'copy' AS status FROM n
UNION ALL SELECT doc_id, NULL, 'duplicate' FROM x WHERE doc_id NOT IN (SELECT doc_id FROM c)""", "assets", "analysis")
def archive_plan_unread(spark, d):
    a, an = _unread(spark, d), table(spark, d, "analysis")
    incoming = a.where("side = 'incoming'").withColumn("name", F.concat(F.lit("img"), (F.col("doc_id") % 9).cast("string"), F.lit(".jpg")))
    return catalog.archive_plan(incoming, an.select("doc_id", F.coalesce("human_category", "category").alias("category")), a.where("side = 'library'"), "archive")


@query(f"""+ {_UNREAD} SELECT (SELECT count(*) FROM u) - (SELECT count(DISTINCT content) FROM u) AS surplus_copies, (SELECT count(*) FROM u) AS assets""", "assets")
def surplus_copies_unread(spark, d):
    found = reports.catalogue_statistics(table(spark, d, "detections"), _unread(spark, d), table(spark, d, "analysis"))
    return found.select("surplus_copies", "assets")


# Words of one to six characters out of the names themselves, some of no name, some empty.
_WORDS = """q AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 350 = 0 THEN '' WHEN doc_id % 400 = 100 THEN 'zzz' ELSE upper(substr(name, CAST(1 + doc_id // 50 % 7 AS INT), CAST(1 + doc_id // 50 % 6 AS INT))) END AS text FROM assets WHERE doc_id % 50 = 0)"""


def _words(spark, d):
    a = table(spark, d, "assets").where("doc_id % 50 = 0")
    word = F.upper(F.expr("substr(name, CAST(1 + doc_id DIV 50 % 7 AS INT), CAST(1 + doc_id DIV 50 % 6 AS INT))"))
    return a.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 350 == 0, "").when(F.col("doc_id") % 400 == 100, "zzz").otherwise(word).alias("text"))


@query(f"""+ {_WORDS}, fav AS (SELECT DISTINCT name FROM favorites),
h AS (SELECT query_id, a.name, row_number() OVER (PARTITION BY query_id ORDER BY a.name) AS rank FROM assets a JOIN q ON contains(lower(a.name), lower(trim(text))) WHERE a.name IN (SELECT name FROM fav))
SELECT query_id, rank, name FROM h WHERE rank <= 20""", "assets", "favorites")
def favorite_search(spark, d):
    """Queries from the table itself, favourites only."""
    return search.search_assets(table(spark, d, "assets"), table(spark, d, "favorites"), _words(spark, d), favorite_only=True).select("query_id", "rank", F.col("key").alias("name"))


@query(f"""+ {_WORDS}, h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY name, doc_id) AS rank FROM assets a JOIN q ON contains(lower(name), lower(trim(text))))
SELECT query_id, rank, doc_id FROM h WHERE rank <= 20""", "assets")
def substring_search(spark, d):
    index = SubstringIndex.build(table(spark, d, "assets").select("doc_id", "name"), "name", ["name", "doc_id"])
    return index.search(_words(spark, d), 20, broad=50).select("query_id", "rank", "doc_id")


@query("""+ s AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS serial FROM groups),
h AS (SELECT id, created_at, lower(concat(name, ' ', CASE WHEN trim(name) <> '' THEN trim(name) ELSE concat('未命名', CASE type WHEN 'person' THEN '人物' ELSE '角色' END, ' #', lpad(CAST(serial AS STRING), 3, '0')) END, ' ', id, ' ', CASE type WHEN 'person' THEN '人物 person 真人 face 人' ELSE '角色 character 兽装 fursuit fur 兽' END)) AS hay FROM s),
q AS (SELECT id AS query_id, substr(id, 2, 2) AS text FROM groups UNION ALL SELECT concat('w', w), w FROM (SELECT unnest(['人', '真人', 'FACE ', 'fur', 'fursuit', '兽装', '兽', 'nothing']) AS w)),
g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS rank, id AS key FROM h JOIN q ON contains(hay, lower(trim(text))))
SELECT query_id, rank, key FROM g WHERE rank <= 15""", "groups")
def group_search(spark, d):
    """Ids of the groups themselves, and the words that find a type."""
    groups = table(spark, d, "groups")
    words = spark.createDataFrame([(w,) for w in ("人", "真人", "FACE ", "fur", "fursuit", "兽装", "兽", "nothing")], "w string")
    asked = groups.select(F.col("id").alias("query_id"), F.substring("id", 2, 2).alias("text")).union(words.select(F.concat(F.lit("w"), "w"), "w"))
    return search.search_groups(groups, asked).select("query_id", "rank", "key")


# Each third detection again, its vector moved by up to a quarter of its length, so that some stay within a preset's distance and some don't.
_MOVED = """m AS (SELECT vec_id, embedding_type, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM detections
  UNION ALL SELECT vec_id + 1000000, embedding_type, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + 0.05 * (vec_id % 4) * ((vec_id * i) % 7 - 3) / 2.0) FROM detections WHERE vec_id % 3 = 0)"""


def _moved(spark, d):
    det = table(spark, d, "detections").select("vec_id", "embedding_type", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    turned = F.transform("embedding", lambda x, i: x + 0.05 * (F.col("vec_id") % 4) * ((F.col("vec_id") * (i + 1)) % 7 - 3) / 2.0)
    return det.union(det.where("vec_id % 3 = 0").select(F.col("vec_id") + 1_000_000, "embedding_type", turned))


def _cluster_sql(kind: str, minimum: float) -> str:
    return f"""+ {_MOVED}, v AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM m WHERE embedding_type = '{kind}'),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= {minimum}),
s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
SELECT a AS vertex, min(b) AS component FROM r GROUP BY a"""


@query(_cluster_sql("face", 1 - 0.4), "detections")
def cluster_face(spark, d):
    return identity.cluster_type(_moved(spark, d), "face")


@query(_cluster_sql("legacy", 1 - 0.3), "detections")
def cluster_legacy(spark, d):
    return identity.cluster_type(_moved(spark, d), "legacy")


@query(_cluster_sql("primary", 1 - 0.6481**2 / 2), "detections")
def cluster_primary(spark, d):
    return identity.cluster_type(_moved(spark, d), "primary")


@query("""+ x AS (SELECT vec_id, image_path, detection_index, confidence FROM detections WHERE vec_id % 5 < 3),
y AS (SELECT vec_id + 1000 AS vec_id, image_path, detection_index, 1 - confidence AS confidence FROM detections WHERE vec_id % 4 = 1),
w AS (SELECT image_path FROM (SELECT image_path, count(*) AS n FROM y GROUP BY 1) JOIN (SELECT image_path, count(*) AS m FROM detections WHERE vec_id % 4 = 1 AND vec_id % 7 > 0 GROUP BY 1) USING (image_path) WHERE n = m),
z AS (SELECT * FROM y WHERE image_path IN (SELECT image_path FROM w)),
t AS (SELECT * FROM x WHERE (image_path, detection_index) NOT IN (SELECT (image_path, detection_index) FROM z) UNION ALL SELECT * FROM z)
SELECT vec_id, image_path, detection_index, round(confidence, 4) AS confidence FROM t WHERE image_path NOT IN (SELECT image_path FROM detections WHERE vec_id % 11 = 0)""", "detections")
def detection_table(spark, d):
    """Three commits to one table: a load, a batch of which incomplete assets wait, a removal."""
    det = table(spark, d, "detections").select("vec_id", "image_path", "detection_index", "confidence")
    kept = DetectionTable(spark, scratch_path(spark, "detections"), ", ".join(f"{n} {t}" for n, t in det.dtypes), 16)
    kept.upsert(det.where("vec_id % 5 < 3"))
    new = det.where("vec_id % 4 = 1").withColumns({"vec_id": F.col("vec_id") + 1000, "confidence": 1 - F.col("confidence")})
    kept.upsert(new, det.where("vec_id % 4 = 1 AND vec_id % 7 > 0").groupBy("image_path").agg(F.count("*").alias("n")))
    kept.remove(det.where("vec_id % 11 = 0").select("image_path").distinct())
    return kept.read().withColumn("confidence", F.round("confidence", 4))


@query("""WITH RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us0 FROM events),
x AS (SELECT user_id, event_id, (us - us0) / 1000000.0 AS second, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM t),
r AS (SELECT user_id, event_id, second, i, 0 AS sample_no, 1 AS next, true AS taken FROM x WHERE i = 1
  UNION ALL SELECT x.user_id, x.event_id, x.second, x.i, r.next, r.next + CASE WHEN x.second + 1800 >= r.next * 259200 THEN 1 ELSE 0 END, x.second + 1800 >= r.next * 259200 FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1)
SELECT user_id, event_id, CAST(sample_no AS BIGINT) AS sample_no, CAST(round(second * 1000) AS BIGINT) AS at_ms FROM r WHERE taken""")
def ordered_samples(spark, d):
    """A sample each three days of a user's events, half an hour of tolerance."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.groupBy("user_id").agg(F.min("us").alias("us0"))
    series = e.join(first, "user_id").select("user_id", "event_id", ((F.col("us") - F.col("us0")) / 1e6).alias("second"))
    return catalog.ordered_sample(series, "user_id", "second", 259_200, 1800, ["event_id"]).select("user_id", "event_id", "sample_no", "at_ms")


def _coder():
    return lambda text: [float(len(text)), 1.0] if len(text) % 10 else [1.0]


@query("""+ h AS (SELECT DISTINCT md5 FROM assets WHERE doc_id % 2 = 0 AND size % 10 <> 0),
a AS (SELECT doc_id, md5, size, doc_id % 2 = 0 AND size % 10 <> 0 AND doc_id = min(doc_id) FILTER (doc_id % 2 = 0) OVER (PARTITION BY md5) AS held FROM assets),
f AS (SELECT doc_id, row_number() OVER (PARTITION BY md5 ORDER BY doc_id) AS r FROM a WHERE md5 NOT IN (SELECT md5 FROM h))
SELECT doc_id, CASE WHEN held THEN 'skipped_existing' WHEN f.doc_id IS NULL OR r > 1 THEN 'skipped_md5' WHEN size % 10 = 0 THEN 'failed' ELSE 'new' END AS status FROM a LEFT JOIN f USING (doc_id)""", "assets")
def chunked_index(spark, d):
    """Half of the assets in one build, all of them in the next, a hundred or so a chunk."""
    a = table(spark, d, "assets").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    index = ChunkedIndex(spark, scratch_path(spark, "index"), "doc_id", "long")
    rows = max(100, a.count() // 5)
    index.build(a.where("doc_id % 2 = 0"), _coder, 2, "text", rows)
    return index.build(a, _coder, 2, "text", rows)


_COVERED = "SELECT id, name, CASE WHEN id IN ('g00p', 'g03p') THEN '' ELSE concat('cover/', id) END AS cover_image FROM groups"


@query(f"""+ c AS ({_COVERED}), m AS (SELECT *, CASE WHEN group_id IN ('g01p', 'g02p') THEN 'g00p' ELSE group_id END AS g FROM detections)
SELECT 'group' AS kind, id, CASE WHEN id = 'g00p' THEN (SELECT arg_min(image_path, vec_id) FROM m WHERE g = 'g00p') ELSE cover_image END AS value FROM c WHERE id NOT IN ('g01p', 'g02p')
UNION ALL SELECT 'undone', id, cover_image FROM c
UNION ALL SELECT 'pair', id, 'g03p' FROM c WHERE id > 'g03p' AND id NOT IN ('g01p', 'g02p')
UNION ALL SELECT 'member', CAST(vec_id AS STRING), g FROM m""", "groups", "detections")
def merge_covers(spark, d):
    """A merge fills the bare target's cover and drops decisions on merged groups; its undoing brings all covers back."""
    det = table(spark, d, "detections")
    groups = table(spark, d, "groups").withColumn("cover_image", F.when(F.col("id").isin("g00p", "g03p"), "").otherwise(F.concat(F.lit("cover/"), "id")))
    told = groups.where("id > 'g03p'").select(F.lit("g03p").alias("a"), F.col("id").alias("b")).union(groups.where("id > 'g01p'").select(F.lit("g01p"), "id"))
    made = identity.merge_with_covers(det, groups, told, "g00p", ["g01p", "g02p"], ["vec_id"])
    back = identity.undo_with_covers(made["detections"], made["groups"], made["log"])[1]
    out = made["groups"].select(F.lit("group").alias("kind"), "id", F.col("cover_image").alias("value")).union(back.select(F.lit("undone"), "id", "cover_image"))
    return out.union(made["pairs"].select(F.lit("pair"), F.col("b"), F.col("a"))).union(made["detections"].select(F.lit("member"), F.col("vec_id").cast("string"), "group_id"))


_NAMED = ", ".join(f"('{en}', '{shown}', '{shown.split(' ', 1)[1]}')" for en, shown in labels.LABELS.items())


@query(f"""+ l(en, shown, cn) AS (VALUES {_NAMED}), a AS (SELECT doc_id, CASE WHEN doc_id % 24 = 23 THEN 'sculpture' ELSE (SELECT list(en) FROM l)[CAST(doc_id % 24 + 1 AS INT)] END AS category FROM assets)
SELECT doc_id, coalesce(shown, category) AS shown, coalesce(cn, category) AS category FROM a LEFT JOIN l ON en = category""", "assets")
def label_names(spark, d):
    all_labels = F.array(*(F.lit(x) for x in labels.LABELS), F.lit("sculpture"))
    rows = table(spark, d, "assets").select("doc_id", F.get(all_labels, (F.col("doc_id") % 24).cast("int")).alias("category"))
    return rows.select("doc_id", labels.shown_label(F.col("category")).alias("shown"), labels.label_name(F.col("category")).alias("category"))


@query("""SELECT name, created_at, row_number() OVER (ORDER BY created_at DESC, name) AS place FROM favorites ORDER BY place LIMIT 50""", "favorites")
def newest_favorites(spark, d):
    rows = catalog.list_favorites(table(spark, d, "favorites"), 50)
    # Fifty rows.
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "name")))
