"""Registered queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.functions import labels
from photarium.operators import dedup, identity, quality, vectors
from photarium.plans import ingest, reports, search
from photarium.sources import catalog
from photarium.sources.fixtures import table, view_sql
from photarium.sources.scratch import materialize, scratch_path
from photarium.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    """Registers a query under its function's name; ``views`` go into the WITH clause of ``sql``."""
    def add(f):
        QUERIES[f.__name__] = f
        head = view_sql(*views)
        ORACLES[f.__name__] = (f"WITH RECURSIVE {head}" + (",\n" if sql.lstrip().startswith("+") else "\n") + sql.lstrip().lstrip("+")) if head else sql
        return f

    return add


def _centroid_sql(where: str, name: str = "cen") -> str:
    return f"""{name}p AS (SELECT group_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT group_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM detections WHERE {where}) GROUP BY 1, 2),
{name} AS (SELECT group_id, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS n FROM {name}p GROUP BY 1)"""


def _assign_sql(threshold: float, margin: float) -> str:
    return f"""+ {_centroid_sql("embedding_type = 'primary' AND group_id <> ''")},
pend AS (SELECT image_path, detection_index, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM detections WHERE embedding_type = 'primary' AND group_id = ''),
sc AS (SELECT image_path, detection_index, group_id, list_dot_product(e, v) / (n * sqrt(list_dot_product(e, e))) AS c FROM pend, cen),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_path, detection_index ORDER BY c DESC, group_id) AS r FROM sc),
t AS (SELECT a.image_path, a.detection_index, a.group_id AS g1, a.c AS c1, b.group_id AS g2, b.c AS c2 FROM (SELECT * FROM rk WHERE r = 1) a LEFT JOIN (SELECT * FROM rk WHERE r = 2) b USING (image_path, detection_index)),
d AS (SELECT *, CASE WHEN c1 < {threshold} THEN 'create' WHEN c2 IS NOT NULL AND c1 - c2 < {margin} THEN 'conflict' ELSE 'join' END AS decision FROM t)
SELECT image_path, detection_index, decision, CASE decision WHEN 'join' THEN g1 WHEN 'create' THEN substr(sha256(concat(image_path, ':', CAST(detection_index AS STRING))), 1, 16) ELSE '' END AS group_id,
  g1 AS top_group, round(c1, 4) AS top_cos, g2 AS second_group, round(c2, 4) AS second_cos FROM d"""


@query(_assign_sql(0.79, 0.02), "detections")
def assign_default(spark, d):
    return identity.incremental_assign(table(spark, d, "detections"), "primary")


@query(_assign_sql(0.20, 0.02), "detections")
def assign_relaxed(spark, d):
    return identity.incremental_assign(table(spark, d, "detections"), "primary", 0.20, 0.02)


def _pairs_sql(minimum: float, extra: str = "") -> str:
    return f"""+ {_centroid_sql("embedding_type = 'primary' AND group_id <> ''")}
SELECT x.group_id AS a, y.group_id AS b, round(list_dot_product(x.v, y.v) / (x.n * y.n), 4) AS similarity
FROM cen x, cen y WHERE x.group_id < y.group_id AND list_dot_product(x.v, y.v) / (x.n * y.n) >= {minimum} {extra}"""


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


@query(_pairs_sql(0.10), "detections")
def suspect_pairs(spark, d):
    return _rounded(identity.candidate_pairs(table(spark, d, "detections"), None, 0.10, None), "similarity")


@query(_pairs_sql(0.60), "detections")
def suspect_pairs_default(spark, d):
    return _rounded(identity.candidate_pairs(table(spark, d, "detections"), limit=None), "similarity")


@query(_pairs_sql(0.10, "AND NOT (x.group_id IN ('g00p', 'g01p') OR y.group_id IN ('g00p', 'g01p'))"), "detections")
def not_same_filtered(spark, d):
    """Pairs that touch the first two groups have been told apart by a person."""
    det, groups = table(spark, d, "detections"), table(spark, d, "groups")
    asked = groups.select(F.lit("g00p").alias("a"), F.col("id").alias("b")).union(groups.select(F.lit("g01p"), F.col("id")))
    decided = identity.add_not_same(spark.createDataFrame([], "a string, b string"), groups, asked)
    return _rounded(identity.candidate_pairs(det, decided, 0.10, None), "similarity")


_COMPONENTS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.40),
s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT a AS vertex, min(b) AS component FROM r GROUP BY a")
def dbscan_components(spark, d):
    return identity.dbscan_min1(table(spark, d, "embeddings"), "vec_id", "embedding", 0.60)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS key, list_dot_product(q.e, v.e) AS s FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, key, round(s, 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM s) WHERE rank <= 12""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _rounded(vectors.vector_topk(e, asked, 12, "vec_id", "embedding"), "similarity")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT CAST(floor(q.vec_id / 100) AS BIGINT) AS query_id, v.vec_id AS key, max(list_dot_product(q.e, v.e)) AS s FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id % 3 <> 0 GROUP BY 1, 2)
SELECT query_id, key, round(s, 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM s) WHERE rank <= 20""")
def vector_topk_fused(spark, d):
    """Two variants to a query, maximum over them, dead assets left out first."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 100).alias("asset_query"), F.col("embedding").alias("vector"))
    return _rounded(vectors.vector_topk(e, asked, 20, "vec_id", "embedding", fuse_by="asset_query", exclude_self=False, alive=e.where("vec_id % 3 <> 0").select("vec_id")), "similarity")


def fingerprints(spark, d) -> DataFrame:
    """Stand-in prints from embeddings: sign bits of differences, shares, centred unit vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + F.abs(x))
    mean = F.aggregate("e", F.lit(0.0), lambda s, x: s + x) / F.size("e")
    bits = F.lit(0).cast("long")
    for k in range(64):
        bits = bits.bitwiseOR(F.when(F.col("e")[(k + 1) % 64] > F.col("e")[k], F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k)).otherwise(F.lit(0)))
    rows = e.select("vec_id", bits.alias("dhash"), F.transform("e", lambda x: F.abs(x) / total).alias("hist"), F.transform("e", lambda x: x - mean).alias("c"))
    return rows.select("vec_id", "dhash", "hist", vectors.unit(F.col("c")).alias("gray"))


_FP = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
m AS (SELECT vec_id, e, list_sum(list_transform(e, lambda x: abs(x))) AS t, list_sum(e) / len(e) AS mu FROM v),
fp AS (SELECT vec_id, list_transform(e, lambda x: abs(x) / t) AS hist, list_transform(e, lambda x: x - mu) AS c, list_transform(range(1, 65), lambda i: CASE WHEN e[i % 64 + 1] > e[i] THEN 1 ELSE 0 END) AS bits FROM m),
pr AS (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.bits, y.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS h,
  greatest(0, 1 - list_sum(list_transform(list_zip(x.hist, y.hist), lambda z: abs(z[1] - z[2]))) / 2) AS hs,
  greatest(0, list_dot_product(x.c, y.c) / sqrt(list_dot_product(x.c, x.c) * list_dot_product(y.c, y.c))) AS gs FROM fp x JOIN fp y ON x.vec_id < y.vec_id),
sc AS (SELECT a, b, h, 0.45 * (1 - h / 64) + 0.25 * hs + 0.30 * gs AS score FROM pr WHERE h <= 18),
ok AS (SELECT a, b, score FROM sc WHERE score >= 0.55),
sy AS (SELECT a, b FROM ok UNION ALL SELECT b, a FROM ok),
r AS (SELECT a, a AS b FROM sy UNION SELECT r.a, sy.b FROM r JOIN sy ON r.b = sy.a),
cc AS (SELECT a AS vec_id, min(b) AS group_id FROM r GROUP BY a)"""


@query(f"""WITH RECURSIVE {_FP},
mem AS (SELECT group_id, vec_id, count(*) OVER (PARTITION BY group_id) AS group_size, row_number() OVER (PARTITION BY group_id ORDER BY vec_id) AS rn FROM cc),
sh AS (SELECT * FROM mem WHERE rn <= 8),
gs AS (SELECT x.group_id, avg(score) AS score FROM ok JOIN sh x ON ok.a = x.vec_id JOIN sh y ON ok.b = y.vec_id GROUP BY 1)
SELECT sh.group_id, vec_id, group_size, round(coalesce(score, 0), 4) AS score FROM sh LEFT JOIN gs USING (group_id)""")
def near_duplicates(spark, d):
    return _rounded(dedup.near_duplicate_groups(fingerprints(spark, d), "vec_id", None, 0.55, 1.01, 1 - 18 / 64), "score")


@query(f"""WITH RECURSIVE {_FP}, pq AS (SELECT a AS query, b AS key, 0.45 * (1 - h / 64) + 0.25 * hs + 0.30 * gs AS s FROM pr WHERE a % 50 = 0 UNION ALL SELECT b, a, 0.45 * (1 - h / 64) + 0.25 * hs + 0.30 * gs FROM pr WHERE b % 50 = 0)
SELECT query, key, round(s, 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, key) AS rank FROM pq WHERE s >= 0.45) WHERE rank <= 12""")
def similar_assets(spark, d):
    fp = fingerprints(spark, d)
    return _rounded(dedup.similar_assets(fp, fp.where("vec_id % 50 = 0").select("vec_id"), "vec_id", 12, 0.45), "similarity")


_EXACT = """g AS (SELECT md5, count(*) AS n, sum(size) AS total_bytes, string_agg(CAST(doc_id AS STRING), ',' ORDER BY doc_id) AS members FROM assets GROUP BY md5 HAVING count(*) > 1)"""


@query(f"+ {_EXACT} SELECT md5, n, CAST(total_bytes AS BIGINT) AS total_bytes, members FROM g", "assets")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(table(spark, d, "assets")).withColumn("members", F.array_join("members", ","))


@query(f"+ {_EXACT} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus, count(*) AS groups FROM g", "assets")
def surplus_copies(spark, d):
    return dedup.surplus_copies(dedup.exact_duplicates(table(spark, d, "assets")))


_KNOWN = "doc_id % 11 = 0"


@query(f"""+ s AS (SELECT CASE WHEN {_KNOWN} THEN 'ingested' WHEN md5 IN (SELECT md5 FROM assets WHERE side = 'library') THEN 'duplicate' ELSE 'new' END AS status FROM assets WHERE side = 'incoming')
SELECT count(*) AS total, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'ingested') AS ingested FROM s""", "assets")
def pending_summary(spark, d):
    a = table(spark, d, "assets")
    return reports.pending_summary(a.where("side = 'incoming'"), a.where("side = 'library'"), a.where(_KNOWN))


@query(f"""+ s AS (SELECT doc_id, md5, CASE WHEN {_KNOWN} THEN 'known' WHEN md5 IN (SELECT md5 FROM assets WHERE side = 'library') THEN 'library_duplicate' END AS st FROM assets WHERE side = 'incoming'),
f AS (SELECT doc_id, row_number() OVER (PARTITION BY md5 ORDER BY doc_id) AS r FROM s WHERE st IS NULL)
SELECT doc_id, coalesce(st, CASE WHEN r = 1 THEN 'process' ELSE 'batch_duplicate' END) AS status FROM s LEFT JOIN f USING (doc_id)""", "assets")
def ingest_batch_plan(spark, d):
    a = table(spark, d, "assets")
    return ingest.batch_plan(a.where("side = 'incoming'"), a.where("side = 'library'"), a.where(_KNOWN))


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'gone' WHEN doc_id % 13 = 1 THEN 'new' WHEN doc_id % 13 = 2 THEN 'updated' ELSE 'unchanged' END AS status FROM documents""")
def change_status(spark, d):
    a = table(spark, d, "assets")
    before = a.where("doc_id % 13 <> 1").withColumn("mtime", F.when(F.col("doc_id") % 13 == 2, F.col("mtime") - 60).otherwise(F.col("mtime")))
    return catalog.classify_changes(a.where("doc_id % 13 <> 0"), before, "doc_id", ["size", "mtime"], report_gone=True)


@query("""+ o AS (SELECT group_id, image_path, min(vec_id) AS first FROM detections WHERE group_id <> '' GROUP BY 1, 2),
p AS (SELECT group_id, string_agg(image_path, ',' ORDER BY first) AS paths, count(*) AS n_assets, arg_min(image_path, first) AS cover FROM o GROUP BY 1),
t AS (SELECT group_id, string_agg(DISTINCT embedding_type, ',' ORDER BY embedding_type) AS source_types, count(*) AS n_detections FROM detections WHERE group_id <> '' GROUP BY 1)
SELECT id, name, type, paths, source_types, n_assets, n_detections, cover, created_at FROM groups JOIN p ON id = p.group_id JOIN t ON id = t.group_id""", "groups")
def group_view(spark, d):
    return identity.group_view(table(spark, d, "detections"), table(spark, d, "groups"), ["vec_id"]).withColumns({"paths": F.array_join("paths", ","), "source_types": F.array_join("source_types", ",")})


@query("SELECT group_id, count(DISTINCT image_path) AS n_assets, count(*) AS n_detections FROM detections WHERE group_id <> '' GROUP BY 1", "detections")
def group_counts(spark, d):
    return identity.group_counts(table(spark, d, "detections"))


@query("SELECT image_path, count(DISTINCT group_id) AS n_groups FROM detections WHERE group_id <> '' GROUP BY 1 HAVING count(DISTINCT group_id) > 1", "detections")
def multi_group_assets(spark, d):
    return reports.multi_group_assets(table(spark, d, "detections"))


@query("""+ b AS (SELECT *, row_number() OVER (PARTITION BY image_path, group_id ORDER BY confidence DESC, detection_index) AS rn FROM detections WHERE group_id <> ''),
s AS (SELECT id, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS serial FROM groups)
SELECT image_path, group_id, detection_index, confidence, serial FROM b JOIN s ON group_id = id WHERE rn = 1""", "groups")
def asset_groups_best(spark, d):
    best = identity.best_per_group(table(spark, d, "detections"))
    return best.join(identity.group_serials(table(spark, d, "groups")), F.col("id") == F.col("group_id")).select("image_path", "group_id", "detection_index", "confidence", "serial")


@query("SELECT id, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS serial FROM groups", "groups")
def group_serials(spark, d):
    return identity.group_serials(table(spark, d, "groups"))


@query("""+ s AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS serial FROM groups)
SELECT id, CASE WHEN trim(name) <> '' THEN trim(name) ELSE concat('未命名', CASE type WHEN 'person' THEN '人物' ELSE '角色' END, ' #', lpad(CAST(serial AS STRING), 3, '0')) END AS display FROM s""", "groups")
def display_names(spark, d):
    g = table(spark, d, "groups")
    return g.join(identity.group_serials(g), "id").select("id", labels.display_name(F.col("name"), F.col("type"), F.col("serial")).alias("display"))


@query("""SELECT image_path, group_id, detection_index, confidence FROM (SELECT *, row_number() OVER (PARTITION BY group_id, image_path ORDER BY confidence DESC, detection_index) AS rn FROM detections WHERE group_id <> '') WHERE rn = 1""", "detections")
def best_detection_per_asset(spark, d):
    return identity.best_per_group(table(spark, d, "detections")).select("image_path", "group_id", "detection_index", "confidence")


@query("""SELECT backend, count(DISTINCT coalesce(md5, name)) AS n_unique FROM assets GROUP BY 1""", "assets")
def wall_unique(spark, d):
    return dedup.unique_contents(table(spark, d, "assets"), "backend", "md5", "name")


@query("SELECT md5, min(doc_id) AS doc_id FROM assets GROUP BY 1", "assets")
def first_per_hash(spark, d):
    return dedup.first_per_hash(table(spark, d, "assets")).select("md5", "doc_id")


@query("""SELECT vec_id, CASE WHEN group_id IN ('g01p', 'g02p') THEN 'g00p' ELSE group_id END AS group_id FROM detections""", "detections")
def merge_groups(spark, d):
    return identity.merge_groups(table(spark, d, "detections"), table(spark, d, "groups"), "g00p", ["g01p", "g02p"])[0].select("vec_id", "group_id")


@query("""SELECT vec_id, CASE WHEN group_id IN ('g01p', 'g02p') AND vec_id % 4 = 1 THEN 'g03p' ELSE group_id END AS group_id FROM detections""", "detections")
def undo_merge(spark, d):
    """Merge, move some members on, undo: moved members stay where they are."""
    det, groups = table(spark, d, "detections"), table(spark, d, "groups")
    merged, left, log = identity.merge_groups(det, groups, "g00p", ["g01p", "g02p"])
    was = det.where("group_id IN ('g01p', 'g02p') AND vec_id % 4 = 1").select("vec_id", F.lit("g03p").alias("moved"))
    moved = merged.join(was, "vec_id", "left").withColumn("group_id", F.coalesce("moved", "group_id")).drop("moved")
    return identity.undo_merge(moved, left, log)[0].select("vec_id", "group_id")


@query(f"""+ {_EXACT}, k AS (SELECT doc_id FROM assets WHERE doc_id % 17 = 0),
m AS (SELECT a.doc_id, a.md5, a.size, coalesce(g.n, 1) AS n FROM assets a LEFT JOIN g USING (md5)),
s AS (SELECT m.*, count(*) OVER (PARTITION BY md5) AS ns, row_number() OVER (PARTITION BY md5 ORDER BY size DESC, doc_id) AS rn FROM m WHERE doc_id % 5 <> 2),
x AS (SELECT s.doc_id, CASE WHEN k.doc_id IS NOT NULL THEN 'kept' WHEN n < 2 THEN 'no copy' WHEN ns = n AND rn = 1 THEN 'last copy' ELSE 'duplicate' END AS reason FROM s LEFT JOIN k USING (doc_id))
SELECT doc_id, CASE reason WHEN 'duplicate' THEN 'delete' ELSE 'keep' END AS action, reason FROM x""", "assets")
def keep_cleanup_plan(spark, d):
    a = table(spark, d, "assets")
    return dedup.cleanup_plan(a.where("doc_id % 5 <> 2"), a.select("doc_id", "md5", "size"), a.where("doc_id % 17 = 0"), "doc_id")


_DATE = """CASE WHEN regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), '^\\d{8}([_-]\\d{1,6})?$') THEN concat(substr(name, 1, 4), '-', substr(name, 5, 2), '-', substr(name, 7, 2))
  WHEN regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), '^\\d{13}$') THEN strftime(make_timestamp(CAST(regexp_replace(name, '\\.[^.]*$', '') AS BIGINT) * 1000), '%Y-%m-%d')
  ELSE strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d') END"""


@query(f"SELECT doc_id, {_DATE} AS day FROM assets", "assets")
def asset_dates(spark, d):
    return table(spark, d, "assets").select("doc_id", catalog.asset_date().alias("day"))


_ASKED = [(1, "2024"), (2, "g1"), (3, "人物"), (4, "")]


@query(f"""+ q(query_id, text) AS (VALUES (1, '2024'), (2, 'g1'), (3, '人物'), (4, '')),
s AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id DESC) AS serial FROM groups),
h AS (SELECT id, created_at, lower(concat(name, ' ', CASE WHEN trim(name) <> '' THEN trim(name) ELSE concat('未命名', CASE type WHEN 'person' THEN '人物' ELSE '角色' END, ' #', lpad(CAST(serial AS STRING), 3, '0')) END, ' ', id, ' ', CASE type WHEN 'person' THEN '人物 person 真人 face 人' ELSE '角色 character 兽装 fursuit fur 兽' END)) AS hay FROM s),
g AS (SELECT query_id, 'groups' AS section, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS rank, id AS key FROM h, q WHERE contains(hay, lower(text))),
a AS (SELECT name, {_DATE} AS day, doc_id % 7 = 0 AS fav FROM assets),
p AS (SELECT query_id, 'photos' AS section, row_number() OVER (PARTITION BY query_id ORDER BY name) AS rank, name AS key FROM a, q WHERE contains(lower(name), lower(text)) AND day BETWEEN '2024-01-01' AND '2024-06-30'),
f AS (SELECT query_id, 'favorites' AS section, row_number() OVER (PARTITION BY query_id ORDER BY name) AS rank, name AS key FROM a, q WHERE fav AND contains(lower(name), lower(text)) AND day BETWEEN '2024-01-01' AND '2024-06-30')
SELECT * FROM g WHERE rank <= 15 UNION ALL SELECT * FROM p WHERE rank <= 20 UNION ALL SELECT * FROM f WHERE rank <= 6""", "groups", "assets")
def catalog_search(spark, d):
    tables = {n: table(spark, d, n) for n in ("groups", "assets", "favorites")}
    return search.catalog_search(tables, spark.createDataFrame(_ASKED, "query_id int, text string"), date_from="2024-01-01", date_to="2024-06-30")


@query("SELECT doc_id, arg_max(human_category, seq) AS human_category, max(seq) AS seq FROM feedback GROUP BY 1", "feedback")
def latest_feedback(spark, d):
    return labels.latest_feedback(table(spark, d, "feedback"))


@query("""+ l AS (SELECT doc_id, arg_max(human_category, seq) AS h FROM feedback GROUP BY 1)
SELECT doc_id, coalesce(h, category) AS final_category FROM analysis LEFT JOIN l USING (doc_id)""", "analysis", "feedback")
def feedback_overlay(spark, d):
    return labels.overlay_feedback(table(spark, d, "analysis"), table(spark, d, "feedback")).select("doc_id", "final_category")


def _label_vectors(spark, d) -> DataFrame:
    c = vectors.centroids(table(spark, d, "embeddings"), "label")
    return c.select(F.concat(F.lit("L"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("label"), F.col("label").alias("position"), F.col("centroid").alias("vector"))


_ZERO = """lp AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
lv AS (SELECT label, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS n FROM lp GROUP BY 1),
s AS (SELECT vec_id, lv.label, 1 / (1 + exp(-5.0 * list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), v) / n)) AS s FROM embeddings, lv),
p AS (SELECT vec_id, label, round(s / sum(s) OVER (PARTITION BY vec_id), 4) AS p FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS r FROM p),
z AS (SELECT a.vec_id, concat('L', lpad(CAST(a.label AS STRING), 2, '0')) AS category, a.p AS confidence, round(a.p - b.p, 4) AS gap FROM (SELECT * FROM k WHERE r = 1) a JOIN (SELECT * FROM k WHERE r = 2) b USING (vec_id))"""


def _zero_shot(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    return labels.top_label(labels.zero_shot(v, _label_vectors(spark, d), "vec_id"), "vec_id")


@query(f"WITH {_ZERO} SELECT vec_id, category, confidence, gap FROM z")
def zero_shot_labels(spark, d):
    return _zero_shot(spark, d).select("vec_id", "category", "confidence", "gap")


@query(f"WITH {_ZERO} SELECT vec_id, category AS layer1, CASE WHEN category = 'L00' THEN category END AS layer2, category AS final, confidence FROM z")
def hierarchical_labels(spark, d):
    one = _zero_shot(spark, d)
    return labels.hierarchical(one, one, "L00", "vec_id").select("vec_id", "layer1", "layer2", "final", "confidence")


@query(f"WITH {_ZERO} SELECT vec_id, confidence < 0.40 OR gap < 0.08 AS uncertain FROM z")
def uncertain(spark, d):
    return _zero_shot(spark, d).select("vec_id", labels.uncertain(F.col("confidence"), F.col("gap")).alias("uncertain"))


@query("""+ l AS (SELECT doc_id, arg_max(human_category, seq) AS h FROM feedback GROUP BY 1),
a AS (SELECT doc_id, category, CASE category WHEN 'character' THEN '兽装人物' WHEN 'person' THEN '普通人物' ELSE '其他' END AS cn, confidence * 100 AS q FROM analysis),
b AS (SELECT doc_id, h, q, coalesce(h, cn) AS c FROM a LEFT JOIN l USING (doc_id))
SELECT doc_id, c AS category, CASE WHEN h IS NOT NULL THEN concat('根据历史人工标注，这是一张', h, '照片。') WHEN q < 60 THEN 'AI对此图片判断不够确定。' ELSE concat('AI认为这是一张', c, '照片。') END AS detection,
  CASE WHEN h IS NULL AND q < 60 THEN '建议人工确认分类。' ELSE concat('建议归档到【', c, '】分类。') END AS suggestion,
  CASE c WHEN '兽装人物' THEN 'Furry,兽装' WHEN '普通人物' THEN '人物,肖像' ELSE c END AS tags,
  CASE WHEN q >= 90 THEN '★★★★★' WHEN q >= 70 THEN '★★★★☆' WHEN q >= 50 THEN '★★★☆☆' WHEN q >= 30 THEN '★★☆☆☆' ELSE '★☆☆☆☆' END AS stars FROM b""", "analysis", "feedback")
def advice(spark, d):
    name = F.when(F.col("category") == "character", "🦁 兽装人物").when(F.col("category") == "person", "👤 普通人物").otherwise("其他")
    rows = table(spark, d, "analysis").select("doc_id", "category", name.alias("label"), (F.col("confidence") * 100).alias("quality"), F.lit(None).cast("map<string,double>").alias("scores"))
    return labels.advise(rows, table(spark, d, "feedback")).withColumn("tags", F.array_join("tags", ","))


def _metrics(spark, d) -> DataFrame:
    """Exposure and contrast of the embedding as an 8 x 8 gray tile; the other metrics stand in."""
    px = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + 400 * x.cast("double") + 0.5))))
    rows = table(spark, d, "embeddings").select("vec_id", "label", px.alias("px"))
    mean = F.aggregate("px", F.lit(0.0), lambda s, x: s + x) / F.size("px")
    rows = rows.withColumn("mean", mean)
    std = F.sqrt(F.aggregate("px", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("px"))
    rows = rows.withColumn("std", std)
    clamp = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)
    de, dc = F.abs(F.col("mean") - 118), F.abs(F.col("std") - 55)
    return rows.select(
        "vec_id", "label", clamp(F.when(de <= 70, 1 - de / 90).otherwise(0.25 - (de - 70) / 800)).alias("exposure"), clamp(F.when(dc <= 35, 1 - dc / 45).otherwise(0.25 - (dc - 35) / 600)).alias("contrast"),
        ((F.col("vec_id") * 31 % 100) / 100).alias("sharpness"), ((F.col("vec_id") * 17 % 100) / 100).alias("saturation"), ((F.col("vec_id") * 7 % 100) / 100).alias("edge"),
    )


_QUALITY = """px AS (SELECT vec_id, label, list_transform(embedding, lambda x: greatest(0.0, least(255.0, floor(128 + 400 * CAST(x AS DOUBLE) + 0.5)))) AS p FROM embeddings),
mm AS (SELECT vec_id, label, p, list_sum(p) / len(p) AS mean FROM px),
ms AS (SELECT vec_id, label, mean, sqrt(list_sum(list_transform(p, lambda x: (x - mean) * (x - mean))) / len(p)) AS std FROM mm),
mt AS (SELECT vec_id, label, round(greatest(0.0, least(1.0, CASE WHEN abs(mean - 118) <= 70 THEN 1 - abs(mean - 118) / 90 ELSE 0.25 - (abs(mean - 118) - 70) / 800 END)), 4) AS exposure,
  round(greatest(0.0, least(1.0, CASE WHEN abs(std - 55) <= 35 THEN 1 - abs(std - 55) / 45 ELSE 0.25 - (abs(std - 55) - 35) / 600 END)), 4) AS contrast,
  (vec_id * 31 % 100) / 100 AS sharpness, (vec_id * 17 % 100) / 100 AS saturation, (vec_id * 7 % 100) / 100 AS edge FROM ms),
ta AS (SELECT *, round(0.0 + 0.35::DOUBLE * sharpness + 0.25::DOUBLE * exposure + 0.15::DOUBLE * contrast + 0.10::DOUBLE * saturation + 0.15::DOUBLE * edge + 1e-9, 4) AS technical,
  round(0.0 + 0.40::DOUBLE * sharpness + 0.25::DOUBLE * exposure + 0.20::DOUBLE * edge + 0.10::DOUBLE * contrast + 0.05::DOUBLE * saturation + 1e-9, 4) AS aesthetic FROM mt),
qs AS (SELECT *, round(0.0 + 0.55::DOUBLE * aesthetic + 0.45::DOUBLE * technical + 1e-9, 4) AS score FROM ta)"""


@query(f"WITH {_QUALITY} SELECT vec_id, exposure, contrast, technical, aesthetic, score FROM qs")
def quality_scores(spark, d):
    return quality.quality_scores(_metrics(spark, d)).select("vec_id", "exposure", "contrast", "technical", "aesthetic", "score")


@query(f"""WITH {_QUALITY}, gr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, sharpness DESC, vec_id) AS rn, count(*) OVER (PARTITION BY label) AS gn FROM qs WHERE vec_id % 2 = 0),
pk AS (SELECT vec_id, CAST(label AS STRING) AS group_id, gn AS group_size, score FROM gr WHERE rn = 1 AND gn > 1 AND score >= 0.50
UNION ALL SELECT vec_id, '', 1, score FROM qs WHERE score >= 0.55 AND vec_id NOT IN (SELECT vec_id FROM gr WHERE gn > 1))
SELECT vec_id, group_id, group_size FROM pk""")
def quality_picks(spark, d):
    s = materialize(quality.quality_scores(_metrics(spark, d)), "scores")  # else every filter repeats the folds
    groups = s.where("vec_id % 2 = 0").select(F.col("label").cast("string").alias("group_id"), "vec_id")
    return quality.select_best(s.drop("label"), groups, "vec_id")[0].select("vec_id", "group_id", "group_size")


@query("SELECT coalesce(human_category, category) AS category, count(*) AS n FROM analysis GROUP BY 1", "analysis")
def category_histogram(spark, d):
    return reports.category_histogram(table(spark, d, "analysis"))


@query("""SELECT (SELECT count(DISTINCT doc_id) FROM assets) AS n_assets, count(DISTINCT doc_id) AS analysed, round(avg(confidence), 4) AS mean_quality, count(*) FILTER (category = 'character') AS n_character, count(*) FILTER (category = 'person') AS n_person,
  count(*) FILTER (category NOT IN ('character', 'person')) AS n_other, (SELECT count(*) FROM groups WHERE type = 'character') AS character_groups, (SELECT count(*) FROM groups WHERE type = 'person') AS person_groups, (SELECT count(*) FROM feedback) AS n_feedback FROM analysis""", "analysis", "assets", "groups", "feedback")
def overview(spark, d):
    return _rounded(reports.overview(*(table(spark, d, n) for n in ("analysis", "assets", "groups", "feedback"))), "mean_quality")


@query("""+ lv AS (SELECT DISTINCT image_path FROM detections WHERE vec_id % 4 <> 1),
al AS (SELECT image_path FROM lv UNION SELECT concat('photos/new', CAST(doc_id AS STRING)) FROM assets WHERE doc_id % 50 = 0),
pa AS (SELECT DISTINCT image_path FROM detections),
og AS (SELECT group_id FROM detections WHERE group_id <> '' GROUP BY 1 HAVING count(*) FILTER (image_path IN (SELECT image_path FROM al)) = 0),
c AS (SELECT 'missing_files' AS key, (SELECT count(*) FROM pa WHERE image_path NOT IN (SELECT image_path FROM al)) AS n, (SELECT count(*) FROM pa) AS t
UNION ALL SELECT 'unassigned', (SELECT count(*) FROM detections WHERE group_id = ''), (SELECT count(*) FROM detections)
UNION ALL SELECT 'orphan_groups', (SELECT count(*) FROM og), NULL
UNION ALL SELECT 'pending', (SELECT count(*) FROM al WHERE image_path NOT IN (SELECT image_path FROM pa)), (SELECT count(*) FROM al)
UNION ALL SELECT 'stale_cache', (SELECT count(*) FROM pa WHERE image_path NOT IN (SELECT image_path FROM al)), (SELECT count(*) FROM pa)
UNION ALL SELECT 'surplus_copies', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT length(image_path) AS k, count(*) AS n FROM al GROUP BY 1)), NULL)
SELECT key, CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END AS status, CAST(n AS BIGINT) AS count, CASE WHEN t IS NULL THEN '' ELSE concat(CAST(n AS STRING), '/', CAST(t AS STRING)) END AS detail FROM c""", "detections", "assets", "groups")
def health_report(spark, d):
    """Some assets gone, some new; equal path lengths stand for equal contents."""
    det = table(spark, d, "detections")
    live = det.where("vec_id % 4 <> 1").select("image_path").union(table(spark, d, "assets").where("doc_id % 50 = 0").select(F.concat(F.lit("photos/new"), F.col("doc_id").cast("string")))).distinct()
    tables = {"detections": det, "assets": live.withColumn("md5", F.length("image_path")), "groups": table(spark, d, "groups"), "cache": det.select("image_path").distinct()}
    return reports.health_report(tables)


@query("""SELECT count(*) AS detections, count(DISTINCT CASE WHEN group_id <> '' THEN group_id END) AS groups, count(*) FILTER (embedding_type = 'face') AS faces, (SELECT count(*) FROM assets) AS assets, (SELECT count(DISTINCT doc_id) FROM analysis) AS analysed,
  (SELECT count(*) - count(DISTINCT md5) FROM assets) AS surplus_copies, greatest(0, (SELECT count(*) FROM assets) - (SELECT count(DISTINCT doc_id) FROM analysis)) AS unanalysed FROM detections""", "detections", "assets", "analysis")
def catalogue_statistics(spark, d):
    return reports.catalogue_statistics(*(table(spark, d, n) for n in ("detections", "assets", "analysis")))


_TERMS = [("水果", ["fruit"], 0), ("水", ["water"], 1), ("狼", ["wolf"], 2), ("城市", ["city"], 3)]
_LANG = {"en": "狼", "fr": "水果 city", "de": "fursuit", "es": "水 狼 城市"}


@query("""+ v(lang, variant_no, variant) AS (VALUES ('en', 0, '狼'), ('en', 1, 'a photo of wolf'), ('fr', 0, '水果 city'), ('fr', 1, 'a photo of fruit'), ('de', 0, 'fursuit'),
  ('es', 0, '水 狼 城市'), ('es', 1, 'a photo of city, water, wolf'), ('es', 2, 'a photo of city'), ('es', 3, 'a photo of water'))
SELECT doc_id AS query_id, variant_no, variant FROM documents JOIN v USING (lang)""", "assets")
def query_expansion(spark, d):
    """One query per document, by its language."""
    words = F.create_map(*(F.lit(x) for kv in _LANG.items() for x in kv))
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), words[F.col("lang")].alias("text"))
    return search.expand_queries(asked, spark.createDataFrame(_TERMS, "term string, words array<string>, position int"))


@query("""+ b AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS bin, event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY epoch(ts), event_id) AS rn FROM events)
SELECT user_id, bin, event_id FROM b WHERE rn = 1""", "feedback")
def timeline_sample(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").select("user_id", (F.col("us") / 1e6).alias("t"), "event_id")
    return catalog.timeline_sample(e, "user_id", "t", 86400).select("user_id", "bin", "event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'resume' ELSE 'start' END AS state FROM documents WHERE doc_id % 3 <> 0")
def job_ledger_delta(spark, d):
    a = table(spark, d, "assets").select("doc_id", "name", "size", "mtime")
    ledger = a.where("doc_id % 3 <> 2").select(catalog.signature("doc_id", "name", "size").alias("job_key"), (F.col("doc_id") % 3 == 0).alias("complete"))
    return catalog.ledger_todo(a, ledger, ["doc_id", "name", "size"]).select("doc_id", "state")


@query("""+ ex AS (SELECT DISTINCT md5 FROM assets WHERE side = 'library'),
x AS (SELECT doc_id, md5, concat('img', CAST(doc_id % 9 AS STRING), '.jpg') AS name FROM assets WHERE side = 'incoming'),
f AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY doc_id) AS r FROM x WHERE md5 NOT IN (SELECT md5 FROM ex)),
c AS (SELECT f.doc_id, name, coalesce(human_category, category) AS category FROM f JOIN analysis USING (doc_id) WHERE r = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY doc_id) - 1 AS k FROM c)
SELECT doc_id, concat('archive/', category, '/', CASE WHEN k = 0 THEN name ELSE concat(regexp_replace(name, '\\.jpg$', ''), '_', CAST(k AS STRING), '.jpg') END) AS dest, 'copy' AS status FROM n
UNION ALL SELECT doc_id, NULL, 'duplicate' FROM x WHERE doc_id NOT IN (SELECT doc_id FROM c)""", "assets", "analysis")
def archive_plan(spark, d):
    a, an = table(spark, d, "assets"), table(spark, d, "analysis")
    incoming = a.where("side = 'incoming'").withColumn("name", F.concat(F.lit("img"), (F.col("doc_id") % 9).cast("string"), F.lit(".jpg")))
    cats = an.select("doc_id", F.coalesce("human_category", "category").alias("category"))
    return catalog.archive_plan(incoming, cats, a.where("side = 'library'"), "archive")


@query("SELECT group_id, arg_min(image_path, vec_id) AS cover FROM detections WHERE group_id <> '' GROUP BY 1", "detections")
def default_covers(spark, d):
    return identity.default_covers(table(spark, d, "detections"), ["vec_id"])


@query("""+ n AS (SELECT group_id, count(DISTINCT image_path) AS n FROM detections WHERE group_id <> '' GROUP BY 1),
l AS (SELECT id, row_number() OVER (ORDER BY n DESC, created_at DESC, id) AS pos FROM groups JOIN n ON id = group_id)
SELECT image_path, arg_min(group_id, pos) AS group_id FROM detections JOIN l ON group_id = id GROUP BY 1""", "groups")
def asset_first_group(spark, d):
    return identity.asset_first_group(table(spark, d, "detections"), table(spark, d, "groups"))


@query("""+ c AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE category END AS category, human_category, doc_id % 10 <> 3 AS live FROM analysis)
SELECT count(*) FILTER (NOT live) AS stale, count(*) FILTER (category IS NULL AND human_category IS NULL) AS empty, count(*) FILTER (NOT live OR (category IS NULL AND human_category IS NULL)) AS removed, count(*) FILTER (live AND NOT (category IS NULL AND human_category IS NULL)) AS kept FROM c""", "analysis")
def cache_prune(spark, d):
    cache = table(spark, d, "analysis").select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("category")).alias("category"), F.col("human_category").alias("override"))
    return catalog.prune(cache, table(spark, d, "assets").where("doc_id % 10 <> 3"), "doc_id")[1]


def _staged(spark, d, name: str, parts: int = 3) -> tuple[DataFrame, str]:
    """A view written as files, read back as a stream of them; and a folder for results."""
    src, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    df = table(spark, d, name)
    df.repartition(parts, df.columns[0]).write.parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), out


@query("SELECT md5 FROM assets GROUP BY 1", "assets")
def stream_ingest_dedup(spark, d):
    stream, out = _staged(spark, d, "assets")
    jobs.ingest_stream(stream, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out).select("md5")


def _replayed_sql(batches: int, threshold: float, margin: float) -> str:
    """The batches one after another: each decides its rows, and the conflicts before it, by the centroids that the last one left."""
    out = ["""typed AS (SELECT vec_id % 3 AS part, image_path, detection_index, group_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM detections WHERE embedding_type = 'primary')""", "grouped0 AS (SELECT group_id, e FROM typed WHERE group_id <> '')", "open0 AS (SELECT image_path, detection_index, e FROM typed WHERE false)"]
    for b in range(batches):
        out.append(f"""pos{b} AS (SELECT group_id, i, avg(e[i]) AS m FROM (SELECT group_id, e, unnest(range(1, len(e) + 1)) AS i FROM grouped{b}) GROUP BY 1, 2),
cen{b} AS MATERIALIZED (SELECT group_id, list(m ORDER BY i) AS v, sqrt(sum(m * m)) AS n FROM pos{b} GROUP BY 1),
pend{b} AS (SELECT image_path, detection_index, e FROM typed WHERE group_id = '' AND part = {b} UNION ALL SELECT * FROM open{b}),
rank{b} AS (SELECT *, row_number() OVER (PARTITION BY image_path, detection_index ORDER BY c DESC, group_id) AS r FROM (SELECT image_path, detection_index, e, group_id, list_dot_product(e, v) / (n * sqrt(list_dot_product(e, e))) AS c FROM pend{b}, cen{b})),
dec{b} AS MATERIALIZED (SELECT a.image_path, a.detection_index, a.e, a.group_id AS top_group, a.c AS c1, z.group_id AS second_group, z.c AS c2, CASE WHEN a.c < {threshold} THEN 'create' WHEN z.c IS NOT NULL AND a.c - z.c < {margin} THEN 'conflict' ELSE 'join' END AS decision
  FROM (SELECT * FROM rank{b} WHERE r = 1) a LEFT JOIN (SELECT * FROM rank{b} WHERE r = 2) z USING (image_path, detection_index)),
named{b} AS MATERIALIZED (SELECT *, CASE decision WHEN 'join' THEN top_group WHEN 'create' THEN substr(sha256(concat(image_path, ':', CAST(detection_index AS STRING))), 1, 16) ELSE '' END AS group_id FROM dec{b}),
grouped{b + 1} AS MATERIALIZED (SELECT * FROM grouped{b} UNION ALL SELECT group_id, e FROM named{b} WHERE group_id <> ''),
open{b + 1} AS (SELECT image_path, detection_index, e FROM named{b} WHERE decision = 'conflict')""")
    every = " UNION ALL ".join(f"SELECT {b} AS b, * FROM named{b}" for b in range(batches))
    return "+ " + ",\n".join(out) + f"""
SELECT image_path, detection_index, decision, group_id, top_group, round(c1, 4) AS top_cos, second_group, round(c2, 4) AS second_cos
FROM (SELECT *, row_number() OVER (PARTITION BY image_path, detection_index ORDER BY b DESC) AS r FROM ({every})) WHERE r = 1"""


@query(_replayed_sql(3, 0.30, 0.05), "detections")
def stream_assign(spark, d):
    """Three batches; groups learn, new ones can be joined later, conflicts are tried again."""
    det = table(spark, d, "detections")
    src, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    for part in range(3):  # a file a batch, in this order
        det.where(F.col("vec_id") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.assign_stream(stream, det, out, f"{out}-checkpoint", "primary", 0.30, 0.05, every=2).awaitTermination()
    return jobs.assigned(spark, out)


@query("SELECT doc_id, arg_max(human_category, seq) AS human_category, max(seq) AS seq FROM feedback GROUP BY 1", "feedback")
def stream_latest(spark, d):
    stream, out = _staged(spark, d, "feedback", 5)
    jobs.latest_table_stream(stream, out, f"{out}-checkpoint", every=2).awaitTermination()
    kinds = dict(stream.dtypes)
    return jobs.latest_table(spark, out, f"doc_id {kinds['doc_id']}, human_category string, seq {kinds['seq']}", every=2).read()


from photarium.plans import more_queries, deep_queries  # noqa: E402, F401  (they register their queries here)
