"""Views that give the driver's tables the shape of a media catalogue; the same text runs in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "detections": """SELECT vec_id,
  concat('photos/', lpad(CAST(CAST((vec_id - vec_id % 3) / 3 AS BIGINT) AS STRING), 6, '0'), '.jpg') AS image_path,
  CAST(vec_id % 3 AS INT) AS detection_index,
  CASE WHEN vec_id % 5 = 0 THEN '' ELSE concat('g', lpad(CAST(label AS STRING), 2, '0'),
       CASE WHEN vec_id % 10 = 9 THEN 'f' WHEN vec_id % 10 = 8 THEN 'v' ELSE 'p' END) END AS group_id,
  CASE WHEN vec_id % 10 = 9 THEN 'face' WHEN vec_id % 10 = 8 THEN 'legacy' ELSE 'primary' END AS embedding_type,
  CAST((vec_id * 37) % 100 AS DOUBLE) / 100 AS confidence, label, embedding
FROM {embeddings}""",
    "assets": """SELECT doc_id, source AS backend,
  concat(CASE WHEN doc_id % 3 = 0 THEN concat('2024', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'),
                lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '_', lpad(CAST(doc_id AS STRING), 6, '0'))
              WHEN doc_id % 3 = 1 THEN CAST(1704067200000 + doc_id * 3600000 AS STRING)
              ELSE concat('img_', CAST(doc_id AS STRING)) END,
         CASE WHEN doc_id % 4 = 0 THEN '.png' ELSE '.jpg' END) AS name,
  n_chars AS size, 1704067200 + doc_id * 60 AS mtime, md5(text) AS md5,
  CASE WHEN doc_id % 5 = 0 THEN 'incoming' ELSE 'library' END AS side
FROM {documents}""",
    "groups": """SELECT group_id AS id,
  CASE WHEN CAST(substr(group_id, 2, 2) AS INT) % 3 = 0 THEN concat('Name ', substr(group_id, 2, 2)) ELSE '' END AS name,
  CASE WHEN group_id LIKE '%f' THEN 'person' ELSE 'character' END AS type,
  concat('2024-01-', lpad(CAST(1 + CAST(substr(group_id, 2, 2) AS INT) % 4 AS STRING), 2, '0'), ' 00:00:00') AS created_at
FROM (SELECT DISTINCT group_id FROM {detections} WHERE group_id <> '') t""",
    "favorites": "SELECT name, mtime AS created_at FROM {assets} WHERE doc_id % 7 = 0",
    "analysis": """SELECT d.doc_id,
  CASE d.lang WHEN 'en' THEN 'character' WHEN 'fr' THEN 'person' ELSE 'other' END AS category,
  CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100 AS confidence,
  CASE WHEN l.quality = 0 THEN 'rejected' END AS human_category
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "feedback": "SELECT event_id AS seq, user_id AS doc_id, event_type AS human_category, ts FROM {events}",
}
BASE = {"detections": ("embeddings",), "assets": ("documents",), "groups": ("detections",), "favorites": ("assets",), "analysis": ("documents", "labels"), "feedback": ("events",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or one of the views."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{b: table(spark, sf_dir, b) for b in BASE[name]})


def view_sql(*names: str) -> str:
    """CTEs of the named views and what they stand on, for an oracle's WITH clause."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        for b in BASE.get(name, ()):
            add(b)
        if name in VIEWS:
            text = VIEWS[name]
            for b in BASE[name]:
                text = text.replace("{" + b + "}", b)
            seen.setdefault(name, text)

    for n in names:
        add(n)
    return ",\n".join(f"{k} AS ({v})" for k, v in seen.items())
