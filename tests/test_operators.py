"""Operators on toy inputs: the reference's cases restated, and brute force."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from photarium.functions import labels
from photarium.operators import dedup, graph, identity, quality, threshold, vectors
from photarium.plans import ingest, search
from photarium.sources import catalog, images

DET = "image_path string, detection_index int, embedding array<float>, embedding_type string, group_id string, confidence double"


def det(spark, *rows):
    def vec(*xs):
        return [float(x) for x in xs] + [0.0] * (8 - len(xs))

    return spark.createDataFrame([(p, i, vec(*e), "primary", g, 0.9) for p, i, e, g in rows], DET)


@pytest.mark.parametrize(("new", "groups", "decision"), [
    ((0.95, 0.3118), [("A", (1, 0)), ("A", (1, 0))], "join"),
    ((0.949, 0.316), [("A", (1, 0)), ("B", (0.8, 0.6))], "conflict"),
    ((0.792, 0.6105), [("A", (1, 0))], "join"),
    ((0.785, 0.6194), [("A", (1, 0))], "create"),
    ((1, 0), [], "create"),
])
def test_assign(spark, new, groups, decision):
    rows = [(f"g{k}", 0, e, g) for k, (g, e) in enumerate(groups)]
    got = identity.incremental_assign(det(spark, *rows, ("new", 0, new, "")), "primary").collect()
    assert [r["decision"] for r in got] == [decision]


def test_two_equal_new_rows_get_two_groups(spark):
    got = identity.incremental_assign(det(spark, ("x", 0, (1, 0), ""), ("y", 0, (1, 0), "")), "primary").collect()
    assert len({r["group_id"] for r in got}) == 2


def test_all_types_refused(spark):
    with pytest.raises(ValueError):
        identity.cluster_type(det(spark, ("x", 0, (1, 0), "")), "all")


def test_components_of_a_long_chain(spark):
    n = 2000
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)], "a long, b long")
    got = graph.component_stars(edges).agg(F.countDistinct("component"), F.count("*"), F.min("component")).first()
    assert tuple(got) == (1, n, 0)


def test_components_brute(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1, 1), (None, 2)]
    got = {r["vertex"]: r["component"] for r in graph.connected_components(spark.range(300), spark.createDataFrame(edges, "a long, b long")).collect()}
    label = list(range(300))
    for _ in range(300):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("distance", [3, 8, 14])
def test_hamming_pairs_brute(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(60)]
    flip = lambda x: x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(20)))
    prints = base + [flip(x) for x in base] + base[:3]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = {(r["a"], r["b"]) for r in dedup.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "k long, dhash long"), "k", distance).collect()}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= distance}
    assert got == want


def test_threshold_pairs_brute(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = {(r["a"], r["b"]) for r in threshold.threshold_pairs(df, "k", "v", 0.7, pivots=3).collect()}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] >= 0.7}


def test_merge_refusals_and_undo(spark):
    d = det(spark, ("a", 0, (1, 0), "A"), ("b", 0, (1, 0), "B"), ("c", 0, (1, 0), "B"))
    g = spark.createDataFrame([("A", "", "character", "1"), ("B", "x", "character", "2"), ("P", "", "person", "3")], "id string, name string, type string, created_at string")
    for target, sources in (("", ["B"]), ("A", ["A"]), ("A", ["Z"]), ("A", ["P"])):
        with pytest.raises(ValueError):
            identity.merge_groups(d, g, target, sources)
    merged, left, log = identity.merge_groups(d, g, "A", ["B"])
    assert merged.where("group_id = 'A'").count() == 3 and left.count() == 2
    back, groups = identity.undo_merge(merged, left, log)
    assert sorted(map(tuple, back.select("image_path", "group_id").collect())) == [("a", "A"), ("b", "B"), ("c", "B")] and groups.count() == 3
    with pytest.raises(ValueError):
        identity.undo_merge(d, g, log.limit(0))


def test_validation(spark):
    ok, bad = identity.validate_detections(spark.createDataFrame([([0.0, 0.0, 5.0, 5.0], 0.5, [1.0, 0.0]), ([5.0, 0.0, 5.0, 5.0], 0.5, [1.0, 0.0]), ([0.0, 0.0, 5.0, 5.0], 2.0, [1.0, 0.0]), ([0.0, 0.0, 5.0, 5.0], 0.5, [1.0]), ([0.0, 0.0, 5.0, 5.0], 0.5, [float("nan"), 0.0]), ([0.0, 0.0, 5.0, 5.0], 0.5, [2.0, 0.0])], "bbox array<double>, confidence double, embedding array<float>"), 2)
    assert ok.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["box", "confidence", "dimension", "norm", "not finite"]


def test_fused_topk(spark):
    v = spark.createDataFrame([("wolf", [1.0, 0.0, 0.0, 0.0]), ("city", [0.0, 1.0, 0.0, 0.0]), ("gone", [0.0, 1.0, 0.0, 0.0])], "key string, vector array<double>")
    q = spark.createDataFrame([("q", "q", [0.0, 0.0, 1.0, 0.0]), ("q", "q", [0.0, 1.0, 0.0, 0.0])], "query_id string, fused string, vector array<double>")
    got = vectors.vector_topk(v, q, 1, fuse_by="fused", alive=v.where("key <> 'gone'").select("key")).collect()
    assert [(r["key"], r["rank"]) for r in got] == [("city", 1)]


def test_index_delta(spark):
    assets = spark.createDataFrame([("a", "m1", 1, 1, "1"), ("b", "m2", 1, 1, "2"), ("c", "m2", 1, 1, "2"), ("d", "m1", 1, 1, "1"), ("e", "m3", 1, 1, "bad")], "path string, md5 string, size int, mtime int, content string")
    old = spark.createDataFrame([("a", "m1", 1, 1, [1.0, 0.0]), ("x", "m9", 1, 1, [1.0, 0.0])], "path string, md5 string, size int, mtime int, vector array<float>")
    now, status = vectors.index_delta(assets, old, lambda: lambda c: [float(c), 0.0], 2)
    assert sorted(r["path"] for r in now.collect()) == ["a", "b"]
    assert {r["path"]: r["status"] for r in status.collect()} == {"a": "skipped_existing", "b": "new", "c": "skipped_md5", "d": "skipped_md5", "e": "failed"}


def test_query_expansion(spark):
    terms = spark.createDataFrame([("水果", ["fruit"], 0), ("水", ["water"], 1)], "term string, words array<string>, position int")
    asked = spark.createDataFrame([(1, "水果"), (2, "fursuit"), (3, "  "), (4, None)], "query_id int, text string")
    got = {}
    for r in search.expand_queries(asked, terms).collect():
        got.setdefault(r["query_id"], []).append(r["variant"])
    assert got == {1: ["水果", "a photo of fruit"], 2: ["fursuit"]}


def test_asset_dates(spark):
    names = spark.createDataFrame([("20260601_125816.jpg", 0), ("1787539644969.jpg", 0), ("1704067200.png", 0), ("x.jpg", 86400), ("99999999999999999999.jpg", 0)], "name string, mtime long")
    assert [r[0] for r in names.select(catalog.asset_date()).collect()] == ["2026-06-01", "2026-08-24", "2024-01-01", "1970-01-02", "1970-01-01"]


def test_pending_cleanup(spark):
    log = spark.createDataFrame([("resolve", "k", "c", 1), ("resolve", "k", "k2", 1), ("resolve", "k2", "z", 2), ("resolve", "gone", "w", 1), ("ignore", "k", "c", 0)], "kind string, a string, b string, at int")
    alive = spark.createDataFrame([(p,) for p in ("k", "c", "k2", "z", "w")], "p string")
    assert sorted((r["candidate"], r["kept"]) for r in dedup.pending_cleanup(log, alive).collect()) == [("c", "k"), ("z", "k2")]


def test_feedback_by_path_or_suffix(spark):
    assets = spark.createDataFrame([("lib/a/x.jpg",), ("lib/b/y.jpg",)], "path string")
    log = spark.createDataFrame([("lib/a/x.jpg", "", "one", 1), ("other", "a\\x.jpg", "two", 2), ("other", "b/x.jpg", "three", 3)], "image_path string, rel_path string, human_category string, seq int")
    assert [(r["path"], r["human_category"]) for r in labels.feedback_for_assets(assets, log).collect()] == [("lib/a/x.jpg", "two")]


def test_species_fall_back(spark):
    rows = spark.createDataFrame([(1, "wolf", "🐺 狼兽装", 80.0, {"wolf": 0.50, "fox": 0.48}), (2, "wolf", "🐺 狼兽装", 95.0, {"wolf": 0.60, "fox": 0.30})], "doc_id long, category string, label string, quality double, scores map<string,double>")
    none = spark.createDataFrame([], "doc_id long, human_category string, seq long")
    got = {r["doc_id"]: (r["category"], r["stars"]) for r in labels.advise(rows, none, species=["wolf", "fox"]).collect()}
    assert got == {1: ("兽装人物", "★★★★☆"), 2: ("狼兽装", "★★★★★")}


def test_select_best(spark):
    s = spark.createDataFrame([("a", 0.6, 0.5), ("b", 0.6, 0.7), ("c", 0.9, 0.1), ("d", 0.52, 0.1)], "path string, score double, sharpness double").withColumns({c: F.lit(0.5) for c in ("exposure", "contrast", "saturation")})
    g = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "d")], "group_id string, path string")
    assert [r["path"] for r in quality.select_best(s, g)[0].collect()] == ["c", "b"]


def test_batch_plan_null_hash(spark):
    inc = spark.createDataFrame([(1, 5, "m"), (2, 5, "m"), (3, 6, None), (4, 6, None), (5, 7, "lib")], "doc_id long, size long, md5 string")
    lib = spark.createDataFrame([(9, 7, "lib")], "doc_id long, size long, md5 string")
    got = {r["doc_id"]: r["status"] for r in ingest.batch_plan(inc, lib, lib).collect()}
    assert got == {1: "process", 2: "batch_duplicate", 3: "process", 4: "process", 5: "library_duplicate"}


def test_box(spark):
    df = spark.createDataFrame([([0.1, 0.1, 0.5, 0.5],), ([10.0, 10.0, 500.0, 20.0],), ([5.0, 5.0, 5.0, 5.0],), ([float("nan")] * 4,), (None,)], "b array<double>")
    assert [r[0] for r in df.select(images.box_pixels(F.col("b"), F.lit(100), F.lit(200))).collect()] == [[10, 20, 50, 100], [10, 10, 100, 20], [5, 5, 6, 6], None, None]


def bmp(path, rgb):
    h, w, _ = rgb.shape
    pad = (-w * 3) % 4
    rows = b"".join(rgb[y, :, ::-1].tobytes() + b"\0" * pad for y in range(h - 1, -1, -1))
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows)


def scene(seed):
    rng = np.random.default_rng(seed)
    x = np.linspace(0, 200, 320)[None, :, None] * np.ones((240, 1, 3)) * rng.uniform(0.5, 1, 3)
    for _ in range(24):
        y0, x0 = rng.integers(0, 200), rng.integers(0, 280)
        x[y0 : y0 + 40, x0 : x0 + 40] = rng.integers(0, 255, 3)
    return x.clip(0, 255).astype(np.uint8)


def test_image_job(spark, tmp_path):
    base = scene(1)
    bmp(tmp_path / "base.bmp", base)
    bmp(tmp_path / "bright.bmp", (base * 1.15).clip(0, 255).astype(np.uint8))
    bmp(tmp_path / "shift.bmp", np.roll(base, 4, axis=1))
    bmp(tmp_path / "other.bmp", scene(9))
    bmp(tmp_path / "copy.bmp", base)
    (tmp_path / "broken.bmp").write_bytes(b"BM nothing")
    fp = images.image_fingerprints(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1)).cache()
    assert fp.where("failed").count() == 1 and fp.where("w = 320 AND h = 240").count() == 5
    got = [r["path"] for r in dedup.near_duplicate_groups(fp.where("NOT failed")).orderBy("path").collect()]
    assert got == ["base.bmp", "bright.bmp", "shift.bmp"]
    blur = np.repeat(np.repeat(base[::8, ::8], 8, 0), 8, 1)
    assert images.technical_metrics(base.astype(float))["exposure"] > images.technical_metrics(base.astype(float) * 0.1)["exposure"]
    assert images.technical_metrics(base.astype(float))["edge"] > images.technical_metrics(np.full(blur.shape, 90.0))["edge"]


def test_scan_and_changes(spark, tmp_path):
    for n in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    found, errors = catalog.scan_roots(spark, {"lib": str(tmp_path), "gone": str(tmp_path / "none")})
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.jpg", "b.PNG"] and errors.count() == 1
    ref = catalog.with_reference(found.withColumn("path", F.element_at(F.split("path", "/"), -1)))
    assert {r["format"] for r in ref.collect()} == {"jpeg", "png"}


def test_result_cache_quarantine(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"path": "a", "category": "x"}\n{broken\n')
    good, bad = catalog.load_result_cache(spark, str(tmp_path / "c.json"), "path string, category string")
    assert [r["path"] for r in good.collect()] == ["a"] and [r["value"] for r in bad.collect()] == ["{broken"]


def test_temporary_scratch(spark):
    """Folders of a block go with it; a result at a path named outside stays."""
    import os

    from photarium.sources.scratch import materialize, scratch_path, temporary

    path = scratch_path(spark, "result")
    with temporary(spark):
        inner = materialize(spark.range(5), "inner")
        with temporary(spark):
            deep = materialize(spark.range(3), "deep").inputFiles()
        assert not any(map(os.path.exists, (f.removeprefix("file://") for f in deep)))
        files = inner.inputFiles()
        result = materialize(inner.where("id > 1"), "result", path)
    assert files and not any(map(os.path.exists, (f.removeprefix("file://") for f in files)))
    assert result.count() == 3


def test_ingest_stream_batches(spark, tmp_path):
    """Earlier batches win over smaller keys, and a later run goes on where the first stopped."""
    from photarium.streaming.jobs import ingest_stream

    schema, src, out, log = "doc_id long, md5 string", tmp_path / "in", tmp_path / "out", str(tmp_path / "log")

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        ingest_stream(stream, str(out), log).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(out)).select("doc_id", "md5").collect())

    assert feed([(5, "a"), (4, "a"), (7, "b")]) == [(4, "a"), (7, "b")]
    assert feed([(1, "a"), (2, "b")]) == [(4, "a"), (7, "b")]
    assert feed([(3, "b"), (9, "c"), (8, "c")]) == [(4, "a"), (7, "b"), (8, "c")]
