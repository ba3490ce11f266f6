"""Lookups, sums and searches against brute force; both routes of every switch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photarium.operators import dedup, identity, threshold, vectors
from photarium.plans import search_index
from photarium.plans.search_index import SubstringIndex


@pytest.mark.parametrize("distance", [2, 8, 14, 21, 40])
def test_close_pairs(distance):
    """All pairs once, by lookups or by comparing; up to 14 bits few random prints are compared."""
    rng = np.random.default_rng(distance)
    one = rng.integers(0, 1 << 64, 700, np.uint64)
    two = rng.integers(0, 1 << 64, 6000, np.uint64)
    for k in range(500):
        two[k] = one[k] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 26, False)))
    i, j, compared = dedup.close_pairs(one, two, distance)
    want = np.nonzero(np.bitwise_count(one[:, None] ^ two[None, :]) <= distance)
    assert len(i) == len(want[0]) and set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in want)))
    assert compared <= (0.05 if distance <= 14 else 1) * len(one) * len(two)
    assert bool(dedup.band_plan(distance)) == (distance <= 14)


@pytest.mark.parametrize("distance", [14, 21])
def test_hamming_pairs_blocks(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = base + [x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(26))) for x in base] + base[:3]
    rows = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(prints)] + [(9999, None)]
    df = spark.createDataFrame(rows, "k long, dhash long")
    want = sorted((i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= distance)
    for block in (64, 1 << 18):
        assert sorted(map(tuple, dedup.hamming_pairs(df, "k", distance, block_rows=block).collect())) == want


def near(rows):
    return {k: (g, None if c is None else round(c, 6)) for k, g, c in rows}


def test_assign_routes(spark, monkeypatch):
    """One matrix or blocks: the same decisions, also for vectors that are null, empty, not finite or of another length."""
    rng = np.random.default_rng(1)
    reps = spark.createDataFrame([(f"g{k:02}", rng.standard_normal(4).tolist()) for k in range(23)] + [("h", [1.0, 0.0]), ("z", [0.0] * 4)], "group_id string, centroid array<double>")
    rows = [(f"p{k:03}", 0, rng.standard_normal(4).tolist()) for k in range(50)]
    rows += [("null", 0, None), ("empty", 0, []), ("nan", 0, [float("nan"), 0.0, 0.0, 0.0]), ("hole", 0, [1.0, None, 0.0, 0.0]), ("two", 0, [1.0, 0.1]), ("three", 0, [1.0, 0.0, 0.0]), ("zero", 0, [0.0] * 4)]
    pend = spark.createDataFrame(rows, "image_path string, detection_index int, embedding array<double>")
    one = sorted(map(tuple, identity.assign(pend, reps, 0.5, 0.05).collect()))
    made = {r[0]: r[2] for r in one}
    assert len(one) == len(rows) and {k: made[k] for k in ("null", "empty", "nan", "hole", "two", "three", "zero")} == dict(null="skip", empty="skip", nan="skip", hole="skip", two="join", three="create", zero="create")
    monkeypatch.setattr(identity, "REPRESENTATIVES", 20)
    assert sorted(map(tuple, identity.assign(pend, reps, 0.5, 0.05).collect())) == one
    none = identity.assign(pend, reps.limit(0), 0.5, 0.05).collect()
    assert {r["decision"] for r in none} == {"create", "skip"} and sum(r["decision"] == "skip" for r in none) == 4


def test_product_is_bounded():
    """100,000 groups: a batch of rows is taken in slices of 64 MB."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    sides = vectors.units(rng.standard_normal((100_000, 16)))
    held = {16: (np.array([f"g{k}" for k in range(100_000)], dtype=object), sides)}
    column = pa.array(rng.standard_normal((300, 16)).tolist(), pa.list_(pa.float64()))
    tracemalloc.start()
    found = identity._best_of_batch(column, held)
    assert tracemalloc.get_traced_memory()[1] < 256 << 20
    tracemalloc.stop()
    x = vectors.units(np.array(column.to_pylist()))
    assert [f[0]["g"] for f in found] == [f"g{k}" for k in (x @ sides.T).argmax(axis=1)]


def test_topk_routes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(k, rng.integers(-3, 4, 5).astype(float).tolist()) for k in range(300)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 5)]
    df = spark.createDataFrame(data, "key long, vector array<double>")
    asked = spark.createDataFrame([(k, k // 2, v) for k, v in data[:40]] + [(77, 3, None)], "query_id long, fused long, vector array<double>")
    for fuse in (None, "fused"):
        runs = []
        for cells in (8_000_000, 0):
            monkeypatch.setattr(vectors, "QUERY_CELLS", cells)
            monkeypatch.setattr(vectors, "PRODUCT", 8_000_000 if cells else 500)
            runs.append(sorted(map(tuple, vectors.vector_topk(df, asked, 4, fuse_by=fuse).select("query_id", "rank", "key", "similarity").collect())))
        want = []
        for q in {k // 2 if fuse else k for k in range(40)}:
            own = [k for k in range(40) if (k // 2 if fuse else k) == q]
            score = {k: max(float(np.dot(data[o][1], v)) for o in own) for k, v in data[:300] if k not in own}
            want += [(q, r + 1, k, score[k]) for r, k in enumerate(sorted(score, key=lambda k: (-score[k], k))[:4])]
        assert runs[0] == runs[1] == sorted(want)
    with pytest.raises(ValueError, match="1 to 5 components"):
        vectors.vector_topk(df, asked.union(spark.createDataFrame([(1, 1, [1.0])], asked.schema)), 3)


def test_vector_sums(spark, monkeypatch):
    """Sums of a task are one row a group and length, whatever the rows; odd vectors are left out."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "c"]), [float(rng.randrange(9)) for _ in range(rng.choice([3, 3, 3, 2]))]) for _ in range(500)]
    odd = [("a", None), ("a", []), ("b", [float("inf"), 0.0, 0.0]), ("b", [1.0, None, 2.0])]
    want: dict = {}
    for g, v in rows:
        total, n = want.get((g, len(v)), ([0.0] * len(v), 0))
        want[g, len(v)] = [x + y for x, y in zip(total, v)], n + 1
    df = spark.createDataFrame(rows + odd, "g string, v array<double>").repartition(3)
    for cells in (2_000_000, 4):
        monkeypatch.setattr(vectors, "SUM_CELLS", cells)
        assert {(r["g"], r["size"]): (r["total"], r["n"]) for r in vectors.vector_sums(df, "g", "v").collect()} == want
    parts = vectors._added(df.select("g", F.col("v").alias("total"), F.lit(1).cast("long").alias("n")), ["g"])
    assert parts.count() <= 3 * len(want)
    made = {r["g"]: (r["members"], np.round(r["centroid"], 9).tolist()) for r in vectors.centroids(df, "g", "v").collect()}
    assert made == {g: (want[g, 3][1], np.round(np.array(want[g, 3][0]) / np.linalg.norm(want[g, 3][0]), 9).tolist()) for g in ("a", "b", None, "c")}


@pytest.mark.parametrize("broad", [0, 7, 10_000])
def test_substring_index(spark, tmp_path, broad):
    """By grams and by the ordered scan: what testing every entry finds, also after reading the index back."""
    rng = random.Random(6)
    names = ["".join(rng.choices("aAb1_.é人", k=rng.randrange(9))) for _ in range(400)] + [None, "", "IMG_1.jpg", "IMG_1.jpg", "%_\\"]
    rows = [(k, n, k % 3) for k, n in enumerate(names)]
    SubstringIndex.build(spark.createDataFrame(rows, "id long, name string, kind int").repartition(6), "name", ["kind", "id"], f"file://{tmp_path}/index")
    index = SubstringIndex.load(spark, f"file://{tmp_path}/index")
    words = ["", None, " a ", "A", "ab", "b1", "aab", "a.é人", "zz", "img_1", "%", "_\\", "1_.a", "人", *[n for n in names[:40] if n]]
    asked = spark.createDataFrame(list(enumerate(words)), "query_id long, text string")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in index.search(asked, 5, F.col("kind") != 1, broad).collect())
    want = []
    for q, w in enumerate(words):
        hits = [(k, i) for i, n, k in rows if k != 1 and (w or "").strip().lower() in (n or "").lower()]
        want += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(hits)[:5])]
    assert got == sorted(want)


def test_search_reads_few_entries(spark):
    """A rare word's lookup meets its own postings only."""
    rows = spark.range(2000).selectExpr("id", "concat('photo_', id, '.jpg') AS name")
    index = SubstringIndex.build(rows, "name", ["id"])
    plan = {r["text"]: r["n"] for r in index.planned(spark.createDataFrame([(1, "to_1999"), (2, ".jpg"), (3, ""), (4, "xyz")], "query_id long, text string")).collect()}
    assert plan == {"to_1999": 2, ".jpg": 2000, "": None, "xyz": 0} or plan["to_1999"] <= 20


def test_no_hash_is_no_copy(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, None, 5), (3, "x", 5), (4, "x", 6)], "doc_id long, md5 string, size long")
    assert sorted(r["doc_id"] for r in dedup.first_per_hash(rows).collect()) == [1, 2, 3]
    plan = {r["doc_id"]: r["reason"] for r in dedup.cleanup_plan(rows, rows, rows.limit(0), "doc_id").collect()}
    assert plan == {1: "no copy", 2: "no copy", 3: "duplicate", 4: "last copy"}


def clustered(seed, centres=30, each=20, dim=16, noise=0.12):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((centres, dim)), each, axis=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True) + noise * rng.standard_normal(x.shape) / np.sqrt(dim)


@pytest.mark.parametrize("pivots,rows", [(1, 2048), (25, 2048), (25, 5)])
def test_threshold_cells(spark, monkeypatch, pivots, rows):
    """Any pivots, cells whole or cut: the pairs and components of brute force; odd vectors have none."""
    monkeypatch.setattr(threshold, "CELL_ROWS", rows)
    x = np.concatenate([clustered(8, 12, 12), np.repeat(clustered(9, 1, 1), 30, axis=0)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    data = [(f"k{k:03}", v.tolist()) for k, v in enumerate(x)] + [("null", None), ("empty", []), ("nan", [float("nan")] * 16), ("zero", [0.0] * 16), ("zero2", [0.0] * 16), ("short", [1.0]), ("short2", [2.0])]
    df = spark.createDataFrame(data, "k string, v array<double>")
    want = {(f"k{i:03}", f"k{j:03}") for i in range(len(x)) for j in range(i + 1, len(x)) if u[i] @ u[j] >= 0.8} | {("short", "short2")}
    got = [(r["a"], r["b"]) for r in threshold.threshold_pairs(df, "k", "v", 0.8, pivots).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    label = {k: k for k, _ in data}
    for _ in range(len(x)):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    links = threshold.threshold_links(df, "k", "v", 0.8, pivots)
    assert {r["vertex"]: r["component"] for r in identity.connected_components(df.select("k"), links).collect()} == label
    assert links.count() <= 8 * len(data)


def test_pivots_prune(spark):
    """On grouped vectors few of the pairs are compared."""
    x = clustered(10, 40, 50)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    (cells,) = threshold.threshold_cells(df, "k", "v", 0.9, 100)
    compared = cells.compared().agg(F.sum("pairs")).first()[0]
    assert compared < 0.25 * len(x) * (len(x) - 1) / 2


def test_threshold_lsh(spark):
    x = clustered(11, 40, 10)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    exact = {(r["a"], r["b"]): r["similarity"] for r in threshold.threshold_pairs(df, "k", "v", 0.9).collect()}
    found = {(r["a"], r["b"]): r["similarity"] for r in threshold.threshold_pairs_lsh(df, "k", "v", 0.9).collect()}
    assert set(found) <= set(exact) and len(found) >= 0.95 * len(exact) > 500
    assert all(abs(exact[k] - s) < 1e-9 for k, s in found.items())


@pytest.mark.parametrize("broad", [3, 10_000])
def test_equal_queries_are_answered_once(spark, monkeypatch, broad):
    """Many equal queries cost their results, not their matches: what is ranked and written are texts."""
    monkeypatch.setattr(search_index, "PART_ROWS", 100)
    written = []
    keep = search_index.materialize
    monkeypatch.setattr(search_index, "materialize", lambda df, name, path=None: written.append((name, out := keep(df, name, path))) or out)
    rows = spark.range(1000).selectExpr("id", "concat('photo_', id, '.jpg') AS name")
    index = SubstringIndex.build(rows, "name", ["id"])
    assert index.entries.select("part_").distinct().count() > 5
    texts = ["photo", "", "_99", "0.j", None]
    asked = spark.range(500).selectExpr("id AS query_id", f"array({', '.join('NULL' if t is None else repr(t) for t in texts)})[id % {len(texts)}] AS text")
    got = {}
    for r in index.search(asked, 4, broad=broad).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q in range(500):
        hits = [k for k in range(1000) if (texts[q % len(texts)] or "") in f"photo_{k}.jpg"][:4]
        assert sorted(got[q]) == list(enumerate(hits, 1))
    assert all(df.count() <= 4 * 4 for name, df in written if name in ("asked", "wide", "scanned", "hits"))
