"""The detection table's commits and the term dictionary."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from photarium.operators import vectors
from photarium.operators.chunked import ChunkedIndex
from photarium.plans.search import PREFIX, Dictionary, sort_groups
from photarium.sources import catalog
from photarium.sources.detections import DetectionTable

ROW = "image_path string, detection_index int, confidence double"


def test_detection_table(spark, tmp_path):
    """A failing batch leaves the old rows, other buckets keep their files, an emptied bucket is empty."""
    path = f"file://{tmp_path}/t"
    table = DetectionTable(spark, path, ROW, 8)
    rows = [(f"p{k % 40}", k // 40, 0.5) for k in range(100)]
    frame = lambda some: spark.createDataFrame(some, ROW)
    read = lambda: sorted(map(tuple, table.read().collect()))
    assert read() == []
    table.upsert(frame(rows))
    assert read() == sorted(rows)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/bucket=*/*.parquet")}
    before = files()

    bad = F.udf(lambda x: 1 / 0, "double")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        table.upsert(frame([("p1", 0, 0.9), ("new", 0, 0.9)]).withColumn("confidence", bad("confidence")))
    assert read() == sorted(rows) and files() == before

    table.upsert(frame([("p1", 0, 0.9), ("p1", 7, 0.7)]))
    want = sorted([r for r in rows if r[:2] != ("p1", 0)] + [("p1", 0, 0.9), ("p1", 7, 0.7)])
    assert read() == want
    after = files()
    mine = {os.path.dirname(f) for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}
    assert len(mine) == 1 and all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in mine)

    # all of an asset or nothing
    table.upsert(frame([("a", 0, 0.1), ("b", 0, 0.2), ("b", 1, 0.3)]), spark.createDataFrame([("a", 2), ("b", 2)], "image_path string, n long"))
    assert read() == sorted(want + [("b", 0, 0.2), ("b", 1, 0.3)])
    assert sorted(map(tuple, table.of_assets(["b", "a", "p1"]).collect())) == sorted([r for r in want if r[0] == "p1"] + [("b", 0, 0.2), ("b", 1, 0.3)])
    gone = [r for r in read() if r[0] != "p2"]
    table.remove(frame(gone).select("image_path").distinct())
    assert {r[0] for r in read()} == {"p2"} and len({os.path.dirname(f) for f in files()}) == 1


def one_by_one(text, terms, limit):
    """Each term tried on the text, longest first."""
    text = (text or "").strip()
    if not text:
        return []
    free, words = text, []
    for term, english in sorted(terms, key=lambda x: -len(x[0])):
        if term in free:
            free = free.replace(term, "\0" * len(term))
            words += [w for w in dict.fromkeys(english) if w not in words]
    return list(dict.fromkeys([text, *([PREFIX + ", ".join(words)] if words else []), *(PREFIX + w for w in words)]))[: max(1, limit)]


@pytest.mark.parametrize("size", [0, 5, 300])
def test_dictionary(size):
    rng = random.Random(size)
    for _ in range(60):
        terms = [("".join(rng.choices("ab水果", k=rng.randrange(0 if rng.random() < 0.05 else 1, 6))), [f"w{rng.randrange(9)}" for _ in range(rng.randrange(3))]) for _ in range(size)]
        known = Dictionary(terms)
        for _ in range(20):
            text = "".join(rng.choices("ab水果c ", k=rng.randrange(25)))
            assert known.variants(text, 50) == one_by_one(text, terms, 50)


def test_large_dictionary():
    """100,000 terms: as one by one, and the cost follows the text."""
    import time

    rng = random.Random(3)
    terms = [("".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))), [f"w{k}"]) for k in range(100_000)]
    known, texts = Dictionary(terms), ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(200)]
    assert [known.variants(t, 99) for t in texts[:5]] == [one_by_one(t, terms, 99) for t in texts[:5]]
    began = time.perf_counter()
    for t in texts:
        known.variants(t, 4)
    each = (time.perf_counter() - began) / len(texts)
    began = time.perf_counter()
    one_by_one(texts[0], terms, 4)
    assert each < (time.perf_counter() - began) / 5


def test_chunked_index_resumes(spark, tmp_path):
    """A run lost in its second chunk: the next one encodes nothing of the first again."""
    log = tmp_path / "encoded"
    log.mkdir()
    rows = [(f"p{k:02}", f"m{k}" if k % 9 else None, 10, k, f"text {k}") for k in range(40)] + [("z", "m1", 10, 1, "text 1")]
    assets = spark.createDataFrame(rows, "path string, md5 string, size long, mtime long, content string")
    chunk_of = {r["path"]: r["c"] for r in assets.select("path", (F.xxhash64("path") % 2 != 0).cast("int").alias("c")).collect()}
    bad = next(r for r in rows if chunk_of[r[0]] == 1)[4]

    def coder(broken):
        def load():
            def one(text):
                if broken and text == bad:
                    os._exit(1)  # the worker is lost, and its retries as well
                (log / f"{text}-{os.urandom(4).hex()}").touch()
                return [float(len(text)), 1.0] if text != "text 7" else [1.0]

            return one

        return load

    index = ChunkedIndex(spark, f"file://{tmp_path}/index")
    with pytest.raises(Exception):
        index.build(assets, coder(True), 2, chunk_rows=21)
    done = {f.name.rsplit("-", 1)[0] for f in log.iterdir()}
    first = {r[4] for r in rows[:40] if chunk_of[r[0]] == 0}
    assert first <= done and len(os.listdir(tmp_path / "index")) == 1
    for f in log.iterdir():
        f.unlink()
    status = {r["path"]: r["status"] for r in index.build(assets, coder(False), 2, chunk_rows=21).collect()}
    again = {f.name.rsplit("-", 1)[0] for f in log.iterdir()}
    assert not again & (first - {"text 7"}) and len(again) == len(list(log.iterdir()))
    assert status["z"] == "skipped_md5" and status["p07"] == "failed" and sorted(status) == sorted(r[0] for r in rows)
    assert sum(s == "new" for s in status.values()) + sum(s == "skipped_existing" for s in status.values()) == 39
    live = assets.where("path < 'p20'")
    index.compact(live)
    assert len(os.listdir(tmp_path / "index")) == 1 and index.vectors(assets).count() == 19


@pytest.mark.parametrize("parts", [1, 9])
def test_ordered_sample(spark, parts):
    """As a player takes them: half-frame tolerance, catching up behind gaps, one key with nearly all rows."""
    rng = random.Random(parts)
    rows, no = [], 0
    for key, n in ((1, 900), (2, 30), (None, 30), (4, 1)):
        second = 0.0 if key != 2 else 7.0
        for _ in range(n):
            rows.append((key, no, second))
            no += 1
            second = round(second + rng.choice([0, 0.1, 0.1, 0.1, 0.5, 9]), 6)
    rows.append((5, no, None))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in catalog.ordered_sample(spark.createDataFrame(rows, "k long, id long, second double"), "k", "second", 1.0, 0.05, ["id"]).select("k", "id", "sample_no", "at_ms").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, due = [], {}
    for key, i, second in rows:
        if second is not None and second + 0.05 >= due.get(key, 0) * 1.0:
            want.append((key, i, due.get(key, 0), round(second * 1000)))
            due[key] = due.get(key, 0) + 1
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [r for r in got if r[0] == 4] == [(4, 960, 0, 0)]


def test_roots(spark, tmp_path):
    """Listings with change and creation times, errors as rows, bytes of the asked files only."""
    from photarium.sources import roots

    for name in ("a/x.JPG", "a/b/c/y.png", "a/note.txt", "z.webp", "z.jpeg", "noext", "a/jpg"):
        (tmp_path / "one" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "one" / name).write_bytes(name.encode())
    wanted = {"one": str(tmp_path / "one"), "gone": str(tmp_path / "gone")}
    assets, errors = roots.list_roots(spark, wanted, shares=3)
    rows = {r["path"]: r for r in assets.collect()}
    assert sorted(rows) == ["a/b/c/y.png", "a/x.JPG", "z.jpeg", "z.webp"]
    stat = os.stat(tmp_path / "one/a/x.JPG")
    assert (rows["a/x.JPG"]["size"], rows["a/x.JPG"]["mtime"], rows["a/x.JPG"]["ctime"]) == (7, stat.st_mtime, stat.st_ctime)
    assert [(r["backend"], r["path"]) for r in errors.collect()] == [("gone", None)]
    assert sorted(r["path"] for r in roots.list_roots(spark, wanted, recursive=False)[0].collect()) == ["z.jpeg", "z.webp"]

    named = assets.withColumn("photo_id", F.concat_ws(":", "backend", "path"))
    os.remove(tmp_path / "one/z.webp")  # between listing and reading
    listed = spark.createDataFrame([(f"one:{p}", r["abs_path"]) for p, r in rows.items()], "photo_id string, abs_path string")
    asked = spark.createDataFrame([("one:a/x.JPG",), ("one:z.webp",), ("one:none",), ("one:a/x.JPG",)], "id string")
    got = {r["photo_id"]: (bytes(r["content"]) if r["content"] else None, r["error"] and r["error"][:9]) for r in roots.asset_bytes(listed, asked).collect()}
    assert got == {"one:a/x.JPG": (b"a/x.JPG", None), "one:z.webp": (None, "[Errno 2]"), "one:none": (None, "unknown")}
    assert named.count() == 3


def test_roots_stream(spark, tmp_path):
    """A file comes once, and again when it has changed."""
    from photarium.sources import roots

    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = roots.root_stream(spark, {"r": str(folder)}, settleSeconds=0, shares=2)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"], r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a.jpg").write_bytes(b"1")
    assert run() == [("a.jpg", 1)]
    (folder / "b.png").write_bytes(b"22")
    assert run() == [("a.jpg", 1), ("b.png", 2)]
    (folder / "a.jpg").write_bytes(b"333")
    assert run() == [("a.jpg", 1), ("a.jpg", 3), ("b.png", 2)]


def test_breaker(spark):
    """Three failures in a row stop the partition; one in between doesn't."""
    rows = [(k, "bad" if k in (1, 3, 4, 6, 7, 8) else "ok") for k in range(12)]
    df = spark.createDataFrame(rows, "key int, content string").coalesce(1)

    def load():
        def one(text):
            if text == "bad":
                raise ValueError("no image")
            return [1.0]

        return one

    got = {r["key"]: (r["vector"] is not None, r["error"]) for r in vectors.encode(df, load, "key", "content").collect()}
    assert [k for k, v in got.items() if v[0]] == [0, 2, 5] and all(got[k][1] == "no image" for k in (1, 3, 4, 6, 7, 8))
    assert all(got[k] == (False, "skipped: too many failures in a row") for k in (9, 10, 11))


def test_group_orders(spark):
    rows = [("a", "Zed", "character", 3, "2024-01-02"), ("b", "alf", "person", 5, "2024-01-01"), ("c", "Bo", "character", 5, "2024-01-03")]
    view = spark.createDataFrame(rows, "id string, name string, type string, n_assets long, created_at string")
    orders = {"count_desc": "bca", "count_asc": "abc", "name_asc": "bca", "name_desc": "acb", "updated_desc": "cab"}
    assert {o: "".join(r["id"] for r in sort_groups(view, o).collect()) for o in orders} == orders
    assert [r["id"] for r in sort_groups(view, "name_asc", "character", "Z").collect()] == ["a"]


def test_catalog_lists(spark):
    from photarium.functions.labels import human_categories

    names = [r["category"] for r in human_categories(spark).orderBy("position").collect()]
    assert len(names) == 23 and names[0] == "兽装人物" and names[-1] == "室外"
