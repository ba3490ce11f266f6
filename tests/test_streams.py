"""Streams over several batches, restarts and replays."""

import glob
import os
import shutil


from photarium.streaming import jobs
from photarium.streaming.tables import KeyedTable

DET = "image_path string, detection_index int, embedding_type string, group_id string, embedding array<double>"


def feed(spark, src, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def pending(*rows):
    return [(path, 0, "primary", "", [float(x) for x in v]) for path, v in rows]


def test_assign_stream_learns(spark, tmp_path):
    """Joins move a centroid, a new group is joined one batch later, a conflict is decided again, seen keys are not."""
    grouped = spark.createDataFrame([("s", 0, "primary", "A", [1.0, 0.0, 0.0]), ("f", 0, "face", "F", [0.0, 0.0, 1.0])], DET)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run(rows):
        stream = feed(spark, tmp_path / "in", rows, DET)
        jobs.assign_stream(stream, grouped, out, log, "primary", 0.79, 0.02, every=2).awaitTermination()
        return {r["image_path"]: (r["decision"], r["group_id"], r["top_group"]) for r in jobs.assigned(spark, out).collect()}

    first = run(pending(("a", (0.8, 0.6, 0)), ("b", (0, 1, 0)), ("c", (0.1, 0.995, 0))))
    assert first["a"] == ("join", "A", "A") and first["b"][0] == first["c"][0] == "create" and first["b"][1] != first["c"][1]
    # A is now (0.949, 0.316): this one was too far from it before, and b's group and c's are too much alike.
    second = run(pending(("d", (0.75, 0.66, 0)), ("e", (0.05, 0.9987, 0)), ("a", (0, 0, 1))))
    assert second["d"] == ("join", "A", "A") and second["e"][:2] == ("conflict", "") and second["a"] == first["a"]
    # The conflict is open until one of the two groups moves away.
    third = run(pending(("g", (0.5, 0.9, 0.2))))
    assert third["e"][0] in ("conflict", "join") and len(third) == 6
    fourth = run(pending(("h", (0, 0, 1)), ("i", (1, 0, 0))))
    assert fourth["h"][0] == "create" and run(pending(("k", (0, 0.1, 1))))["k"] == ("join", fourth["h"][1], fourth["h"][1])
    assert len(glob.glob(f"{out}/groups/changes/*")) <= 3 and len(glob.glob(f"{out}/groups/snapshot/*")) == 1 and len(glob.glob(f"{out}/open/*")) <= 2


def test_assign_stream_replay(spark, tmp_path):
    """A batch whose commit was lost runs again and leaves the same tables."""
    grouped = spark.createDataFrame([("s", 0, "primary", "A", [1.0, 0.0])], DET)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for rows in (pending(("a", (0.9, 0.3))), pending(("b", (0.8, 0.5)), ("c", (0, 1)))):
        stream = feed(spark, tmp_path / "in", rows, DET)
        jobs.assign_stream(stream, grouped, out, log).awaitTermination()
    table = lambda: sorted(map(str, KeyedTable(spark, f"{out}/groups", jobs.STATE, ["group_id", "size"]).read().collect()))
    before = table(), sorted(map(str, jobs.assigned(spark, out).collect()))
    last = max(glob.glob(f"{log}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    jobs.assign_stream(spark.readStream.schema(DET).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), grouped, out, log).awaitTermination()
    assert (table(), sorted(map(str, jobs.assigned(spark, out).collect()))) == before


def test_latest_table_folds(spark, tmp_path):
    schema, rows, kept = "doc_id long, human_category string, seq long", [], {}
    for batch in range(6):
        new = [(k, f"{batch}-{k}", (batch * 7 + k * 5) % 11 + 3 * batch) for k in range(batch % 3, 6)]
        rows += new
        stream = feed(spark, tmp_path / "in", new, schema)
        jobs.latest_table_stream(stream, str(tmp_path / "out"), str(tmp_path / "log"), every=2).awaitTermination()
        for k, v, seq in new:
            kept[k] = max(kept.get(k, (-1, "")), (seq, v))
        got = {r["doc_id"]: (r["seq"], r["human_category"]) for r in jobs.latest_table(spark, str(tmp_path / "out"), schema, every=2).read().collect()}
        assert got == kept
        assert len(glob.glob(f"{tmp_path}/out/changes/*")) <= 3 and len(glob.glob(f"{tmp_path}/out/snapshot/*")) <= 1


def test_keyed_table_cut_short(spark, tmp_path):
    """A fold without its mark doesn't count and is done again; earlier states stay readable for a replay."""
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], every=2)
    frame = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    read = lambda before=1 << 62: {r["k"]: r["v"] for r in table.read(before).collect()}
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c")], [(3, None)]]):
        table.fold(n)
        table.write(n, frame(*rows))
    assert read() == {1: "a", 2: "c", 3: None} and read(2) == {1: "a", 2: "c"}
    os.remove(tmp_path / "t/snapshot/version=1/_SUCCESS")
    table.write(0, frame((1, "a"), (2, "b")))
    table.write(1, frame((2, "c")))
    table.fold(3)
    assert read() == {1: "a", 2: "c", 3: None} and len(os.listdir(tmp_path / "t/snapshot")) >= 1
    shutil.rmtree(tmp_path / "t")
    assert read() == {}


def test_ingest_stream_state(spark, tmp_path):
    """Replays change nothing, late copies lose, rows without a hash all stay, expired contents are first again."""
    import time

    schema, out, log = "doc_id long, md5 string", str(tmp_path / "out"), str(tmp_path / "log")

    def run(rows, **more):
        stream = feed(spark, tmp_path / "in", rows, schema)
        jobs.ingest_stream(stream, out, log, **more).awaitTermination()
        return sorted((r["doc_id"], r["md5"]) for r in spark.read.schema(schema).parquet(out).select("doc_id", "md5").collect())

    assert run([(5, "a"), (4, "a"), (7, None), (8, None)], ttl_ms=3_600_000) == [(4, "a"), (7, None), (8, None)]
    assert run([(1, "a"), (9, "b")], ttl_ms=3_600_000) == [(4, "a"), (7, None), (8, None), (9, "b")]
    last = max(glob.glob(f"{log}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    os.remove(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc")
    assert run([(2, "b")], ttl_ms=3_600_000) == [(4, "a"), (7, None), (8, None), (9, "b")]
    out, log = str(tmp_path / "short"), str(tmp_path / "short-log")
    first = run([(20, "c")], ttl_ms=1)
    time.sleep(0.1)
    assert (20, "c") in first and (21, "c") in run([(21, "c")], ttl_ms=1)


def test_ingest_stream_without_expiry(spark, tmp_path):
    """Spark's own aggregation keeps the records, also of smaller keys that come late and of a replayed batch; no Python call a content."""
    schema, out, log = "doc_id long, md5 string", str(tmp_path / "out"), str(tmp_path / "log")

    def run(rows):
        query = jobs.ingest_stream(feed(spark, tmp_path / "in", rows, schema), out, log)
        query.awaitTermination()
        assert [s.operatorName for p in query.recentProgress for s in p.stateOperators if s.numRowsUpdated] [:1] == ["stateStoreSave"]
        return sorted((r["doc_id"], r["md5"]) for r in spark.read.schema(schema).parquet(out).select("doc_id", "md5").collect())

    first = [(4, "a"), (7, None), (8, None)]
    assert run([(5, "a"), (4, "a"), (7, None), (8, None)]) == first
    assert run([(1, "a"), (9, "b"), (7, None)]) == [*first, (9, "b")]
    last = max(glob.glob(f"{log}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    os.remove(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc")
    assert run([(2, "b"), (3, "c")]) == [(3, "c"), *first, (9, "b")]
