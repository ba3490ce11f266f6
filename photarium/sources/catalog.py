"""Asset catalogue: scans, change classification, result caches and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photarium.sources.scratch import materialize

#: Extension -> format.
FORMATS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "heic": "heic", "heif": "heic"}


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def with_reference(assets: DataFrame, backend: str = "backend", path: str = "path") -> DataFrame:
    """Adds photo_id, filename, extension, format, supported and uri."""
    p = normalise_path(F.col(path))
    ext = F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    formats = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return assets.withColumns({
        "photo_id": F.substring(F.sha2(F.concat_ws(":", F.col(backend), p), 256), 1, 16),
        "filename": F.element_at(F.split(p, "/"), -1),
        "extension": ext,
        "format": F.coalesce(formats[ext], F.lit("unknown")),
        "supported": formats[ext].isNotNull(),
        "uri": F.concat(F.col(backend), F.lit("://"), p),
    })


def scan_assets(spark: SparkSession, path: str, backend: str, exts: tuple[str, ...] = ("jpg", "jpeg", "png", "webp"), recursive: bool = False) -> DataFrame:
    """``backend, path, size, mtime`` of a directory's assets; contents are not read."""
    glob = "*.{" + ",".join(sorted({e for x in exts for e in (x.lower(), x.upper())})) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select(F.lit(backend).alias("backend"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def scan_roots(spark: SparkSession, roots: dict[str, str], **options) -> tuple[DataFrame, DataFrame]:
    """``(assets, errors)`` of named roots; an unreadable root becomes an error row."""
    frames, errors = [], []
    for backend, path in roots.items():
        try:
            frames.append(scan_assets(spark, path, backend, **options))
        except Exception as e:
            errors.append((backend, path, str(e).splitlines()[0][:200]))
    none = spark.createDataFrame([], "backend string, path string, size long, mtime timestamp")
    out = none
    for f in frames:
        out = out.unionByName(f)
    return out, spark.createDataFrame(errors, "backend string, path string, error string")


def read_assets(spark: SparkSession, assets: DataFrame, roots: list[str]) -> DataFrame:
    """``assets`` with ``content``: bytes by path."""
    files = spark.read.format("binaryFile").load(roots).select("path", "content")
    return assets.join(files, "path")


def classify_changes(current: DataFrame, previous: DataFrame, key: str, cmp_cols: list[str], report_gone: bool = False, force: bool = False) -> DataFrame:
    """``key, status``: new, updated or unchanged by ``cmp_cols`` against the last snapshot; gone as an option.

    ``force`` counts every current row as new.
    """
    if force:
        return current.select(key, F.lit("new").alias("status"))
    c = current.select(F.col(key).alias("ck"), F.struct(*cmp_cols).alias("cs"))
    p = previous.select(F.col(key).alias("pk"), F.struct(*cmp_cols).alias("ps"))
    both = c.join(p, c["ck"] == p["pk"], "full" if report_gone else "left")
    status = F.when(F.col("ck").isNull(), "gone").when(F.col("pk").isNull(), "new").when(F.col("cs").eqNullSafe(F.col("ps")), "unchanged").otherwise("updated")
    return both.select(F.coalesce("ck", "pk").alias(key), status.alias("status"))


def upsert(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return current.unionByName(previous.join(current.select(key), key, "left_anti").select(*previous.columns), allowMissingColumns=True)


def purge(assets: DataFrame, backend: str | None = None, photo_id: str | None = None) -> DataFrame:
    if backend is not None:
        assets = assets.where(F.col("backend") != backend)
    return assets if photo_id is None else assets.where(F.col("photo_id") != photo_id)


def backend_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("backend").agg(F.count("*").alias("n"))


def asset_date(name: str = "name", mtime: str = "mtime") -> Column:
    """YYYY-MM-DD from the name (date or epoch digits) or from mtime, in UTC."""
    base = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    dated = F.regexp_extract(base, r"^(\d{8})(?:[_-]\d{1,6})?$", 1)
    digits = base.rlike(r"^\d{10,}$")
    number = F.expr(f"try_cast(regexp_replace({name}, '\\\\.[^.]*$', '') AS BIGINT)")
    seconds = F.when(F.length(base) == 13, F.floor(number / 1000)).otherwise(number)
    usable = digits & seconds.between(0, 253402300799)
    from_name = F.when(dated != "", F.concat_ws("-", F.substring(dated, 1, 4), F.substring(dated, 5, 2), F.substring(dated, 7, 2))).when(usable, F.date_format(F.timestamp_seconds(F.when(usable, seconds)), "yyyy-MM-dd"))
    return F.coalesce(from_name, F.date_format(F.timestamp_seconds(F.col(mtime)), "yyyy-MM-dd"))


def load_result_cache(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, quarantine)`` of a JSON-lines cache; corrupt lines are set aside."""
    read = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    lines = spark.read.text(path)
    good = read.where("_corrupt IS NULL").drop("_corrupt")
    columns = ", ".join(f"{x.strip()}" for x in schema.split(","))
    parsed = lines.select("value", F.from_json("value", columns, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.expr("try_parse_json(value)").isNull().alias("bad"))
    return good, parsed.where("bad AND trim(value) <> ''").select("value")


def is_cache_hit(category: str = "category", override: str = "override") -> Column:
    return F.col(category).isNotNull() | F.col(override).isNotNull()


def upsert_keep_override(old: DataFrame, new: DataFrame, key: str, override_col: str) -> DataFrame:
    """Latest results; a row keeps the human override of the row it replaces."""
    kept = old.select(key, F.col(override_col).alias("kept_override"))
    joined = new.join(kept, key, "left").withColumn(override_col, F.coalesce("kept_override", override_col) if override_col in new.columns else F.col("kept_override")).drop("kept_override")
    return upsert(joined, old, key)


def set_override(cache: DataFrame, overrides: DataFrame, key: str, override_col: str = "override") -> DataFrame:
    """The cache with the human overrides set; a row is created for an asset that has none yet."""
    new = overrides.select(key, F.col(override_col).alias("new_override")).dropDuplicates([key])
    joined = cache.join(new, key, "full").withColumn(override_col, F.coalesce("new_override", override_col))
    return joined.select(*cache.columns)


def list_assets(assets: DataFrame, backend: str | None = None, limit: int = 100, offset: int = 0, key: str = "doc_id") -> DataFrame:
    """One page of a backend's assets (all without one), by key."""
    rows = assets if backend is None else assets.where(F.col("backend") == backend)
    return rows.orderBy(key).offset(offset).limit(limit)


def prune(cache: DataFrame, alive: DataFrame, key: str = "path", category: str = "category", override: str = "override") -> tuple[DataFrame, DataFrame]:
    """``(kept, counts)``: rows without an asset or without a result go.

    ``counts``: stale, empty, removed (either), kept.
    """
    marked = cache.join(alive.select(key, F.lit(True).alias("live")), key, "left").withColumns({"stale": F.col("live").isNull(), "empty": ~is_cache_hit(category, override)})
    counts = marked.agg(F.count_if("stale").alias("stale"), F.count_if("empty").alias("empty"), F.count_if(F.col("stale") | F.col("empty")).alias("removed"), F.count_if(~F.col("stale") & ~F.col("empty")).alias("kept"))
    return marked.where("NOT stale AND NOT empty").select(*cache.columns), counts


def add_favorites(favorites: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent: the first mark of a name stays."""
    return favorites.unionByName(new.join(favorites.select("name"), "name", "left_anti").dropDuplicates(["name"]))


def remove_favorites(favorites: DataFrame, gone: DataFrame) -> DataFrame:
    return favorites.join(gone.select("name"), "name", "left_anti").select(*favorites.columns)


def signature(*cols: str) -> Column:
    """Key of a job: its inputs and options as JSON, hashed."""
    return F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 20)


def ledger_todo(inputs: DataFrame, ledger: DataFrame, sig_cols: list[str]) -> DataFrame:
    """Inputs with ``job_key`` and ``state`` (start, resume) that no complete ledger row covers."""
    keyed = inputs.withColumn("job_key", signature(*sig_cols))
    state = ledger.groupBy("job_key").agg(F.max(F.col("complete").cast("int")).alias("done"))
    return keyed.join(state, "job_key", "left").where("done IS NULL OR done = 0").withColumn("state", F.when(F.col("done").isNull(), "start").otherwise("resume")).drop("done")


def provenance(outputs: DataFrame, ledger: DataFrame, name: str = "name") -> DataFrame:
    """Outputs named ``<job key>_<milliseconds>ms.<ext>`` joined with their ledger rows."""
    parsed = outputs.withColumns({"job_key": F.regexp_extract(name, r"([0-9a-f]{20})_(\d+)ms", 1), "at_ms": F.regexp_extract(name, r"([0-9a-f]{20})_(\d+)ms", 2)})
    return parsed.where("job_key <> ''").withColumn("at_ms", F.col("at_ms").cast("long")).join(ledger, "job_key")


def archive_plan(assets: DataFrame, categories: DataFrame, existing: DataFrame, target: str, key: str = "doc_id") -> DataFrame:
    """``key, dest, status``: copy, or duplicate of the target or of an earlier row.

    ``categories``: key, category (human override first). Equal names in a
    category get ``_1``, ``_2`` … in key order, counted on from the largest such
    suffix that a real name, of the batch or (column name, if there) of
    ``existing`` files of that category, has. No file is touched.
    """
    known = assets.join(existing.select("md5").distinct(), "md5", "left_semi").select(key, F.lit(None).cast("string").alias("dest"), F.lit("duplicate").alias("status"))
    # Assets without a hash stay in the anti join, each a content of its own.
    fresh = assets.join(existing.select("md5").distinct(), "md5", "left_anti").withColumn("content", F.coalesce(F.concat(F.lit("md5:"), "md5"), F.concat(F.lit("key:"), F.col(key).cast("string"))))
    firsts = fresh.groupBy("content").agg(F.min(key).alias(key)).select(key)
    repeats = fresh.join(firsts, key, "left_anti").select(key, F.lit(None).cast("string"), F.lit("duplicate"))
    named = fresh.join(firsts, key, "left_semi").join(categories.select(key, "category"), key, "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    # Names that are taken already start behind themselves, so a first asset gets a suffix as well.
    names = named.select("category", "name", F.lit(0).alias("taken"))
    if {"category", "name"} <= set(existing.columns):
        names = names.union(existing.select("category", "name", F.lit(1)))
    tail = F.regexp_extract("name", r"^(.*)_(\d{1,9})(\.[^.]*)?$", 2)
    used = names.withColumn("tail", tail).where("tail <> ''").withColumn("name", F.regexp_replace("name", r"_\d{1,9}(\.[^.]*)?$", "$1")).groupBy("category", "name").agg(F.max(F.col("tail").cast("int")).alias("used"))
    taken = names.where("taken = 1").select("category", "name", "taken").distinct()
    named = named.join(used, ["category", "name"], "left").join(taken, ["category", "name"], "left").withColumns({"used": F.coalesce("used", F.lit(0)), "taken": F.coalesce("taken", F.lit(0))})
    place = F.row_number().over(Window.partitionBy("category", "name").orderBy(key)) - 1 + F.col("taken")
    n = F.when(place == 0, 0).otherwise(place + F.col("used"))
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    dest = F.concat(F.lit(target + "/"), F.col("category"), F.lit("/"), F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), ext)))
    return named.withColumn("n", n).select(key, dest.alias("dest"), F.lit("copy").alias("status")).union(repeats).union(known)


def timeline_sample(df: DataFrame, key: str, t: str, interval: float) -> DataFrame:
    """First row of each ``interval`` of a keyed series; ``t`` in seconds, half-frame tolerance left to the caller."""
    cols = [c for c in df.columns if c != key]
    return df.withColumn("bin", F.floor(F.col(t) / interval)).groupBy(key, "bin").agg(F.min_by(F.struct(*cols), F.struct(t, *[c for c in cols if c != t])).alias("row")).select(key, "bin", *(F.col(f"row.{c}").alias(c) for c in cols))


def ordered_sample(df: DataFrame, key: str, t: str, interval: float, tolerance: float | str = 0.0, ties: list[str] | None = None) -> DataFrame:
    """Rows of keyed series that a player in order would take: ``df`` with ``sample_no`` and ``at_ms``.

    Sample k of a key is due at k * ``interval`` (``t`` in seconds from its
    beginning). Rows come by ``t`` and then ``ties``; a row is taken if it comes no
    earlier than ``tolerance`` (a number or a column; half a frame) before the next
    due time, and then the one after is due: behind a gap rows are taken one after
    the other until the samples have caught up.

    With c the number of due times that have passed at a row, and k of them taken
    before it, min(k + 1, c) are taken after it; so after row i it is i + 1 or less,
    i plus the least c - j of the rows j so far. That is a running minimum: rows
    are dealt into ranges of key and time once, and a range begins with the minimum
    of the ranges before, so one key may hold all rows. Null times are left out.
    """
    order = [key, t, *(ties or [])]
    ready = F.col(t).cast("double") + (F.col(tolerance) if isinstance(tolerance, str) else F.lit(float(tolerance)))
    c = F.floor(ready / interval) + 1
    # Division may round across a due time.
    c = F.greatest(F.lit(0), F.when(c * interval <= ready, c + 1).when((c - 1) * interval > ready, c - 1).otherwise(c)).cast("long")
    ranged = df.where(F.col(t).isNotNull()).withColumn("c_", c).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("part_", F.spark_partition_id()), "series")
    ranges = ranged.groupBy(key, "part_").agg(F.count("*").alias("n_"), F.min("row_").alias("row0_"), F.min(F.col("c_") - F.col("row_")).alias("low_"))
    earlier = Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)))
    least = F.min(F.col("low_") + F.col("row0_") - F.col("before_")).over(earlier)
    ranges = materialize(ranges.select(F.col(key).alias("key_"), "part_", (F.col("before_") - F.col("row0_")).alias("shift_"), least.alias("least_")), "ranges")
    placed = ranged.join(ranges, ranged[key].eqNullSafe(ranges["key_"]) & (ranged["part_"] == ranges["part_"])).drop(ranges["part_"])
    i = F.col("row_") + F.col("shift_")
    inside = Window.partitionBy("key_", "part_").orderBy("row_")

    def taken(frame) -> Column:
        """Rows taken by the end of ``frame``, less the number of the row behind it."""
        return F.least(F.lit(0), F.least("least_", F.min(F.col("c_") - i).over(frame)) - 1)

    before = i + F.when(i == 0, 0).otherwise(taken(inside.rowsBetween(Window.unboundedPreceding, -1)))
    after = i + 1 + taken(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = placed.withColumns({"sample_no": before, "after_": after}).where("after_ > sample_no")
    return rows.select(*df.columns, "sample_no", F.round(F.col(t) * 1000).cast("long").alias("at_ms"))


def list_favorites(favorites: DataFrame, limit: int | None = None) -> DataFrame:
    """Favourites, newest first; equal times by name."""
    rows = favorites.orderBy(F.desc("created_at"), "name")
    return rows if limit is None else rows.limit(limit)
