"""Identity: clustering, incremental assignment, candidate pairs, curation by decision logs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.operators.graph import connected_components
from photarium.operators.vectors import PRODUCT, centroids, matrix_of, units
from photarium.operators.threshold import threshold_links, threshold_pairs
from photarium.sources.scratch import materialize

#: embedding type -> (eps, metric)
CLUSTERING = {"face": (0.4, "cosine"), "legacy": (0.3, "cosine"), "primary": (0.6481, "euclidean")}
KEY = ["image_path", "detection_index"]
#: Components of all group representatives together that go to the tasks as one matrix.
REPRESENTATIVES = 8_000_000
#: Groups that one window may number; more are numbered by ranges.
SERIALS = 1_000_000


def new_group_id(*key: str) -> Column:
    """Deterministic id of a group from its founding detection."""
    return F.substring(F.sha2(F.concat_ws(":", *key), 256), 1, 16)


def dbscan_min1(vectors: DataFrame, key: str, vec: str, eps: float, metric: str = "cosine") -> DataFrame:
    """``vertex, component``: density clusters with min_samples = 1.

    Every point is then a core point, so clusters are the connected components
    of the eps graph and there is no noise. Euclidean eps on unit vectors is
    cosine 1 - eps**2 / 2.
    """
    minimum = 1 - eps if metric == "cosine" else 1 - eps * eps / 2
    return connected_components(vectors.select(key), threshold_links(vectors, key, vec, minimum))


def cluster_type(detections: DataFrame, embedding_type: str, key: str = "vec_id") -> DataFrame:
    """Clusters of one embedding type; clustering all types at once is refused."""
    if embedding_type not in CLUSTERING:
        raise ValueError(f"embedding type must be one of {sorted(CLUSTERING)}")
    eps, metric = CLUSTERING[embedding_type]
    return dbscan_min1(detections.where(F.col("embedding_type") == embedding_type), key, "embedding", eps, metric)


def incremental_assign(detections: DataFrame, embedding_type: str, threshold: float = 0.79, margin: float = 0.02, keys: list[str] = KEY) -> DataFrame:
    """Decision of each unassigned detection of a type against the group centroids as they stand; see ``assign``."""
    typed = detections.where(F.col("embedding_type") == embedding_type)
    reps = centroids(typed.where("group_id <> ''"), "group_id")
    return assign(typed.where("group_id = ''").select(*keys, "embedding"), reps, threshold, margin, keys)


def assign(pending: DataFrame, reps: DataFrame, threshold: float = 0.79, margin: float = 0.02, keys: list[str] = KEY) -> DataFrame:
    """Decision of each row of ``pending`` (keys, embedding) against ``reps`` (group_id, centroid).

    Best cosine below ``threshold`` or no groups: ``create`` (own new group);
    best minus second below ``margin``: ``conflict`` (stays unassigned); else
    ``join``. New groups are not representatives within the pass. A vector meets
    the centroids of its own length; one that is null, empty or not finite can't
    be judged and is ``skip`` (stays unassigned).
    Columns: keys, decision, group_id, top_group, top_cos, second_group,
    second_cos (cosines rounded to 4).
    """
    reps = materialize(reps.select("group_id", "centroid"), "representatives")
    if (reps.agg(F.sum(F.size("centroid")).alias("n")).first()["n"] or 0) <= REPRESENTATIVES:
        ranked = _two_best_by_matrix(pending, reps, keys)
    else:
        ranked = _two_best_in_blocks(pending, reps, keys)
    top, second = F.get(F.col("best"), F.lit(0)), F.get(F.col("best"), F.lit(1))
    decision = F.when(F.col("best").isNull(), "skip").when(top.isNull() | (top["cos"] < threshold), "create").when(second.isNotNull() & (top["cos"] - second["cos"] < margin), "conflict").otherwise("join")
    return ranked.select(*keys, decision.alias("decision"), top["g"].alias("top_group"), F.round(top["cos"], 4).alias("top_cos"), second["g"].alias("second_group"), F.round(second["cos"], 4).alias("second_cos")).select(
        *keys, "decision", F.when(F.col("decision") == "join", F.col("top_group")).when(F.col("decision") == "create", new_group_id(*keys)).otherwise("").alias("group_id"), "top_group", "top_cos", "second_group", "second_cos"
    )


_BEST = pa.list_(pa.struct([("g", pa.string()), ("cos", pa.float64())]))
_BEST_DDL = "array<struct<g:string,cos:double>>"


def _by_length(reps: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centroids as ``{length: (names, unit rows)}``, names ascending."""
    out, reps = {}, reps.combine_chunks().sort_by("group_id")
    sizes = pc.list_value_length(reps["centroid"]).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):  # null sizes are nan
        some = reps.filter(pa.array(sizes == n))
        out[int(n)] = some["group_id"].to_numpy(zero_copy_only=False), units(matrix_of(some["centroid"], int(n)))
    return out


def _best_of_batch(column: pa.Array, held: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[list[dict] | None]:
    """The two best centroids of each vector of an Arrow batch, None for a vector that can't be judged; a product has PRODUCT cells at most."""
    out: list[list[dict] | None] = [None] * len(column)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        x = matrix_of(column.take(pa.array(rows)), int(n))
        good = np.isfinite(x).all(axis=1)
        rows, x = rows[good], units(x[good])
        names, sides = held.get(int(n), (np.zeros(0, object), np.zeros((0, int(n)))))
        step = max(1, PRODUCT // max(1, len(names)))
        for k in range(0, len(rows), step):
            cos = x[k : k + step] @ sides.T
            at, found = np.arange(len(cos)), [[] for _ in range(len(cos))]
            for _ in range(min(2, len(names))):
                top = cos.argmax(axis=1)  # of equals the smallest id
                for i, t in enumerate(top):
                    found[i].append({"g": names[t], "cos": float(cos[i, t])})
                cos[at, top] = -np.inf
            for i, r in enumerate(rows[k : k + step]):
                out[r] = found[i]
    return out


def _two_best_by_matrix(pending: DataFrame, reps: DataFrame, keys: list[str]) -> DataFrame:
    """Two best groups of each pending row by products against all centroids: nothing is shuffled. The size of ``reps`` has been checked."""
    held = _by_length(reps.toArrow())

    def rank(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(_best_of_batch(batch.column(len(keys)), held), _BEST)], names=[*keys, "best"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in pending.select(*keys).dtypes)
    return pending.select(*keys, "embedding").mapInArrow(rank, f"{kinds}, best {_BEST_DDL}")


def _two_best_in_blocks(pending: DataFrame, reps: DataFrame, keys: list[str], block: int | None = None) -> DataFrame:
    """The same for more centroids than fit one matrix: blocks of rows against blocks of centroids, the two best of each merged."""
    block = block or REPRESENTATIVES
    parts = max(1, -(-int(reps.agg(F.sum(F.size("centroid"))).first()[0] or 0) // block))
    size = reps.agg(F.max(F.size("centroid"))).first()[0] or 1
    rows = materialize(pending.select(*keys, "embedding").withColumn("row_no", F.monotonically_increasing_id()), "pending")
    own = max(1, -(-rows.count() * size // block))
    left = rows.withColumn("p", F.pmod(F.xxhash64("row_no"), F.lit(own))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("p", "r", "row_no", "embedding")
    right = reps.withColumn("r", F.pmod(F.xxhash64("group_id"), F.lit(parts)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(own - 1).cast("long"))))

    def rank(some: pa.Table, centroids: pa.Table) -> pa.Table:
        held = _by_length(centroids.select(["group_id", "centroid"]))
        column = some["embedding"].combine_chunks()
        return pa.table({"row_no": some["row_no"], "best": pa.array(_best_of_batch(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, held), _BEST)})

    found = left.groupBy("p", "r").cogroup(right.groupBy("p", "r")).applyInArrow(rank, f"row_no long, best {_BEST_DDL}")
    flat = found.where("best IS NOT NULL").select("row_no", F.explode_outer("best").alias("b"))
    place = F.row_number().over(Window.partitionBy("row_no").orderBy(F.desc("b.cos"), "b.g"))
    merged = flat.withColumn("rn", place).where("rn <= 2").groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("rn", "b"))).alias("rs"))
    best = merged.select("row_no", F.transform(F.filter("rs", lambda x: x["b"].isNotNull()), lambda x: x["b"]).alias("best"))
    return rows.join(best, "row_no", "left").select(*keys, "best")


def apply_assignment(detections: DataFrame, decisions: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Detections with the group ids of ``decisions`` filled in; others unchanged."""
    new = decisions.where("group_id <> ''").select(*keys, F.col("group_id").alias("new_group"))
    return detections.join(new, keys, "left").withColumn("group_id", F.coalesce("new_group", "group_id")).drop("new_group").select(*detections.columns)


def candidate_pairs(detections: DataFrame, excluded: DataFrame | None = None, min_sim: float = 0.60, limit: int | None = 200) -> DataFrame:
    """``a, b, similarity`` of the ``limit`` best group pairs (None: all) by centroid cosine, best first.

    Groups without primary detections don't take part; ``excluded`` (a, b in
    either order) holds pairs that a person has told apart.
    """
    reps = centroids(detections.where("embedding_type = 'primary' AND group_id <> ''"), "group_id")
    pairs = threshold_pairs(reps, "group_id", "centroid", min_sim)
    if excluded is not None:
        pairs = pairs.join(sorted_pairs(excluded), ["a", "b"], "left_anti")
    pairs = pairs.orderBy(F.desc("similarity"), "a", "b")
    return pairs if limit is None else pairs.limit(limit)


def sorted_pairs(pairs: DataFrame) -> DataFrame:
    a, b = pairs.columns[:2]
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def add_not_same(pairs: DataFrame, groups: DataFrame, new: DataFrame) -> DataFrame:
    """Decision log with ``new`` pairs: order-free, idempotent; unknown groups and a = b are refused."""
    known = groups.select(F.col("id"))
    valid = sorted_pairs(new).join(known.select(F.col("id").alias("a")), "a", "left_semi").join(known.select(F.col("id").alias("b")), "b", "left_semi")
    return pairs.select("a", "b").union(valid.select("a", "b")).distinct()


def merge_direction(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``target, source``: the larger group keeps its id, a tie keeps ``a``."""
    n = counts.select(F.col("group_id"), F.col("n"))
    both = pairs.join(n.select(F.col("group_id").alias("a"), F.col("n").alias("na")), "a", "left").join(n.select(F.col("group_id").alias("b"), F.col("n").alias("nb")), "b", "left")
    swap = F.coalesce("nb", F.lit(0)) > F.coalesce("na", F.lit(0))
    return both.select(*pairs.columns, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("target"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("source"))


def merge_groups(detections: DataFrame, groups: DataFrame, target: str, sources: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(detections, groups, log)`` after moving the members of ``sources`` to ``target``.

    Refused: an empty target, the target among the sources, missing groups,
    another type, other embedding types where both sides have members. The log
    has one row per source with its columns and member keys, for undo.
    """
    sources = list(dict.fromkeys(sources))
    if not target or not sources or target in sources:
        raise ValueError("target must be named and not among the sources")
    ids = [target, *sources]
    facts = {r["id"]: r["type"] for r in groups.where(F.col("id").isin(ids)).select("id", "type").collect()}  # one row a named group
    if set(facts) != set(ids):
        raise ValueError(f"missing groups: {sorted(set(ids) - set(facts))}")
    if len(set(facts.values())) > 1:
        raise ValueError("groups of different types")
    kinds = {r["group_id"]: set(r["kinds"]) for r in detections.where(F.col("group_id").isin(ids)).groupBy("group_id").agg(F.collect_set("embedding_type").alias("kinds")).collect()}
    mine = kinds.get(target, set())
    if any(mine and kinds.get(s) and kinds[s] != mine for s in sources):
        raise ValueError("groups of different embedding types")
    members = detections.where(F.col("group_id").isin(sources)).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("members"))
    log = groups.where(F.col("id").isin(sources)).join(members, F.col("id") == F.col("group_id"), "left").drop("group_id").withColumn("target", F.lit(target))
    moved = detections.withColumn("group_id", F.when(F.col("group_id").isin(sources), F.lit(target)).otherwise(F.col("group_id")))
    return moved, groups.where(~F.col("id").isin(sources)), log


def undo_merge(detections: DataFrame, groups: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(detections, groups)`` before the logged merge: recorded members that are still in the target go back."""
    row = log.select("target").limit(1).collect()
    if not row:
        raise ValueError("no merge on record")
    target = row[0]["target"]
    if not groups.where(F.col("id") == target).limit(1).count():
        raise ValueError("the target is gone")
    back = log.select(F.col("id").alias("source"), F.explode("members").alias("m")).select("source", *(F.col(f"m.{k}").alias(k) for k in KEY))
    undone = detections.join(back, KEY, "left").withColumn("group_id", F.when((F.col("group_id") == target) & F.col("source").isNotNull(), F.col("source")).otherwise(F.col("group_id"))).select(*detections.columns)
    restored = groups.unionByName(log.select(*groups.columns).join(groups.select("id"), "id", "left_anti").select(*groups.columns))
    return undone, restored


def prune_decisions(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """Decisions that touch no group of ``gone`` (column id)."""
    return pairs.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti").select(*pairs.columns)


def create_groups(detections: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return detections.select(new_group_id(*keys).alias("id"), F.lit("").alias("name")).distinct()


EDITABLE = ("name", "description", "cover_image")


def apply_edits(groups: DataFrame, edits: DataFrame) -> DataFrame:
    """Groups with the latest edit of each whitelisted field; ``edits``: id, field, value, seq."""
    for field in EDITABLE:
        if field in groups.columns:
            last = edits.where(F.col("field") == field).groupBy("id").agg(F.max_by("value", "seq").alias("new_value"))
            groups = groups.join(last, "id", "left").withColumn(field, F.coalesce("new_value", field)).drop("new_value").select(*groups.columns)
    return groups


def delete_groups(detections: DataFrame, groups: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(F.col(gone.columns[0]).alias("id"))
    return detections.join(ids.select(F.col("id").alias("group_id")), "group_id", "left_anti").select(*detections.columns), groups.join(ids, "id", "left_anti").select(*groups.columns)


def drop_empty_groups(groups: DataFrame, detections: DataFrame) -> DataFrame:
    return groups.join(detections.select(F.col("group_id").alias("id")), "id", "left_semi").select(*groups.columns)


def upsert_detections(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same (image_path, detection_index); of equal keys in one batch the most confident row stays."""
    order = [F.desc("confidence")] if "confidence" in new.columns else []
    own = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order, F.xxhash64(*new.columns)))
    return old.join(new.select(*KEY), KEY, "left_anti").select(*old.columns).unionByName(new.withColumn("rn_", own).where("rn_ = 1").drop("rn_"), allowMissingColumns=True)


def complete_assets(batch: DataFrame, expected: DataFrame) -> DataFrame:
    """Detections of assets whose rows all arrived; ``expected``: image_path, n."""
    whole = batch.groupBy("image_path").count().join(expected, "image_path").where("count = n").select("image_path")
    return batch.join(whole, "image_path", "left_semi").select(*batch.columns)


def remove_detections(detections: DataFrame, gone: DataFrame) -> DataFrame:
    """Anti join on the columns of ``gone``: image_path, or image_path and detection_index."""
    return detections.join(gone, gone.columns, "left_anti").select(*detections.columns)


def group_serials(groups: DataFrame) -> DataFrame:
    """``id, serial``: newest group of each type is 1."""
    order = [F.desc("created_at"), F.desc("id")]
    rows = groups.select("id", "type", "created_at")
    if rows.limit(SERIALS + 1).count() <= SERIALS:
        return rows.select("id", F.row_number().over(Window.partitionBy("type").orderBy(*order)).alias("serial"))
    # Two types hold all groups, so they are numbered by ranges: own place in the range plus the ranges before.
    ranged = materialize(rows.repartitionByRange("type", *order).withColumn("part", F.spark_partition_id()), "ranged-groups")
    sizes = ranged.groupBy("type", "part").agg(F.count("*").alias("n"))  # some rows a partition
    before = sizes.select("type", "part", F.coalesce(F.sum("n").over(Window.partitionBy("type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("type", "part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), ["type", "part"]).select("id", (F.col("before") + F.col("inside")).cast("int").alias("serial"))


def best_per_group(detections: DataFrame) -> DataFrame:
    """Best detection of each group in an asset, by confidence and then index."""
    w = Window.partitionBy("image_path", "group_id").orderBy(F.desc("confidence"), "detection_index")
    return detections.where("group_id <> ''").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def group_counts(detections: DataFrame) -> DataFrame:
    """``group_id, n_assets, n_detections`` of assigned detections."""
    return detections.where("group_id <> ''").groupBy("group_id").agg(F.countDistinct("image_path").alias("n_assets"), F.count("*").alias("n_detections"))


def asset_group_counts(detections: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    rows = detections.where("group_id <> ''")
    if paths is not None:
        rows = rows.join(paths.select("image_path"), "image_path", "left_semi")
    return rows.groupBy("image_path").agg(F.countDistinct("group_id").alias("n_groups"))


def default_covers(detections: DataFrame, order: list[str]) -> DataFrame:
    """``group_id, cover``: earliest member."""
    return detections.where("group_id <> ''").groupBy("group_id").agg(F.min_by("image_path", F.struct(*order)).alias("cover"))


def group_view(detections: DataFrame, groups: DataFrame, order: list[str]) -> DataFrame:
    """One row per group with members: paths (distinct, in order), sources, counts, cover."""
    members = detections.where("group_id <> ''").groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, "image_path"))).alias("rows"), F.array_sort(F.collect_set("embedding_type")).alias("source_types"), F.countDistinct("image_path").alias("n_assets"), F.count("*").alias("n_detections")
    )
    paths = F.array_distinct(F.transform("rows", lambda r: r["image_path"]))
    return groups.join(members, groups["id"] == members["group_id"]).select("id", "name", "type", paths.alias("paths"), "source_types", "n_assets", "n_detections", F.get(paths, F.lit(0)).alias("cover"), "created_at")


def asset_first_group(detections: DataFrame, groups: DataFrame) -> DataFrame:
    """``image_path, group_id``: first group of an asset in the list order (members desc, newest, id)."""
    listed = groups.join(group_counts(detections), groups["id"] == F.col("group_id")).select("group_id", "n_assets", "created_at")
    rows = detections.where("group_id <> ''").select("image_path", "group_id").distinct().join(listed, "group_id")
    first = F.row_number().over(Window.partitionBy("image_path").orderBy(F.desc("n_assets"), F.desc("created_at"), "group_id"))
    return rows.withColumn("first", first).where("first = 1").select("image_path", "group_id")


def validate_detections(rows: DataFrame, dim: int = 512) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``; rejects carry ``reason``."""
    from photarium.operators.vectors import l2_norm

    box, v = F.col("bbox"), F.col("embedding")
    reason = (
        F.when(box.isNull() | (F.size(box) != 4) | F.exists(box, lambda x: x != F.floor(x)) | (F.get(box, F.lit(0)) >= F.get(box, F.lit(2))) | (F.get(box, F.lit(1)) >= F.get(box, F.lit(3))), "box")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence")
        .when(v.isNull() | (F.size(v) != dim), "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)), "not finite")
        .when(F.abs(l2_norm(v) - 1) > 1e-3, "norm")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def unnamed_groups(groups: DataFrame) -> DataFrame:
    return groups.where(F.trim(F.coalesce("name", F.lit(""))) == "")


def merge_with_covers(detections: DataFrame, groups: DataFrame, pairs: DataFrame, target: str, sources: list[str], order: list[str] = KEY) -> dict[str, DataFrame]:
    """``merge_groups`` over everything that hangs on the groups: ``detections, groups, pairs, log``.

    ``groups`` has cover_image. A target without a cover ('' or null) gets the
    first of its members after the merge, by ``order``; decisions that touch a merged group
    go from ``pairs``; the log also keeps the target's cover as it was, for
    ``undo_with_covers``.
    """
    moved, left, log = merge_groups(detections, groups, target, sources)
    cover = default_covers(moved.where(F.col("group_id") == target), order)
    bare = (F.col("id") == target) & (F.coalesce("cover_image", F.lit("")) == "")
    filled = left.join(cover.withColumnRenamed("group_id", "id"), "id", "left").withColumn("cover_image", F.when(bare, F.coalesce("cover", F.lit(""))).otherwise(F.col("cover_image"))).select(*left.columns)
    before = groups.where(F.col("id") == target).select(F.col("id").alias("target"), F.col("cover_image").alias("target_cover"))
    return {"detections": moved, "groups": filled, "pairs": prune_decisions(pairs, log.select("id")), "log": log.join(before, "target")}


def undo_with_covers(detections: DataFrame, groups: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``undo_merge``, and the target has the cover it had before."""
    undone, restored = undo_merge(detections, groups, log.drop("target_cover"))
    old = log.select(F.col("target").alias("id"), F.coalesce("target_cover", F.lit("")).alias("old_cover"), F.lit(1).alias("was")).distinct()
    back = restored.join(old, "id", "left").withColumn("cover_image", F.when(F.col("was") == 1, F.col("old_cover")).otherwise(F.col("cover_image")))
    return undone, back.select(*restored.columns)
