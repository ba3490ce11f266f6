"""Operator 13: a Merkle manifest whose nodes keep SHA-256 states before each child slot."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.sources.scratch import bounded, materialize

#: Children of a node.
FAN = 8
#: Levels that one task folds at once: its block has FAN ** LEVELS leaves.
LEVELS = 4
#: Rows of one small table (counts of ranges) that may be broadcast.
BROADCAST_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]


def _root(n: int, k: int) -> int:
    """The integer part of the k-th root of ``n``."""
    low, high = 0, 1 << (n.bit_length() // k + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**k <= n else (low, middle - 1)
    return low


# SHA-256 takes its constants from the fractions of square and cube roots of primes.
_START = np.array([_root(p << 64, 2) % (1 << 32) for p in _PRIMES[:8]], np.uint32)
_ROUND = np.array([_root(p << 96, 3) % (1 << 32) for p in _PRIMES], np.uint32)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_HALVES = np.arange(1 << 16)
#: 16 bits as four hexadecimal digits, in one word.
_HEX4 = sum(_DIGITS[(_HALVES >> s) & 15] << np.uint32(2 * s) for s in (0, 4, 8, 12)).astype(np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) each: SHA-256's step on n messages at once."""
    w = list(words)
    for k in range(16, 64):
        x, y = w[k - 15], w[k - 2]
        w.append(w[k - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[k - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for k in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[k] + w[k]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def fresh(n: int) -> np.ndarray:
    return np.repeat(_START[:, None], n, axis=1)


def hex_words(digests: np.ndarray) -> np.ndarray:
    """The hex text of digests (8, n) as one message block each: (16, n)."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2], out[1::2] = _HEX4[digests >> np.uint32(16)], _HEX4[digests & np.uint32(0xFFFF)]
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of ``blocks`` whole blocks, whose state is given."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    bits = np.asarray(blocks, np.uint64) * np.uint64(512)
    last[0], last[14], last[15] = 1 << 31, bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return compress(state, last)


def _resume(state: np.ndarray, words: np.ndarray, rows: np.ndarray) -> None:
    """Add a block to the states of some rows, in place."""
    if rows.all():
        state[:] = compress(state, words)
    elif rows.any():
        state[:, rows] = compress(state[:, rows], words[:, rows])


class Level:
    """One level of a block: parents of ``digests`` (8, n) with the state each had before each child."""

    def __init__(self, digests: np.ndarray):
        n = digests.shape[1]
        parents = -(-n // FAN)
        self.children = np.minimum(FAN, n - FAN * np.arange(parents))
        self.words = np.zeros((16, parents * FAN), np.uint32)
        self.words[:, :n] = hex_words(digests)
        state, self.before = fresh(parents), np.empty((FAN, 8, parents), np.uint32)
        for slot in range(FAN):
            self.before[slot] = state
            _resume(state, self.words[:, slot::FAN], self.children > slot)
        self.parents = finish(state, self.children)

    def climb(self, place: np.ndarray, own: np.ndarray, proof: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Digests of the parents of the children number ``place``, if those were ``own``; siblings are added to ``proof`` and ``blocks``."""
        parent, slot = place // FAN, place % FAN
        return climb(own, slot, self.children[parent], self.before[slot, :, parent].T, lambda k: self.words[:, parent * FAN + k], proof, blocks)


def climb(own: np.ndarray, slot: np.ndarray, children: np.ndarray, before: np.ndarray, words, proof: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Parents' digests: the state before the slot goes on with the replacement and the siblings to its right.

    ``words(k)``: the blocks of each parent's child k. All siblings enter the proof.
    """
    state = compress(before, hex_words(own))
    for k in range(FAN):
        there = k < children
        if not (there & (k != slot)).any():
            continue
        block = words(k)
        _resume(proof, block, there & (k != slot))
        blocks += there & (k != slot)
        _resume(state, block, there & (k > slot))
    return finish(state, children)


def _load(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Digests (8, n) of a column of 32-byte values."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, 8).T.astype(np.uint32)


def _bytes(digests: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(digests.T).astype(">u4").tobytes()
    return [flat[k : k + 32] for k in range(0, len(flat), 32)]


def _text(digests: np.ndarray) -> pa.Array:
    return pa.array([x.hex() for x in _bytes(digests)], pa.string())


def leaf_digest(fields: Sequence[str | Column] = FIELDS) -> Column:
    """32-byte SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    parts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.when(p.isNull(), "-").otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts)).cast("binary"), 256))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, the place in its ``tree`` by ``order``, and ``total``, the tree's size.

    Rows are dealt into ranges once; a range's own places are its row numbers,
    and what comes before it is a prefix sum over the ranges.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), name)
    ranges = ranged.groupBy("tree", "part").agg(F.min("at").alias("at0"), F.count("*").alias("n"))
    # A row a range and tree.
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = materialize(ranges.select("tree", "part", (before - F.col("at0")).alias("shift"), F.sum("n").over(whole).alias("total")), f"{name}-ranges")
    return ranged.join(bounded(ranges, BROADCAST_ROWS), ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).select(*rows.columns, "idx", "total")


def _grown(total: int, levels: int) -> int:
    """Levels that a block of a tree of ``total`` nodes still gets."""
    k = 0
    while k < levels and total > 1:
        total, k = -(-total // FAN), k + 1
    return k


_PATH = pa.list_(pa.struct([("slot", pa.int32()), ("before", pa.binary()), ("children", pa.list_(pa.binary()))]))
_PATH_DDL = "array<struct<slot:int,before:binary,children:array<binary>>>"


def _block_paths(levels: int):
    """For nodes of one block: the levels of their way up, and the block's top."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        digests, n, total = _load(table["digest"]), table.num_rows, table["total"][0].as_py()
        place, paths = np.arange(n), [[] for _ in range(n)]
        for _ in range(_grown(total, levels)):
            level, nodes = Level(digests), _bytes(digests)
            for k, p in enumerate(place):
                parent = p // FAN
                before = level.before[p % FAN, :, parent].astype(">u4").tobytes()
                paths[k].append({"slot": int(p % FAN), "before": before, "children": nodes[parent * FAN : parent * FAN + FAN]})
            place, digests, total = place // FAN, level.parents, -(-total // FAN)
        return pa.table({"tree": table["tree"], "idx": table["idx"], "block": table["block"], "path": pa.array(paths, _PATH), "digest": pa.array(_bytes(digests) * n, pa.binary()), "total": pa.array([total] * n, pa.int64())})

    return run


def _tops(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """``(paths, tops)`` of trees whose nodes are given as tree, idx, total, digest.

    paths: tree, idx, path; tops: tree, digest. A pass takes ``levels`` levels,
    one block of nodes a task, and leaves one node a block for the next pass.
    """
    paths = None
    while True:
        size = FAN**levels
        done = nodes.withColumn("block", F.floor(F.col("idx") / size)).groupBy("tree", "block").applyInArrow(_block_paths(levels), f"tree string, idx long, block long, path {_PATH_DDL}, digest binary, total long")
        done = materialize(done, "nodes")
        own = done.select("tree", F.col("idx").alias("low"), "path", F.col("block").alias("up"))
        if paths is None:
            paths = own
        else:
            above = done.select("tree", F.col("idx").alias("up"), F.col("path").alias("more"), F.col("block").alias("next"))
            paths = paths.join(above, ["tree", "up"]).select("tree", "low", F.concat("path", "more").alias("path"), F.col("next").alias("up"))
        nodes = done.groupBy("tree", F.col("block").alias("idx")).agg(F.min("digest").alias("digest"), F.min("total").alias("total"))
        if not done.where("total > 1").limit(1).count():
            return paths.select("tree", F.col("low").alias("idx"), "path"), nodes.select("tree", "digest")


def manifest(docs: DataFrame, by: str = "lang", id_col: str = "doc_id", fields: Sequence[str] = FIELDS, presented: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row: digests as hex text.

    A row's leaf is the hash of its ``fields``. The leaves of a value of ``by``
    ascend by id; every FAN consecutive nodes, the last run fewer, become the
    hash of their hex texts until one is left, the subroot. Subroots in the order
    of their values (null first, then by UTF-8 bytes) give the root likewise; a
    lone node is its own root. ``presented`` is what a reader holds in place of a
    row's leaf (a digest; null: the leaf itself); it is folded to the root with
    the siblings on record, and ``verified`` tells whether that is the root.
    ``proof_sha256`` is the hash of those siblings, from the leaf up.

    Each node keeps a copy of its hash state before each child, so folding goes
    on from there with the replacement and the siblings to its right; the proof's
    hash is a state that is carried along as well. Blocks of FAN ** ``levels``
    leaves are one group each, whatever the size of a tree, and the nodes above
    are folded block by block in further passes.

    Null fields count as ``-``; null ids come first; equal ids are ordered by
    leaf, and repeated rows are leaves of their own. Long texts are hashed whole.
    Other columns are not used. An empty table gives no rows.
    """
    tree = F.when(F.col(by).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(by).cast("string")))
    own = leaf_digest(fields)
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), own.alias("leaf"), (own if presented is None else F.coalesce(presented, own)).alias("shown"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = materialize(rows, "digests")  # texts are hashed once, ranges are found on digests
    placed = numbered(rows, ["doc_id", "leaf", "shown"], "leaves").withColumn("block", F.floor(F.col("idx") / FAN**levels))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        leaves, shown, n, total = _load(table["leaf"]), _load(table["shown"]), table.num_rows, table["total"][0].as_py()
        place, proof, blocks, digests = np.arange(n), fresh(n), np.zeros(n, np.int64), leaves
        for _ in range(_grown(total, levels)):
            level = Level(digests)
            shown = level.climb(place, shown, proof, blocks)
            place, digests, total = place // FAN, level.parents, -(-total // FAN)
        top = pa.array([*_bytes(digests), *[None] * (n - 1)], pa.binary())  # one node is left; its first row tells it
        return pa.table({"tree": table["tree"], "block": table["block"], "doc_id": table["doc_id"], "leaf": table["leaf"], "shown": pa.array(_bytes(shown), pa.binary()), "proof": pa.array(_bytes(proof), pa.binary()), "blocks": pa.array(blocks), "top": top, "total": pa.array([total] * n, pa.int64())})

    folded = placed.groupBy("tree", "block").applyInArrow(fold, f"tree string, block long, doc_id {kind}, leaf binary, shown binary, proof binary, blocks long, top binary, total long")
    folded = materialize(folded, "folded")
    nodes = folded.where("top IS NOT NULL").select("tree", F.col("block").alias("idx"), "total", F.col("top").alias("digest"))
    paths, subroots = _tops(nodes, levels)
    subroots = materialize(subroots, "subroots")
    ordered = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], "ordered")
    ordered = materialize(ordered, "numbered")
    above, root = _tops(ordered.select("tree", "idx", "total", "digest"), levels)
    roads = ordered.select(F.col("name").alias("tree"), "idx", F.col("digest").alias("subroot")).join(above.select("idx", F.col("path").alias("more")), "idx")
    held = root.select("digest").collect()  # one row, or none without documents
    roads = roads.drop("idx").withColumn("root", F.lit(bytes(held[0][0]) if held else None).cast("binary"))
    ways = paths.join(roads, "tree").select("tree", F.col("idx").alias("block"), F.concat("path", "more").alias("path"), "subroot", "root")

    def rise(table: pa.Table, way: pa.Table) -> pa.Table:
        n, shown, proof, blocks = table.num_rows, _load(table["shown"]), _load(table["proof"]), table["blocks"].to_numpy().copy()
        for step in way["path"][0].as_py():
            children = [_load(pa.array([x])) for x in step["children"]]
            words = [np.repeat(hex_words(c), n, axis=1) for c in children]
            same = lambda x: np.full(n, x)
            before = np.repeat(np.frombuffer(step["before"], ">u4").astype(np.uint32)[:, None], n, axis=1)
            shown = climb(shown, same(step["slot"]), same(len(children)), before, lambda k: words[k], proof, blocks)  # noqa: B023
        subroot, root = (_load(way[c].slice(0, 1)) for c in ("subroot", "root"))
        good = (shown == root).all(axis=0)
        return pa.table({"doc_id": table["doc_id"], "leaf": _text(_load(table["leaf"])), "subroot": pa.array(_text(subroot).to_pylist() * n, pa.string()), "root": pa.array(_text(root).to_pylist() * n, pa.string()), "proof_sha256": _text(finish(proof, blocks)), "folded_root": _text(shown), "verified": pa.array(good)})

    pairs = folded.drop("top", "total").groupBy("tree", "block").cogroup(ways.groupBy("tree", "block"))
    return pairs.applyInArrow(rise, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate("text", _UPPER, _LOWER)
    tampered = leaf_digest([*FIELDS[:-1], lower])
    return manifest(docs, presented=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered))


def _sql_levels(name: str, tree: str, levels: int) -> str:
    """Levels over ``{name}0(tree, i, n, h)`` and the folds of ``{name}f0(row_no, tree, i, cur, proof)``."""
    out = []
    for k in range(levels):
        a, b = f"{name}{k}", f"{name}{k + 1}"
        out.append(f"{b} AS MATERIALIZED (SELECT tree, i // 8 AS i, CASE WHEN n = 1 THEN 1 ELSE (n + 7) // 8 END AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY s.i)) END AS h FROM {a} s GROUP BY tree, n, s.i // 8)")
        out.append(f"""{name}f{k + 1} AS MATERIALIZED (SELECT f.row_no, f.tree, f.i // 8 AS i,
            CASE WHEN min(s.n) = 1 THEN min(f.cur) ELSE sha256(string_agg(CASE WHEN s.i = f.i THEN f.cur ELSE s.h END, '' ORDER BY s.i)) END AS cur,
            min(f.proof) || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i <> f.i), '') AS proof
            FROM {name}f{k} f JOIN {a} s ON s.tree = f.tree AND s.i // 8 = f.i // 8 GROUP BY f.row_no, f.tree, f.i)""")
    return ", ".join(out)


_SQL_DEEP, _SQL_WIDE = 9, 4  # up to 8 ** 9 documents a language, 8 ** 4 languages


def _sql_leaf(fields: Sequence[str]) -> str:
    one = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(one, fields))})"


#: CRC-32 of short ASCII texts, from its polynomial.
SQL_CRC = """crc_step AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps FROM (SELECT unnest(range(256)) AS n))"""


def sql_crc(text: str) -> str:
    """Expression over ``steps`` of crc_step."""
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


ORACLE = f"""
WITH {SQL_CRC},
leaves AS MATERIALIZED (SELECT row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS row_no, coalesce('v' || lang, 'n') AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, doc_id, leaf,
    CASE WHEN doc_id IS NOT NULL AND {sql_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN changed ELSE leaf END AS shown
    FROM (SELECT doc_id, lang, {_sql_leaf(FIELDS)} AS leaf, {_sql_leaf([*FIELDS[:-1], f"translate(text, '{_UPPER}', '{_LOWER}')"])} AS changed FROM documents), crc_step),
a0 AS MATERIALIZED (SELECT tree, i, n, leaf AS h FROM leaves),
af0 AS MATERIALIZED (SELECT row_no, tree, i, shown AS cur, '' AS proof FROM leaves),
{_sql_levels("a", "tree", _SQL_DEEP)},
b0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h, tree AS name FROM a{_SQL_DEEP}),
bf0 AS MATERIALIZED (SELECT f.row_no, '' AS tree, b.i, f.cur, f.proof FROM af{_SQL_DEEP} f JOIN b0 b ON b.name = f.tree),
{_sql_levels("b", "tree", _SQL_WIDE)}
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = r.h AS verified
FROM leaves l JOIN bf{_SQL_WIDE} f USING (row_no) JOIN b0 s ON s.name = l.tree, b{_SQL_WIDE} r
"""
