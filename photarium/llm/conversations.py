"""Operator 12: repair of conversations by integer-minimum paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.llm.merkle import SQL_CRC, sql_crc
from photarium.llm.tokens import text_batches
from photarium.sources.scratch import bounded, materialize

#: Rows and characters of a segment, the run of a conversation's rows that one step decides.
SEGMENT_ROWS, SEGMENT_CHARS = 2048, 1 << 20
#: Segments of an Arrow batch: most hold a few rows, some a million characters.
SEGMENTS_A_BATCH = 128
#: Narrow rows (one for each cut conversation and segment) that may be broadcast.
BROADCAST_ROWS = 100_000

DELETE, INSERT, RENAME, MEND = 2, 5, 1, 5
#: Digits of the audit letters, in ASCII order; 0 is the padding behind the last letter.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
_NAMES = {v: k for k, v in LETTERS.items()}
_BITS = 3
#: ``(s?(ua)+)?`` over role initials: 0 start, 1 behind s, 2 behind u, 3 behind a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, live``: the contract's damage; dropped rows stay with live = false, so that no conversation vanishes."""
    conv, turn, role, text = F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    word = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20
    text = F.when(fate == 0, "").when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), (fate != 0).alias("live"), F.when(fate == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "live", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("times")).drop("times")


def _gap(best: dict[int, tuple[int, int]], width: int) -> dict[int, tuple[int, int]]:
    """Up to two rows inserted: more would come back to a state they left."""
    layer = best
    for _ in range(2):
        more: dict[int, tuple[int, int]] = {}
        for q, (value, n) in layer.items():
            r = NEXT[q, "a" if q == 2 else "u"]
            found = (value + (INSERT << _BITS * width) + (LETTERS["I"] << _BITS * (width - 1 - n)), n + 1)
            if r not in more or found < more[r]:
                more[r] = found
        best, layer = {q: min(x[q] for x in (best, more) if q in x) for q in best.keys() | more.keys()}, more
    return best


def cheapest(classes: str, kinds: str, start: int = 0) -> tuple[dict[int, tuple[int, int]], int]:
    """``({state: (weight, letters)}, width)`` of the cheapest way through some rows to each state.

    ``classes``: a row's role initial, x for any but s, u and a; ``kinds``: n for
    a sound row, t truncated, b blank, d duplicate. A weight is one integer: the
    cost stands above ``width`` digits of _BITS bits, of which digit k (from the
    top) is the k-th audit letter and those behind the last letter are 0. So the
    smaller integer is the cheaper way and, of equal costs, the one with the
    ASCII-least audit. Two ways to one state of equal cost never differ by a
    longer audit only, since that costs its inserts; the minimum is thus exact.
    """
    width = 3 * len(classes) + 2
    high = _BITS * width
    best = {start: (0, 0)}
    for c, kind in zip(classes, kinds):
        after: dict[int, tuple[int, int]] = {}
        for q, (value, n) in _gap(best, width).items():
            low = _BITS * (width - 1 - n)
            ways = [(q, (DELETE << high) + (LETTERS["D"] << low))]
            if kind in "nt":
                extra = MEND if kind == "t" else 0
                if (q, c) in NEXT:
                    ways.append((NEXT[q, c], (extra << high) + (LETTERS["K"] << low)))
                ways.append((NEXT[q, "a" if q == 2 else "u"], (RENAME + extra << high) + (LETTERS["R"] << low)))
            for r, weight in ways:
                found = (value + weight, n + 1)
                if r not in after or found < after[r]:
                    after[r] = found
        best = after
    return best, width


def ended(best: dict[int, tuple[int, int]], width: int) -> tuple[int, int]:
    return min(v for q, v in _gap(best, width).items() if q in ENDS)


def audit_of(value: int, letters: int, width: int) -> str:
    return "".join(_NAMES[value >> _BITS * (width - 1 - k) & 7] for k in range(letters))


def replay(audit: str, classes: str, start: int = 0) -> list[tuple[int | None, str | None, str]]:
    """``(row, role, edit)`` of what an audit leaves: row None for inserts, role None where it stays."""
    out, q, row = [], start, 0
    for letter in audit:
        here, row = (None, row) if letter == "I" else (row, row + 1)
        if letter == "D":
            continue
        c = classes[here] if letter == "K" else "a" if q == 2 else "u"
        q = NEXT[q, c]
        out.append((here, None if letter == "K" else ROLES[c], letter))
    return out


_SEGMENT = pa.schema([("key", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("whole", pa.bool_()), ("classes", pa.string()), ("kinds", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())), ("turn_min", pa.int64()), ("turn_max", pa.int64()), ("turns", pa.int64())])
_SEGMENT_DDL = "key string, part long, seg long, whole boolean, classes string, kinds string, roles array<string>, texts array<string>, digests array<binary>, turn_min long, turn_max long, turns long"


def _kind(role: str, text: str, seen: set) -> str:
    last = text.rstrip(_SPACE)[-1:]
    if not last:
        return "b"
    if (role, text) in seen:
        return "d"
    seen.add((role, text))
    return "n" if last in ".!?" else "t"


def _cut(most_rows: int, most_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range as segments: one a conversation, or several of a long one.

    ``whole`` marks a conversation that is surely inside this range and in one segment.
    """
    part, seg, at, conv, pieces = TaskContext.get().partitionId(), 0, -1, None, 0
    rows: list[tuple] = []
    turns: list[int] = []
    size = 0

    def flush(whole: bool) -> dict:
        seen: set = set()
        kinds = "".join(_kind(r, t, seen) for r, t in rows)
        digests = None if whole else [hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() if k in "nt" else None for (r, t), k in zip(rows, kinds)]
        return {"key": conv, "part": part, "seg": seg, "whole": whole, "classes": "".join(r[:1] if r[:1] in {"s", "u", "a"} else "x" for r, _ in rows), "kinds": kinds, "roles": [r for r, _ in rows], "texts": [t for _, t in rows], "digests": digests, "turn_min": turns[0] if turns else None, "turn_max": turns[-1] if turns else None, "turns": len(turns)}

    for batch in batches:
        found = []
        for key, turn, role, text, live in zip(*(c.to_pylist() for c in batch.columns)):
            if key != conv or at < 0 or len(rows) >= most_rows or size >= most_chars:
                if at >= 0:
                    found.append(flush(key != conv and at > 0 and not pieces))
                    seg += 1
                same = at >= 0 and key == conv
                at, pieces, conv = at + (not same), pieces + 1 if same else 0, key
                rows, turns, size = [], [], 0
            if live:
                rows.append((role, text))
                size += len(text)
                if turn is not None and turn not in turns[-1:]:
                    turns.append(turn)
        if found:
            yield pa.RecordBatch.from_pylist(found, _SEGMENT)
    if at >= 0:
        yield pa.RecordBatch.from_pylist([flush(False)], _SEGMENT)


_COUNTS = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())]
_RESULT = pa.schema([("key", pa.string()), *_COUNTS, ("audit", pa.string()), ("repaired_sha256", pa.string())])
_COUNTS_DDL = ", ".join(f"{n} long" for n, _ in _COUNTS)


def _illegal(classes: str) -> int:
    return sum(classes[k : k + 2] not in LEGAL for k in range(len(classes) - 1))


def _gaps(low: int | None, high: int | None, n: int) -> int:
    return 0 if low is None else high - low + 1 - n


def _lines(audit: str, row: dict, start: int = 0) -> list[str]:
    return [f"{role or row['roles'][k]}:{'' if k is None else row['texts'][k]}" for k, role, _ in replay(audit, row["classes"], start)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of conversations of one segment."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            kinds = row["kinds"]
            best, width = cheapest(row["classes"], kinds)
            value, n = ended(best, width)
            audit = audit_of(value, n, width)
            out.append({"key": row["key"], "gaps": _gaps(row["turn_min"], row["turn_max"], row["turns"]), "blank": kinds.count("b"), "duplicate": kinds.count("d"), "truncated": kinds.count("t"), "illegal": _illegal(row["classes"]), "cost": value >> _BITS * width, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(_lines(audit, row)).encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(out, _RESULT)


_WAY = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())])
_SUMMARY = pa.schema([("key", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("ways", pa.list_(_WAY)), ("kinds", pa.string()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("turn_min", pa.int64()), ("turn_max", pa.int64()), ("turns", pa.int64())])
_SUMMARY_DDL = "key string, part long, seg long, ways array<struct<p:int,q:int,cost:long,rank:int>>, kinds string, first string, last string, illegal long, blank long, duplicate long, truncated long, turn_min long, turn_max long, turns long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment as one super-letter: cost and rank of the cheapest way from each state to each other.

    All ways through a segment use up the same rows and end on a row's letter, so
    none of their audits is a proper beginning of another, and ranks compare like
    the audits whatever comes behind.
    """
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            kinds = list(row["kinds"])
            for k in row["again"] or []:
                kinds[k] = "d"
            classes, kinds = row["classes"], "".join(kinds)
            ways = []
            for p in range(4):
                best, width = cheapest(classes, kinds, p)
                ways += [(p, q, value >> _BITS * width, value & (1 << _BITS * width) - 1) for q, (value, _) in best.items()]
            ranks = {low: k + 1 for k, low in enumerate(sorted({w[3] for w in ways}))}
            out.append({c: row[c] for c in ("key", "part", "seg", "turn_min", "turn_max", "turns")} | {"ways": [{"p": p, "q": q, "cost": c, "rank": ranks[low]} for p, q, c, low in ways], "kinds": kinds, "first": classes[:1], "last": classes[-1:], "illegal": _illegal(classes), "blank": kinds.count("b"), "duplicate": kinds.count("d"), "truncated": kinds.count("t")})
        yield pa.RecordBatch.from_pylist(out, _SUMMARY)


_RANK_BITS = 5


def cheapest_chain(segments: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[int]]:
    """``(cost, states)`` of the cheapest way through ``(p, q, cost, rank)`` of segments in order; states[k] is where segment k begins, the last where the rows end.

    The same integers once more: ranks are the digits, one a segment, and the
    inserts behind the last row are the last digit.
    """
    width = len(segments) + 1
    high = _RANK_BITS * width
    tails = [[(q, q, 0, 1) for q in ENDS] + [(2, 3, INSERT, 2), (1, 3, 2 * INSERT, 3)]]
    best, back = {0: 0}, []
    for k, ways in enumerate([*segments, *tails]):
        after: dict[int, tuple[int, int]] = {}
        for p, q, cost, rank in ways:
            if p in best:
                found = (best[p] + (cost << high) + (rank << _RANK_BITS * (width - 1 - k)), p)
                if q not in after or found < after[q]:
                    after[q] = found
        best = {q: v for q, (v, _) in after.items()}
        back.append({q: p for q, (_, p) in after.items()})
    q = min(best, key=lambda x: (best[x], x))
    value, states = best[q], []
    for step in reversed(back):
        q = step[q]
        states.append(q)
    return value >> high, states[::-1]


def _chain(table: pa.Table) -> pa.Table:
    """Of one cut conversation's summaries: where each segment begins and ends; the counts stand in its first row."""
    rows = table.sort_by([("part", "ascending"), ("seg", "ascending")]).to_pylist()
    cost, states = cheapest_chain([[(w["p"], w["q"], w["cost"], w["rank"]) for w in r["ways"]] for r in rows])
    illegal, last, n = sum(r["illegal"] for r in rows), "", 0
    low = high = None
    for r in rows:
        if r["first"]:
            illegal += bool(last) and last + r["first"] not in LEGAL
            last = r["last"]
        if r["turn_min"] is not None:
            n += r["turns"] - (r["turn_min"] == high)
            low, high = r["turn_min"] if low is None else low, r["turn_max"]
    totals = {"gaps": _gaps(low, high, n), "illegal": illegal, "cost": cost} | {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")}
    out = [{"key": r["key"], "part": r["part"], "seg": r["seg"], "kinds": r["kinds"], "p": states[k], "q": states[k + 1], "tail": (1 if states[-1] == 2 else 2 if states[-1] == 1 else 0) if k == len(rows) - 1 else 0} | (totals if not k else {}) for k, r in enumerate(rows)]
    return pa.Table.from_pylist(out, _CHAINED)


_CHAINED = pa.schema([("key", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("kinds", pa.string()), ("p", pa.int32()), ("q", pa.int32()), ("tail", pa.int32()), *_COUNTS])
_CHAINED_DDL = f"key string, part long, seg long, kinds string, p int, q int, tail int, {_COUNTS_DDL}"


def _way(row: dict) -> str:
    best, width = cheapest(row["classes"], row["kinds"], row["p"])
    return audit_of(*best[row["q"]], width) + "I" * row["tail"]


_PIECE = pa.schema([("key", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("audit", pa.string()), ("lines", pa.string()), ("n_lines", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            audit = _way(row)
            lines = _lines(audit, row, row["p"])
            yield pa.RecordBatch.from_pylist([{"key": row["key"], "part": row["part"], "seg": row["seg"], "audit": audit, "lines": "\n".join(lines), "n_lines": len(lines)}], _PIECE)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of cut conversations in order: one running hash, one piece at a time."""
    schema = pa.schema([("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    key = state = None
    audits: list[str] = []
    begun = False
    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["key"] != key:
                if state is not None:
                    yield pa.RecordBatch.from_pylist([{"key": key, "audit": "".join(audits), "repaired_sha256": state.hexdigest()}], schema)
                key, state, audits, begun = row["key"], hashlib.sha256(), [], False
            audits.append(row["audit"])
            if row["n_lines"]:
                state.update((("\n" if begun else "") + row["lines"]).encode())
                begun = True
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "audit": "".join(audits), "repaired_sha256": state.hexdigest()}], schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            if row["p"] is None:
                value, n = ended(*(found := cheapest(row["classes"], row["kinds"])))
                audit, start = audit_of(value, n, found[1]), 0
            else:
                audit, start = _way(row), row["p"]
            out = [{"key": row["key"], "part": row["part"], "seg": row["seg"], "place": place, "role": role or row["roles"][k], "text": "" if k is None else row["texts"][k], "edit": edit} for place, (k, role, edit) in enumerate(replay(audit, row["classes"], start))]
            yield pa.RecordBatch.from_pylist(out, schema)


class Repair:
    """Cheapest repair of conversations; see ``repair``."""

    def __init__(self, rows: DataFrame, segment_rows: int, segment_chars: int):
        spark = rows.sparkSession
        self.spark, self.kind = spark, dict(rows.dtypes)["conv_id"]
        key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
        live = F.col("live") if "live" in rows.columns else F.lit(True)
        space = lambda c: F.coalesce(F.col(c), F.lit(" "))
        flat = rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), live.alias("live"))
        order = ["key", "turn", "role", "text"]
        with text_batches(spark):
            ranged = flat.repartitionByRange(*order).sortWithinPartitions(*order)
            self.segments = materialize(ranged.mapInArrow(partial(_cut, segment_rows, segment_chars), _SEGMENT_DDL), "segments")
        # Few are not whole: the first and last of a range, and long ones.
        cut = self.segments.where("NOT whole")
        firsts = cut.select("key", "part", "seg", F.posexplode("digests").alias("pos", "digest")).where("digest IS NOT NULL")
        earliest = firsts.groupBy("key", "digest").agg(F.min(F.struct("part", "seg")).alias("first"))
        again = firsts.join(earliest, ["key", "digest"]).where(F.struct("part", "seg") > F.col("first")).groupBy("part", "seg").agg(F.collect_list("pos").alias("again"))
        known = cut.select("key", "part", "seg", "classes", "kinds", "turn_min", "turn_max", "turns").join(again, ["part", "seg"], "left")
        summaries = known.mapInArrow(_summaries, _SUMMARY_DDL)
        chained = summaries.groupBy("key").applyInArrow(_chain, _CHAINED_DDL)
        self.chained = materialize(chained, "chained")

    def _decided(self) -> DataFrame:
        ways = self.chained.select("part", "seg", "kinds", "p", "q", "tail")
        return self.segments.where("NOT whole").drop("kinds", "whole", "digests").join(bounded(ways, BROADCAST_ROWS), ["part", "seg"])

    def _named(self, df: DataFrame, *columns: str) -> DataFrame:
        conv = F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30).cast(self.kind))
        return df.select(conv.alias("conv_id"), *columns)

    def summary(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
        counts = [n for n, _ in _COUNTS]
        whole = self.segments.where("whole").drop("digests").mapInArrow(_whole, f"key string, {_COUNTS_DDL}, audit string, repaired_sha256 string")
        with text_batches(self.spark, SEGMENTS_A_BATCH):
            whole = materialize(whole, "repaired")
            pieces = materialize(self._decided().mapInArrow(_pieces, "key string, part long, seg long, audit string, lines string, n_lines long"), "pieces")
            joined = pieces.repartition("key").sortWithinPartitions("key", "part", "seg").mapInArrow(_joined, "key string, audit string, repaired_sha256 string")
            joined = materialize(joined, "joined")
        totals = self.chained.where("cost IS NOT NULL").select("key", *counts)
        cut = totals.join(joined, "key").select("key", *counts, "audit", "repaired_sha256")
        return self._named(whole.union(cut), *counts, "audit", "repaired_sha256")

    def turns(self) -> DataFrame:
        """``conv_id, part, seg, place, role, text, edit``: the repaired rows; part, seg and place order a conversation's."""
        columns = ["key", "part", "seg", "classes", "kinds", "roles", "texts", "p", "q", "tail"]
        none = F.lit(None).cast("int")
        whole = self.segments.where("whole").select(*columns[:7], none.alias("p"), none.alias("q"), none.alias("tail"))
        found = whole.union(self._decided().select(*columns)).mapInArrow(_turns, "key string, part long, seg long, place long, role string, text string, edit string")
        with text_batches(self.spark, SEGMENTS_A_BATCH):
            found = materialize(found, "repaired-turns")
        return self._named(found, "part", "seg", "place", "role", "text", "edit")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> Repair:
    """Make conversations fit ``(s?(ua)+)?`` by the cheapest edits; ``.summary()`` and ``.turns()`` give the result.

    ``rows``: conv_id, turn, role, text and maybe live (false: the row is gone,
    its conversation stays). Rows stand in the order of turn (null first), then
    role and text. Blank rows (no character but blanks) and duplicates (role and
    text seen earlier) must go. Keep costs 0, a new role 1, deletion 2, an empty
    user or assistant row 5, and a truncated row that stays 5 more.

    Rows are dealt into ranges of conversation and order, once, and cut into
    segments of bounded size. A conversation in one segment is solved there. Of
    the others, which may hold any share of all rows, each segment is summed up as
    the cheapest ways between the four states of the pattern, a chain of those
    small tables decides where each segment begins and ends, and segments are then
    written each on its own. Only the hash of such a conversation is one running
    state, fed segment by segment.

    Null role and text count as one space; a row with an empty role has no initial and can't
    be kept as it is; a null conv_id is a conversation of its
    own. Repeated rows are duplicates, long texts are taken whole, an empty table
    gives no rows, and other columns are not used.
    """
    return Repair(rows, segment_rows, segment_chars)


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).summary()


_SQL_KIND = r"CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'n' END"

# A step of the recursion takes one row: inserts before it (gap), then its edit (move).
ORACLE = f"""
WITH RECURSIVE {SQL_CRC},
spaced AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations, crc_step),
broken AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) FROM spaced WHERE fate <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM broken),
rows_in AS MATERIALIZED (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS c, {_SQL_KIND} AS kind, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
convs AS MATERIALIZED (SELECT c.conv_id, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 'b') AS blank, count(*) FILTER (WHERE kind = 'd') AS duplicate, count(*) FILTER (WHERE kind = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows_in r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
gap(p, q, fee, letters, said) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, {INSERT}, 'I', 'user:\n'), (1, 2, {INSERT}, 'I', 'user:\n'), (3, 2, {INSERT}, 'I', 'user:\n'), (2, 3, {INSERT}, 'I', 'assistant:\n'),
    (0, 3, {2 * INSERT}, 'II', 'user:\nassistant:\n'), (1, 3, {2 * INSERT}, 'II', 'user:\nassistant:\n'), (3, 3, {2 * INSERT}, 'II', 'user:\nassistant:\n'), (2, 2, {2 * INSERT}, 'II', 'assistant:\nuser:\n')),
next(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
move AS (SELECT r.conv_id, r.i, p.p, p.p AS q, {DELETE} AS fee, 'D' AS letter, '' AS said FROM rows_in r, (VALUES (0), (1), (2), (3)) p(p)
    UNION ALL SELECT r.conv_id, r.i, x.p, x.q, CASE WHEN kind = 't' THEN {MEND} ELSE 0 END, 'K', r.role || ':' || r.text || chr(10) FROM rows_in r JOIN next x USING (c) WHERE kind IN ('n', 't')
    UNION ALL SELECT r.conv_id, r.i, x.p, x.q, {RENAME} + CASE WHEN kind = 't' THEN {MEND} ELSE 0 END, 'R', CASE x.c WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text || chr(10) FROM rows_in r, next x WHERE kind IN ('n', 't') AND x.c <> 's'),
path AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''}} AS best FROM convs
    UNION ALL SELECT s.conv_id, s.i + 1, m.q, min({{'cost': CAST(s.best.cost + g.fee + m.fee AS BIGINT), 'audit': s.best.audit || g.letters || m.letter, 'said': s.best.said || replace(g.said, '\n', chr(10)) || m.said}})
    FROM path s JOIN gap g ON g.p = s.q JOIN move m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1 AND m.p = g.q GROUP BY s.conv_id, s.i, m.q),
ends AS (SELECT s.conv_id, min({{'cost': CAST(s.best.cost + g.fee AS BIGINT), 'audit': s.best.audit || g.letters, 'said': s.best.said || replace(g.said, '\n', chr(10))}}) AS best
    FROM path s JOIN convs c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN gap g ON g.p = s.q AND g.q IN (0, 3) GROUP BY s.conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(left(e.best.said, greatest(length(e.best.said) - 1, 0))) AS repaired_sha256
FROM convs c JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
