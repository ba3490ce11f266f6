"""Operator 7: personal data, and terms that disclose it by corpus co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photarium.sources.scratch import materialize

#: Marks around matches while positions are counted; texts that hold them are matched with a neutral stand-in.
OPEN, CLOSE, NEUTRAL = "\ue000", "\ue001", "\ufffd"

# The contract's patterns, anchored at the start of a run (or at the end of the
# last match) so that a long run is tried once; leftmost matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)

#: A term discloses an entity if its pointwise mutual information reaches this share of the entity's information.
DISCLOSURE = 0.8
#: Scores are multiplied by n / (n + SMOOTHING), n being the distinct lines with entity and term: one line alone never discloses, two do for a term seen nearly nowhere else.
SMOOTHING = 1 / 3
#: Lines of one hash slice in SLICES give a lower bound of a term's line count.
SLICES = 16
#: Rows and characters of candidate terms that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 16_000_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(x)), ""), lambda d: d.cast("int"))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str | Column) -> Column:
    """``array<struct<start, stop, value>>`` of a pattern's matches, in code points."""
    marked = F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(f"{OPEN}$0{CLOSE}"))
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]")  # odd pieces are matches
    empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.struct(acc["at"].alias("start"), end.alias("stop"), piece.alias("value"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("found"))
    return F.when(F.instr(marked, OPEN) == 0, empty).otherwise(F.aggregate(pieces, start, step, lambda acc: acc["found"]))


def _of_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``pii``: spans of the four base kinds, by kind and then start.

    ``array<struct<kind, start, stop, value>>``; null text counts as empty. One
    row per row; texts are searched whole, however long; columns of any name
    stay, but for ``pii``, which is replaced; an empty table stays empty.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + CLOSE, NEUTRAL * 2)
    each = [_of_kind(kind, F.filter(_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))) for kind in KINDS]  # noqa: B023
    # Few texts hold any of the signs that a match needs.
    maybe = F.col(text_col).rlike(r"[0-9@]")
    return docs.withColumn("pii", F.when(maybe, F.concat(*each)).otherwise(F.array().cast("array<struct<kind:string,start:int,stop:int,value:string>>")))


def _terms(line: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select(F.explode(F.split(F.col(text_col), "[\r\n]+")).alias("line"))


def _small(terms: DataFrame) -> DataFrame:
    """``terms``, to be broadcast if few and short."""
    found = terms.agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("chars")).first()
    return F.broadcast(terms) if found["n"] <= BROADCAST_ROWS and (found["chars"] or 0) <= BROADCAST_CHARS else terms


def disclosing_terms(docs: DataFrame, holders: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING) -> DataFrame:
    """``value, term, score``: terms that reveal a protected entity.

    The unit of co-occurrence is the distinct line, so copies of a document or
    of a passage count once; no base pattern crosses a line end. With p(.) the
    share of lines that hold something, PMI(t; e) = log p(t, e) / (p(t) p(e)) and
    the entity's information is IC(e) = -log p(e), the score is PMI / IC, shrunk
    by n_te / (n_te + ``smoothing``); a term discloses e from ``disclosure`` on.

    All counts are exact (lines by 64-bit hash) and cover the whole corpus. Only
    terms of entity lines are counted elsewhere, and of those only the ones that
    can still disclose: the threshold bounds n_t, and a term with more lines than
    that in one hash slice of the lines has more in all.

    ``docs``: all texts; ``holders``: the rows of ``docs`` that hold an entity.
    """
    held = base_spans(_lines(holders, text_col).distinct(), "line").where(F.size("pii") > 0)
    held = held.select("line", F.explode(F.array_distinct(F.transform("pii", lambda s: s["value"]))).alias("value"))
    held = materialize(held, "entity-lines")
    shrunk = lambda n: n / (n + smoothing)
    # A score never exceeds its factor, so rarer pairs can't reach the threshold.
    entities = held.groupBy("value").agg(F.count("*").alias("n_e")).where(shrunk(F.col("n_e")) >= disclosure)
    joint = held.join(entities, "value").select("value", "n_e", F.explode(_terms(F.replace(F.col("line"), F.col("value"), F.lit(" ")))).alias("term"))
    joint = joint.groupBy("value", "n_e", "term").agg(F.count("*").alias("n_te")).where(shrunk(F.col("n_te")) >= disclosure)
    total = float(_lines(docs, text_col).select(F.xxhash64("line").alias("line")).distinct().count())
    lines_all = F.greatest(F.lit(total), F.lit(1.0))
    most = F.col("n_te") * F.pow(lines_all / F.col("n_e"), 1 - disclosure / shrunk(F.col("n_te")))
    joint = materialize(joint.withColumn("most", most), "joint-terms")

    def counted(terms: DataFrame, lines: DataFrame) -> DataFrame:
        """``term, n_t``: distinct lines of each term."""
        found = lines.select("hash", F.explode(_terms(F.col("line"))).alias("term")).join(_small(terms), "term")
        return found.distinct().groupBy("term").agg(F.count("*").alias("n_t"))

    lines = _lines(docs, text_col).select("line", F.xxhash64("line").alias("hash"))
    candidates = materialize(joint.groupBy("term").agg(F.max("most").alias("most")), "terms")
    least = counted(candidates.select("term"), lines.where(F.pmod("hash", F.lit(SLICES)) == 0))
    rare = materialize(candidates.join(least, "term", "left").where(F.coalesce("n_t", F.lit(0)) <= F.col("most") + 1e-6).select("term"), "rare-terms")
    pmi = F.log(F.col("n_te") * lines_all / (F.col("n_t") * F.col("n_e")))
    # An entity on every line carries no information, and nothing discloses it.
    scored = joint.join(counted(rare, lines), "term").where(F.col("n_e") < lines_all).withColumn("score", shrunk(F.col("n_te")) * F.least(F.lit(1.0), pmi / F.log(lines_all / F.col("n_e"))))
    return scored.where(F.col("score") >= disclosure).select("value", "term", "score")


def sanitise_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, pii, terms`` (+ ``keep``): base spans and spans of disclosing terms.

    Terms are marked in documents that hold the entity they disclose; the rest
    of the corpus only lends its counts. Only rows with personal data are
    written and joined; all others pass by. Null text counts as empty, null ids
    get base spans only, rows that share an id share their terms, and texts
    without personal data get none.
    """
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    spans = base_spans(rows)
    clean = spans.where(F.size("pii") == 0).withColumn("terms", none)
    holders = materialize(spans.where(F.size("pii") > 0), "holders")
    flagged = disclosing_terms(rows.where("text IS NOT NULL"), holders)
    own = holders.select("doc_id", F.explode(F.array_distinct(F.transform("pii", lambda s: s["value"]))).alias("value")).join(flagged, "value").select("doc_id", "term").distinct()
    # No document's list is longer than its text.
    words = holders.select("doc_id", F.explode(_terms(F.col("text"))).alias("term"))
    own = own.join(words, ["doc_id", "term"], "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("flagged"))
    marked = holders.join(own, "doc_id", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("flagged", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    text = F.translate(F.col("text"), OPEN + CLOSE, NEUTRAL * 2)
    outside = F.filter(_spans(text, pattern), lambda t: ~F.exists(F.col("pii"), lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    return clean.union(marked.withColumn("terms", F.when(F.col("flagged").isNull(), none).otherwise(outside)).drop("flagged"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data generalised to ``[EMAIL]`` etc. and disclosing terms to ``[TERM]``.

    Overlapping base spans are replaced by the first of them that starts;
    columns, rows and null texts stay.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(1).alias("none"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(others))).alias("rest"))
    found = sanitise_spans(kept, "doc_id", "text", ("rest",))
    spans = F.array_sort(F.transform(F.concat("pii", _of_kind("term", F.col("terms"))), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        add = F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(skip, F.greatest(acc["at"], s["stop"])).otherwise(s["stop"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.array_append(acc["out"], add)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(clean)
    out = {id_col: F.col("doc_id"), text_col: text} | {c: F.col("rest")[f"c{k}"] for k, c in enumerate(others)}
    return found.select(*(out[c].alias(c) for c in docs.columns))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = sanitise_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    everything = F.concat("pii", _of_kind("term", F.col("terms")))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("pii")), 256).alias("base_sha256"), _listed(everything).alias("spans"))
