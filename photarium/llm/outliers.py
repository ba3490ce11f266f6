"""Operator 11: quality rules and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.llm.tokens import text_batches
from photarium.sources.scratch import bounded, materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated, and the contract's bounds.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = 5
#: Components are whole numbers of 1 / UNIT, so all sums over rows are exact and don't depend on their order.
UNIT = 256
#: Spread (standard deviation) that each component is granted besides its own: many texts have no symbols at all, and one more is no outlier.
GRANTED = (0.5, 0.1, 0.3, 0.25, 0.3)
#: Rows of a group from which it has estimates of its own; smaller ones take their language's, or else everybody's.
MIN_ROWS = 50
#: Chance that a Gaussian row lies beyond the bound.
TAIL = 1e-6
#: Distances are sorted into bins of 1 / BINS octave.
BINS = 16
MAX_STEPS = 15
#: Groups whose estimates may be broadcast.
BROADCAST_ROWS = 20_000
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The five statistics of a text, null counting as empty: words, their code points, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    words = text.encode().split()  # bytes split at ASCII blanks only
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n, known = len(words) - WINDOW + 1, {}
    if n < 2:
        return 0
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    if len(known) > n + WINDOW - 2:  # a repeated window repeats words
        return 0
    for step in (1, 2, 4):  # names of windows of 2, 4 and 8 words
        _, ids = np.unique(ids[:-step] * (len(words) + 1) + ids[step:], return_inverse=True)
    hit = np.bincount(ids)[ids] > 1
    ends = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + WINDOW, -1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n_words)


def with_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and STATS as longs."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_stats(t) for t in batch.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, found.T)], names=[*keep, *STATS])

    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in STATS)])
    return docs.select(*keep, F.col(text_col)).mapInArrow(run, ddl)


def vector() -> list[Column]:
    """The transformed statistics: logarithms of length, of the mean word's length, and of symbols, repeated lines and repeated words against length; in whole units."""
    words, chars = F.col("n_words") + 1, F.col("word_chars") + 1
    raw = [words, chars / words, 1 + 64 * F.col("n_symbols") / chars, 1 + 8 * F.col("n_dup_lines") / words, 1 + 4 * F.col("n_repeat_words") / words]
    return [F.round(F.log2(x.cast("double")) * UNIT).cast("long").alias(f"x{k}") for k, x in enumerate(raw)]


def chi2_cdf(x: float, k: float) -> float:
    """Of the chi-square distribution with ``k`` degrees of freedom: the incomplete gamma function's series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


BOUND = chi2_quantile(1 - TAIL, DIM)
#: Rows within this distance of the raw estimate make the final one.
REWEIGHT = 0.975
CLOSE = chi2_quantile(REWEIGHT, DIM)


def consistency(share: float) -> float:
    """Factor that makes the covariance of the innermost ``share`` of Gaussian rows that of all."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)


def estimate(n: int, total: int, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``(mean, inverse, log determinant)`` from exact sums over ``n`` of ``total`` rows, in units of 1 / UNIT."""
    mean, second = sums / n, np.zeros((DIM, DIM))
    for (i, j), p in zip(_PAIRS, products):
        second[i, j] = second[j, i] = p / n - mean[i] * mean[j]
    return shaped(mean, consistency(n / total) * second)


def shaped(mean: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    spread = covariance + np.diag([(g * UNIT) ** 2 for g in GRANTED])
    return mean, np.linalg.inv(spread), float(np.linalg.slogdet(spread)[1])


_EST = "key string, start int, total long, n long, m array<double>, inv array<double>, det double"


def _estimates(sums: DataFrame) -> DataFrame:
    """Rows key, start, total, n, s (sums), ss (products) as estimates."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for key, start, total, n, s, ss in pdf[["key", "start", "total", "n", "s", "ss"]].itertuples(index=False):
                m, inv, det = estimate(n, total, np.array(s, float), np.array(ss, float))
                out.append((key, start, total, n, m.tolist(), inv.ravel().tolist(), det))
            yield pd.DataFrame(out, columns=["key", "start", "total", "n", "m", "inv", "det"])

    return sums.mapInPandas(run, _EST)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m under inv."""
    d = [F.col(f"x{k}") - F.col("m")[k] for k in range(DIM)]
    terms = [(1 if i == j else 2) * F.col("inv")[i * DIM + j] * d[i] * d[j] for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _moments() -> list[Column]:
    c = F.col("c")
    return [F.sum(c).alias("n"), *(F.sum(c * F.col(f"x{i}")).alias(f"s{i}") for i in range(DIM)), *(F.sum(c * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS)]


_SUMMED = ["n", *(f"s{i}" for i in range(DIM)), *(f"p{i}{j}" for i, j in _PAIRS)]


def _packed(df: DataFrame) -> DataFrame:
    return df.select("key", "start", "total", "n", F.array(*(f"s{i}" for i in range(DIM))).alias("s"), F.array(*(f"p{i}{j}" for i, j in _PAIRS)).alias("ss"))


def _middle(counts: DataFrame, value: str) -> DataFrame:
    """``key, dim, middle``: the value at which half of the rows is reached; at most some thousand values a key and component."""
    w = Window.partitionBy("key", "dim")
    below = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("key", "dim", value, below.alias("below"), F.sum("c").over(w).alias("all"))
    return ranked.where(2 * F.col("below") >= F.col("all")).groupBy("key", "dim").agg(F.min(value).alias("middle"))


def _median_start(vectors: DataFrame) -> DataFrame:
    """Estimates from medians and absolute deviations, component by component."""
    flat = vectors.select("key", "c", F.posexplode(F.array(*(f"x{k}" for k in range(DIM)))).alias("dim", "x"))
    counts = materialize(flat.groupBy("key", "dim", "x").agg(F.sum("c").alias("c")), "values")
    medians = materialize(_middle(counts, "x"), "medians")
    away = counts.join(medians, ["key", "dim"]).select("key", "dim", F.abs(F.col("x") - F.col("middle")).alias("away"), "c").groupBy("key", "dim", "away").agg(F.sum("c").alias("c"))
    spreads = _middle(away, "away").withColumnRenamed("middle", "mad")
    both = medians.join(spreads, ["key", "dim"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dim", "middle", "mad"))).alias("at"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for key, at in pdf[["key", "at"]].itertuples(index=False):
                m, inv, det = shaped(np.array([x["middle"] for x in at], float), np.diag([(1.4826 * x["mad"]) ** 2 for x in at]))
                out.append((key, 0, 0, 0, m.tolist(), inv.ravel().tolist(), math.inf))
            yield pd.DataFrame(out, columns=["key", "start", "total", "n", "m", "inv", "det"])

    return both.mapInPandas(run, _EST)


def half(total: Column) -> Column:
    return F.floor((total + DIM + 1) / 2)


def _step(vectors: DataFrame, est: DataFrame) -> DataFrame:
    """One concentration step: estimates of the rows in the bins up to that of the h-th smallest distance."""
    near = vectors.join(bounded(est.select("key", "start", "m", "inv"), BROADCAST_ROWS), "key").withColumn("bin", F.floor(BINS * F.log2(1 + _distance())).cast("int"))
    bins = near.groupBy("key", "start", "bin").agg(*_moments())
    w = Window.partitionBy("key", "start")  # at most some hundred bins
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumns({"before": before, "total": F.sum("n").over(w)}).where(F.col("before") < half(F.col("total")))
    return _estimates(_packed(inner.groupBy("key", "start", "total").agg(*(F.sum(c).alias(c) for c in _SUMMED))))


def covariance_estimates(vectors: DataFrame) -> DataFrame:
    """``key, m, inv``: reweighted minimum-covariance-determinant estimates of each key.

    ``vectors``: key, x0 to x4 (whole numbers) and c, how often. Two starts,
    medians with absolute deviations and the plain mean with covariance, are
    concentrated: each step takes the half of the rows (and what shares the bin of
    its last one) that lies nearest, until no determinant falls. The smaller
    determinant wins, its covariance is scaled for a Gaussian, and the rows within
    its 97.5 % distance give the final estimate. Every row counts in every step;
    a step is one aggregation to a few hundred bins a key.
    """
    plain = vectors.groupBy("key").agg(*_moments()).withColumns({"start": F.lit(1), "total": F.col("n")})
    est = materialize(_median_start(vectors).union(_estimates(_packed(plain)).withColumn("det", F.lit(math.inf))), "start")
    for _ in range(MAX_STEPS):
        new = materialize(_step(vectors, est), "step")
        old = est.select("key", "start", F.col("det").alias("old"), F.col("m").alias("m_old"), F.col("inv").alias("inv_old"), F.col("n").alias("n_old"))
        falls = F.col("det") < F.col("old") - 1e-9
        both = new.join(old, ["key", "start"])
        est = materialize(both.select("key", "start", "total", F.when(falls, F.col("n")).otherwise(F.col("n_old")).alias("n"), F.when(falls, F.col("m")).otherwise(F.col("m_old")).alias("m"), F.when(falls, F.col("inv")).otherwise(F.col("inv_old")).alias("inv"), F.least("det", "old").alias("det"), falls.alias("fell")), "estimates")
        if not est.where("fell").limit(1).count():
            break
    best = est.groupBy("key").agg(F.min_by(F.struct("m", "inv"), F.struct("det", "start")).alias("best")).select("key", "best.m", "best.inv")
    near = vectors.join(bounded(best, BROADCAST_ROWS), "key").where(_distance() <= CLOSE)
    sums = near.groupBy("key").agg(*_moments()).withColumn("start", F.lit(0))
    # The share that the distance cuts off is known, so the scale is that of REWEIGHT.
    return _estimates(_packed(sums.withColumn("total", F.ceil(F.col("n") / REWEIGHT)))).select("key", "m", "inv")


def _part(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """``doc_id, lang, source``, STATS, ``base_failed, distance, kept`` of each row.

    A row fails the base rules with fewer than MIN_WORDS words or more than
    MAX_REPEATED percent of them in repeated windows. Of the others, the vector of
    transformed statistics is held against the robust estimate of its language and
    source, and rejected if its squared Mahalanobis ``distance`` exceeds BOUND. A
    group of fewer than ``min_rows`` such rows is judged by its language's
    estimate, over all sources, and a language with fewer by that of all rows.

    Null texts count as empty and fail; null languages and sources are values
    like any other; repeated rows count as often as they occur; long texts are
    read whole; other columns are not used; an empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    with text_batches(spark):
        rows = materialize(with_stats(named).select("*", *vector()), "statistics")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    lang, group = F.concat(F.lit("l"), _part(F.col("lang"))), F.concat(F.lit("s"), _part(F.col("lang")), F.lit("|"), _part(F.col("source")))
    xs = [f"x{k}" for k in range(DIM)]
    counted = materialize(rows.where(~failed).groupBy(lang.alias("lang_key"), group.alias("group_key"), *xs).agg(F.count("*").alias("c")), "vectors")
    groups = counted.groupBy("lang_key", "group_key").agg(F.sum("c").alias("n"))
    n_lang = F.sum("n").over(Window.partitionBy("lang_key"))
    model = F.when(F.col("n") >= min_rows, F.col("group_key")).when(F.col("n_lang") >= min_rows, F.col("lang_key")).otherwise("all")
    groups = materialize(groups.withColumn("n_lang", n_lang).select("group_key", model.alias("key")), "groups")
    wanted = groups.select("key").distinct()
    keys = F.explode(F.array("group_key", "lang_key", F.lit("all"))).alias("key")
    vectors = counted.select(keys, "c", *xs).join(bounded(wanted, BROADCAST_ROWS), "key", "left_semi")
    vectors = materialize(vectors.groupBy("key", *xs).agg(F.sum("c").alias("c")), "model-vectors")
    models = materialize(groups.join(covariance_estimates(vectors), "key").select("group_key", "m", "inv"), "models")
    judged = rows.withColumn("group_key", group).join(bounded(models, BROADCAST_ROWS), "group_key", "left")
    distance = F.when(~failed, _distance())
    return judged.select("doc_id", "lang", "source", *STATS, failed.alias("base_failed"), distance.alias("distance")).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= BOUND, F.lit(True)))


def op11_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *STATS, "base_failed", "kept", "distance")
