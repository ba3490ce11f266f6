"""Operator 10: language by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photarium.llm.features import LETTER, LOWER

BUCKETS = 1 << 12
#: Labelled rows used for training, at most; each language gives up to an equal part.
TRAIN_ROWS = 2400
#: Longest text, in characters, that is taken for training; all texts are predicted whole.
TRAIN_CHARS = 200_000
#: Two languages whose decoding losses differ by less than this share are reported as ambiguous.
MARGIN = 0.05


def code_matrix(classes: int, seed: int = 11) -> np.ndarray:
    """Codewords of -1 and 1, a row for each class.

    Up to seven classes: every way to split them in two (the exhaustive code).
    More: the random code of 10 log2(classes) bits with the largest least
    distance among 200 draws.
    """
    if classes <= 1:
        return np.ones((classes, 1), dtype=np.int8)
    if classes <= 7:
        splits = [[1] + [1 if s >> k & 1 else -1 for k in range(classes - 1)] for s in range((1 << (classes - 1)) - 1)]
        return np.array(splits, dtype=np.int8).T
    rng, bits, best, least = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        gap = (bits - (code.astype(int) @ code.T.astype(int)))[~np.eye(classes, dtype=bool)].min()
        if gap > least and (abs(code.sum(axis=0)) < classes).all():
            best, least = code, gap
    return best


def gram_counts(texts: list[str]) -> np.ndarray:
    """L2-normalised square roots of hashed counts of byte trigrams of each text.

    Letters are lower-cased and everything else is one mark, so trigrams know
    where words begin and end.
    """
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for k, text in enumerate(texts):
        flat = np.frombuffer(b"^^" + text.lower().encode("utf-8", "replace") + b"^^", dtype=np.uint8)
        flat = np.where(LETTER[flat], LOWER[flat], 94).astype(np.uint32)
        letters = flat != 94
        gram = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
        gram = gram[letters[:-2] | letters[1:-1] | letters[2:]]
        bucket = (gram * np.uint32(2654435761)) >> np.uint32(20)
        out[k] = np.sqrt(np.bincount(bucket, minlength=BUCKETS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OutputCode:
    """One logistic n-gram classifier for each bit; loss-weighted decoding."""

    def __init__(self, texts: list[str], langs: list[str], steps: int = 150, rate: float = 0.3):
        self.langs = sorted(set(langs))
        self.code = code_matrix(len(self.langs))
        x = gram_counts(texts)
        y = np.array([self.langs.index(v) for v in langs])
        share = np.bincount(y, minlength=len(self.langs))
        weight = (1 / share[y] / len(self.langs)).astype(np.float32)
        target = self.code[y].astype(np.float32)
        w, b = np.zeros((BUCKETS, target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
        speed = np.zeros_like(w)
        for _ in range(steps):
            d = -target * weight[:, None] / (1 + np.exp(target * (x @ w + b)))
            speed = 0.9 * speed - rate * 40 * (x.T @ d + 1e-6 * w)
            w += speed
            b -= rate * d.sum(axis=0)
        self.w, self.b = w, b
        # Weights of decoding: each class trusts the bits that are right on its own rows.
        right = np.stack([(np.sign(x[y == k] @ w + b) == self.code[k]).mean(axis=0) for k in range(len(self.langs))])
        self.trust = right / np.maximum(right.sum(axis=1, keepdims=True), 1e-9)

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and whether the runner-up is too close."""
        f = gram_counts(texts) @ self.w + self.b
        loss = np.stack([(np.logaddexp(0, -f * row) * trust).sum(axis=1) for row, trust in zip(self.code.astype(np.float32), self.trust)], axis=1)
        best = loss.argmin(axis=1)
        p = np.exp(-len(self.code[0]) * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        ordered = np.sort(loss, axis=1)
        close = (ordered[:, 1] - ordered[:, 0] < MARGIN * ordered[:, 1]) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, p[np.arange(len(p)), best].astype(np.float64), close


def _fold() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> OutputCode | None:
    """Fit on at most ``rows`` labelled rows outside the held-out fold, of up to TRAIN_CHARS characters.

    Languages give rows in turn, in the order of a hash of their rows' ids and
    then texts, so a repeated id keeps its own text and label together. Rows
    without text or label are left out; repeats of a row count once. Nothing
    labelled: None.
    """
    known = docs.where(F.col("lang").isNotNull() & (_fold() != 2) & (F.length("text") <= TRAIN_CHARS)).select(F.xxhash64("doc_id", "lang", "text").alias("row"), "lang", F.xxhash64("doc_id").alias("h"))
    # A language's rows are thinned by their hash to about four times what it may give, so that no task ranks a whole language.
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    share = F.lit(float(4 * rows)) / F.col("n")
    known = known.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "row"))
    first = known.withColumn("place", place).where(F.col("place") <= rows)
    picked = first.orderBy("place", "lang").limit(rows).select("row")
    # At most `rows` keys: a bounded side.
    texts = docs.select("text", "lang", F.xxhash64("doc_id", "lang", "text").alias("row")).join(F.broadcast(picked.distinct()), "row").groupBy("row").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    sample = texts.toPandas().sort_values("row")
    sample = sample[[has_letter(t) for t in sample["text"]]]
    return OutputCode(list(sample["text"]), list(sample["lang"])) if len(sample) else None


def identify(docs: DataFrame, model: OutputCode | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``.

    A null text or one without a letter, and any text if there is no model, is
    ``und`` with score 0 and not ambiguous. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # under 1 MB for a few languages
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = pickle.loads(shared.value)
        for batch in it:
            texts = batch.column("text").to_pylist()
            lang, value, flag = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            rows = [k for k, t in enumerate(texts) if code and t and has_letter(t)]
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                best, value[some], flag[some] = code.decode([texts[i] for i in some])
                for i, b in zip(some, best):
                    lang[i] = code.langs[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(value), pa.array(flag)], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(batches, schema)


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(_fold() == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
