"""Operator 5: toxicity by a bidirectional gated recurrent network with attention, in numpy."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photarium.llm.features import Vocabulary, Words

#: A passage of up to WINDOW - STRIDE + 1 words lies whole in some window.
WINDOW, STRIDE = 24, 4
EMBED, HIDDEN = 6, 8
#: Labelled rows used for training, at most; each class gives up to half.
TRAIN_ROWS = 3000
#: Longest text, in characters, that is taken for training; all texts are scored whole.
TRAIN_CHARS = 200_000
VOCABULARY = 6000
EPOCHS = 5
#: Characters of text that one numpy pass handles; longer texts are read in pieces cut between words.
PASS_CHARS = 1 << 18
_BETWEEN = re.compile(r"[\x00-\x60\x7b-\x7f]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _evidence(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes whose presence tells the classes apart, and their scaled log-odds."""
    pos = np.concatenate([np.zeros(0, np.uint64), *(np.unique(r) for r, y in zip(rows, labels) if y)])
    neg = np.concatenate([np.zeros(0, np.uint64), *(np.unique(r) for r, y in zip(rows, labels) if not y)])
    (hp, np_), (hn, nn) = np.unique(pos, return_counts=True), np.unique(neg, return_counts=True)
    every = np.union1d(hp, hn)
    p, n = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, hp)], n[np.searchsorted(every, hn)] = np_, nn
    total_p, total_n = labels.sum(), (1 - labels).sum()
    odds = np.log((p + 0.5) / (total_p + 1)) - np.log((n + 0.5) / (total_n + 1))
    z = odds / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    good = np.flatnonzero((p + n >= 3) & (np.abs(z) > 2.2))
    good = good[np.argsort(-np.abs(z[good]), kind="stable")][:VOCABULARY]
    return every[good], z[good] / 2.5


def _passes(texts: list[str]) -> Iterator[list[int]]:
    """Rows of one pass: short of PASS_CHARS, or one long text alone."""
    rows, size = [], 0
    for k, text in enumerate(texts):
        if rows and size + len(text) > PASS_CHARS:
            yield rows
            rows, size = [], 0
        rows.append(k)
        size += len(text)
    if rows:
        yield rows


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of PASS_CHARS or a little more, each ending between two words."""
    text, at = text.lower(), 0
    while len(text) - at > PASS_CHARS and (cut := _BETWEEN.search(text, at + PASS_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _reads(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts of each pass, a long text in its pieces."""
    for rows in _passes(texts):
        if len(rows) > 1:
            yield rows, [texts[k] for k in rows]
        else:
            yield from ((rows, [piece]) for piece in _pieces(texts[rows[0]]))


class Network:
    """Word and character-gram embeddings, two GRUs, attention pooling, one logit for each window."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        words, grams = [], []
        for text in texts:
            w = Words([text])
            words.append(w.hash)
            grams.append(w.gram_hash)
        word_hash, word_odds = _evidence(words, labels)
        gram_hash, gram_odds = _evidence(grams, labels)
        self.words, self.grams = Vocabulary(word_hash), Vocabulary(gram_hash)
        draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        h, d = HIDDEN, 2 * EMBED
        p = {"Ew": draw(len(self.words.hashes), EMBED, scale=0.05), "Ec": draw(len(self.grams.hashes), EMBED, scale=0.05)}
        p["Ew"][1:, 0], p["Ec"][1:, 0], p["Ec"][0] = word_odds[self.words.kept], gram_odds[self.grams.kept], 0
        for side in "fb":
            p[f"W{side}"], p[f"U{side}"], p[f"b{side}"] = draw(d, 3 * h), draw(h, 3 * h), np.zeros(3 * h, np.float32)
        p |= {"A": draw(2 * h, h), "a": np.zeros(h, np.float32), "v": draw(h), "w": draw(2 * h), "c": np.full(1, -2, np.float32)}
        self.p = p

    def inputs(self, texts: list[str]) -> dict:
        """Rows of every word's word and grams, and first and last place of each window of the texts."""
        count, word, gram, gram_word, words = np.zeros(len(texts), np.int64), [], [], [], 0
        for rows, part in _reads(texts):
            w = Words(part)
            row = self.grams.rows(w.gram_hash)
            known = row > 0
            count[rows] += w.count
            word.append(self.words.rows(w.hash))
            gram.append(row[known])
            gram_word.append(w.gram_word[known] + words)
            words += len(w.hash)
        windows = np.maximum(-(-(count - WINDOW) // STRIDE), 0) + 1
        doc = np.repeat(np.arange(len(texts)), windows)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        base = np.cumsum(count) - count
        blank, none = np.zeros(1, np.int64), np.zeros(0, np.int64)
        return {"word": np.concatenate([*word, blank]), "gram": np.concatenate([*gram, none]), "gram_word": np.concatenate([*gram_word, none]), "doc": doc, "first": base[doc] + number * STRIDE, "end": (base + count)[doc], "texts": len(texts)}

    @staticmethod
    def windows(x: dict, chosen: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of the chosen windows, and which of them are words of the text; the rest are the blank after the last word."""
        place = x["first"][chosen][:, None] + np.arange(WINDOW)
        real = place < x["end"][chosen][:, None]
        return np.where(real, place, len(x["word"]) - 1), real

    def embed(self, x: dict) -> np.ndarray:
        chars = np.zeros((len(x["word"]), EMBED), np.float32)
        np.add.at(chars, x["gram_word"], self.p["Ec"][x["gram"]])
        return np.concatenate([self.p["Ew"][x["word"]], chars], axis=1)

    def _run(self, side: str, projected: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; ``projected`` is (time, window, 3H)."""
        u, n = self.p[f"U{side}"], HIDDEN
        h = np.zeros((projected.shape[1], n), np.float32)
        out = np.empty((projected.shape[0], projected.shape[1], n), np.float32)
        for t in range(len(projected)) if side == "f" else range(len(projected) - 1, -1, -1):
            hu = h @ u
            gates = _sigmoid(projected[t, :, : 2 * n] + hu[:, : 2 * n])
            r, z = gates[:, :n], gates[:, n:]
            cand = np.tanh(projected[t, :, 2 * n :] + r * hu[:, 2 * n :])
            new = cand + z * (h - cand)
            if keep is not None:
                keep.append((t, h, r, z, cand, hu[:, 2 * n :]))
            h = new
            out[t] = h
        return out

    def forward(self, vectors: np.ndarray, index: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, states = self.p, []
        at = index.T
        for side in "fb":
            projected = (vectors @ p[f"W{side}"] + p[f"b{side}"])[at]
            steps = [] if keep is not None else None
            states.append(self._run(side, projected, steps))
            if keep is not None:
                keep[side] = steps
        hh = np.concatenate(states, axis=2)
        score = np.tanh(hh @ p["A"] + p["a"])
        weight = np.where(real.T, score @ p["v"], np.float32(-30))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, hh)
        if keep is not None:
            keep |= {"hh": hh, "score": score, "weight": weight, "pooled": pooled}
        return pooled @ p["w"] + p["c"][0]

    def document_logits(self, texts: list[str], block: int = 2048) -> np.ndarray:
        """Largest logit over all overlapping windows of each text."""
        x = self.inputs(texts)
        out = np.full(x["texts"], -np.inf, np.float32)
        np.maximum.at(out, x["doc"], self.window_logits(x, self.embed(x), block))
        return out

    def window_logits(self, x: dict, vectors: np.ndarray, block: int = 2048) -> np.ndarray:
        """Of every window, a block at a time."""
        out = [np.zeros(0, np.float32)]
        for k in range(0, len(x["doc"]), block):
            index, real = self.windows(x, slice(k, k + block))
            out.append(self.forward(*_narrow(vectors, index), real))
        return np.concatenate(out)

    def gradients(self, x: dict, chosen: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
        """Of the weighted logistic loss of one window for each text."""
        p, n, keep = self.p, HIDDEN, {}
        vectors = self.embed(x)
        index, real = self.windows(x, chosen)
        logit = self.forward(vectors, index, real, keep)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((_sigmoid(logit) - labels) * weights / len(labels)).astype(np.float32)
        hh, weight, score = keep["hh"], keep["weight"], keep["score"]
        g["w"], g["c"] = keep["pooled"].T @ d, np.array([d.sum()])
        dpool = d[:, None] * p["w"]
        dweight = np.einsum("bh,tbh->tb", dpool, hh)
        dhh = weight[:, :, None] * dpool[None]
        de = weight * (dweight - (weight * dweight).sum(axis=0)) * real.T
        g["v"] = np.einsum("tb,tbh->h", de, score)
        dpre = de[:, :, None] * p["v"] * (1 - score**2)
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", hh, dpre), dpre.sum(axis=(0, 1))
        dhh = dhh + dpre @ p["A"].T
        dx = np.zeros_like(vectors)
        for k, side in enumerate("fb"):
            u, carry = p[f"U{side}"], 0
            for t, h, r, z, cand, hun in reversed(keep[side]):
                dh = dhh[t, :, k * n : (k + 1) * n] + carry
                dcand = dh * (1 - z) * (1 - cand**2)
                dz = dh * (h - cand) * z * (1 - z)
                dr = dcand * hun * r * (1 - r)
                dproj = np.concatenate([dr, dz, dcand], axis=1)
                dhu = np.concatenate([dr, dz, dcand * r], axis=1)
                g[f"U{side}"] += h.T @ dhu
                g[f"W{side}"] += vectors[index[:, t]].T @ dproj
                g[f"b{side}"] += dproj.sum(axis=0)
                np.add.at(dx, index[:, t], dproj @ p[f"W{side}"].T)
                carry = dh * z + dhu @ u.T
        np.add.at(g["Ew"], x["word"], dx[:, :EMBED])
        np.add.at(g["Ec"], x["gram"], dx[x["gram_word"], EMBED:])
        return g

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, seed: int = 7) -> "Network":
        """Multiple-instance training: each text is judged by its highest window.

        Small samples get more epochs, up to 25.
        """
        rng, step = np.random.default_rng(seed), 0
        labels = labels.astype(np.float32)
        share = labels.mean()
        balance = np.where(labels > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        epochs = max(epochs, -(-150 * batch // max(len(texts), 1))) if len(texts) else 0
        epochs = min(epochs, 25)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                x = self.inputs([texts[i] for i in some])
                logits = self.window_logits(x, self.embed(x))
                chosen = np.lexsort((logits, x["doc"]))
                chosen = chosen[np.append(np.flatnonzero(np.diff(x["doc"][chosen])), len(chosen) - 1)]
                step += 1
                for name, grad in self.gradients(x, chosen, labels[some], balance[some]).items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad**2
                    self.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                self.p["Ec"][0] = 0
        return self


def _narrow(vectors: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the words that a block of windows covers, so that the block stays in cache."""
    blank = len(vectors) - 1
    inner = index[index < blank]
    if not len(inner):
        return vectors[blank:], np.zeros_like(index)
    low, high = inner.min(), inner.max() + 1
    return np.concatenate([vectors[low:high], vectors[blank:]]), np.where(index < blank, index - low, high - low)


def _fold(id_col: "F.Column", folds: int) -> "F.Column":
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    The sample takes up to ``rows`` / 2 texts of each class, in the order of a
    hash of their ids, of at most TRAIN_CHARS characters each; a repeated id
    gives its first text in their order, null text is empty, and of conflicting
    labels 1 holds. Without both classes there is nothing to learn: None.
    """
    own = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows_in = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where(_fold(F.col("doc_id"), 5) != 0)
    own = own.where(_fold(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"))
    picked = own.where("toxic = 1").limit(rows // 2).union(own.where("toxic <> 1").limit(rows // 2))
    # At most `rows` ids: a bounded side.
    sample = rows_in.where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    y = (sample["toxic"].to_numpy() == 1).astype(np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    texts = list(sample["text"])
    return Network(texts, y).fit(texts, y)


def score(docs: DataFrame, model: Network | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double ``name`` from 0 to 1: the highest window's probability.

    A null text counts as empty; a text without words is one blank window.
    Without a model every score is 0. A column called ``name`` is replaced.
    """
    docs = docs.drop(name) if name in docs.columns else docs
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # some 2 MB at most
    schema = T.StructType(list(docs.schema.fields)).add(name, "double")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(shared.value)
        for batch in it:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            values = np.zeros(len(texts))
            for rows in _passes(texts) if net else ():
                values[rows] = _sigmoid(net.document_logits([texts[k] for k in rows]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, name])

    return docs.mapInArrow(batches, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
