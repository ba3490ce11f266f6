"""Image job: fingerprints and technical metrics from decoded pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "sharpness double, exposure double, contrast double, saturation double, edge double"
SCHEMA = f"path string, w int, h int, dhash long, hist array<double>, gray array<double>, tech struct<{METRICS.replace(' double', ':double')}>, failed boolean"


def _clip(x: float) -> float:
    return round(float(min(1.0, max(0.0, x))), 4)


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def resample(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area mean for each target cell: cumulative sums at fractional edges."""
    def along(x: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        edge = np.linspace(0, len(x), n + 1)
        low = np.minimum(edge.astype(int), len(x) - 1)
        at = total[low] + (edge - low)[:, None] * x[low]
        return np.diff(at, axis=0) * n / len(x)

    return along(along(gray.astype(np.float64), height).T, width).T


def dhash(gray: np.ndarray) -> int:
    """64 bits, row by row: set where a cell is brighter than its left neighbour; signed."""
    small = np.rint(resample(gray, 8, 9))
    bits = (small[:, 1:] > small[:, :-1]).reshape(-1)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def technical_metrics(rgb: np.ndarray) -> dict[str, float]:
    """Sharpness, exposure, contrast, saturation and edge energy, each from 0 to 1."""
    gray = luma(rgb)
    out = dict.fromkeys(("sharpness", "exposure", "contrast", "saturation", "edge"), 0.0)
    if not gray.size:
        return out
    dev = abs(gray.mean() - 118)
    out["exposure"] = _clip(1 - dev / 90 if dev <= 70 else 0.25 - (dev - 70) / 800)
    dev = abs(gray.std() - 55)
    out["contrast"] = _clip(1 - dev / 45 if dev <= 35 else 0.25 - (dev - 35) / 600)
    high, low = rgb.max(axis=2), rgb.min(axis=2)
    s = np.divide(high - low, high, out=np.zeros_like(high, dtype=float), where=high > 0).mean()
    out["saturation"] = _clip(s / 0.45 if s <= 0.45 else 1 - (s - 0.45) / 0.55)
    if min(gray.shape) >= 3:
        p = np.pad(gray, 1, mode="edge")
        up, down, left, right = p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]
        out["sharpness"] = _clip(np.log1p((up + down + left + right - 4 * gray).var()) / np.log1p(3000))
        out["edge"] = _clip(np.log1p(np.hypot(down - up, right - left).mean()) / np.log1p(80))
    return out


def fingerprint(rgb: np.ndarray) -> dict:
    """dHash, 48-bin colour histogram (sums to 1), centred unit 32 x 32 gray vector, metrics."""
    gray = luma(rgb)
    counts = np.concatenate([np.histogram(resample(rgb[..., c], 64, 64), bins=16, range=(0, 256))[0] for c in range(3)]).astype(float)
    flat = resample(gray, 32, 32).reshape(-1)
    flat = flat - flat.mean()
    norm = np.linalg.norm(flat)
    return {"dhash": dhash(gray), "hist": np.round(counts / max(counts.sum(), 1), 6).tolist(), "gray": np.round(flat / norm if norm else flat * 0, 4).tolist(), "tech": technical_metrics(rgb)}


def _pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's image bytes (BGR, row by row) as RGB floats."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., 2::-1]


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            base = {"path": r.path, "w": r.width, "h": r.height, "dhash": None, "hist": None, "gray": None, "tech": None, "failed": True}
            if r.nChannels is not None and r.nChannels > 0 and r.data:
                base |= fingerprint(_pixels(r.data, r.height, r.width, r.nChannels)) | {"failed": False}
            rows.append(base)
        yield pd.DataFrame(rows, columns=["path", "w", "h", "dhash", "hist", "gray", "tech", "failed"]).astype({"w": "Int32", "h": "Int32", "dhash": "Int64"})


def image_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, w, h, dhash, hist, gray, tech, failed, md5`` of a folder's images.

    The JVM decodes (png, jpeg, bmp, gif); a file it can't decode is a row with
    failed = true, so that a refresh does not try it again.
    """
    read = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*").withColumnRenamed("origin", "path")
    prints = read.select("path", "width", "height", "nChannels", "data").mapInPandas(_prints, SCHEMA)
    hashes = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.md5("content").alias("md5"))
    return prints.withColumn("file", F.regexp_replace("path", "^file:/+", "/")).join(hashes, "file", "left").drop("file")


def image_metrics(spark: SparkSession, path: str) -> DataFrame:
    return image_fingerprints(spark, path).where("NOT failed").select("path", "w", "h", "tech.*")


def box_pixels(box: Column, width: Column, height: Column) -> Column:
    """``array<int>`` x1, y1, x2, y2 in pixels, or null for a bad box.

    Values up to 1 from 0 on are shares of the image, others pixels. Clamped to
    the image with at least one pixel a side.
    """
    bad = box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: v.isNull() | F.isnan(v))
    x1, y1, x2, y2 = (F.get(box, F.lit(k)) for k in range(4))
    share = (x2 <= 1) & (y2 <= 1) & (x1 >= 0) & (y1 >= 0)
    sx, sy = F.when(share, width).otherwise(1), F.when(share, height).otherwise(1)
    left = F.least(F.greatest(F.floor(x1 * sx), F.lit(0)), width - 1)
    top = F.least(F.greatest(F.floor(y1 * sy), F.lit(0)), height - 1)
    right = F.least(F.greatest(F.floor(x2 * sx), left + 1), width)
    bottom = F.least(F.greatest(F.floor(y2 * sy), top + 1), height)
    return F.when(~bad, F.array(*(v.cast("int") for v in (left, top, right, bottom))))
