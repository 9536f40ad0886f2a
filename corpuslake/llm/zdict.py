"""What the two compression classifiers share: labelled samples, zstandard compressors, calibration.

Labels are learned only from rows whose crc32 of the id's text leaves no remainder by 5. Of these, remainders 1
to 3 make the dictionaries and remainder 4 calibrates, so that scores are calibrated on texts that no dictionary
has seen.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import fold

FOLDS = 5
#: Bound of the labelled sample: expected rows of each class, and characters of each row (whole texts up to
#: that, else evenly placed pieces). This bounds only what is learned from; every whole text is scored.
ROWS_PER_CLASS = 3_000
CHARS_PER_ROW = 8_000
PIECES = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_CLASS) -> list[tuple[int, bool, str]]:
    """(label, whether it calibrates, text) of a bounded sample of the labelled rows outside the held-out fold."""
    marked = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("labelled_id").isNotNull() & ~fold("doc_id", 0, FOLDS))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    spread = F.pmod(F.xxhash64(F.col("labelled_id"), F.lit(label)), F.lit(1_000_000)) / 1_000_000
    share = F.coalesce(*(F.when(F.col("label") == k, F.lit(rows / n)) for k, n in counts.items()), F.lit(0.0))
    chosen = marked.filter(spread < share).groupBy("labelled_id").agg(F.min("label").alias("label")).limit(4 * rows)
    n = F.length("text")
    step = (n - CHARS_PER_ROW // PIECES) / (PIECES - 1)
    pieces = F.concat_ws("\n", *(F.substring(F.col("text"), (F.lit(i) * step + 1).cast("int"), F.lit(CHARS_PER_ROW // PIECES)) for i in range(PIECES)))
    text = F.when(n <= CHARS_PER_ROW, F.col("text")).otherwise(pieces)
    calibrates = F.pmod(F.crc32(F.col("labelled_id").cast("string").cast("binary")), F.lit(FOLDS)) == FOLDS - 1
    joined = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("labelled_id"), "text").join(F.broadcast(chosen), "labelled_id")  # the limit bounds it
    return sorted((r.label, r.c, r.t) for r in joined.select("label", calibrates.alias("c"), text.alias("t")).limit(8 * rows).collect())


def compressor(content: bytes, *, trained: bool = False, level: int = 3, **params: int) -> zstandard.ZstdCompressor:
    """A compressor whose lengths hold no sizes, checksums or ids; content is a raw or a trained dictionary."""
    quiet = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    made = zstandard.ZstdCompressionParameters.from_level(level, **params, **quiet)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(compression_params=made, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))


class Logistic:
    """Ridge logistic regression by Newton's method; scores of a constant 0.5 where there is nothing to learn from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.5):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (0.0, 1.0)
        k = x.shape[1] if len(x) else 0
        self.w = np.zeros(k + 1)
        if not len(x):
            return
        a = self._design(x)
        penalty = ridge * np.eye(k + 1)
        penalty[k, k] = 1e-6
        if y.min() == y.max():
            self.w[k] = 4.0 if y[0] else -4.0
            return
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(((x - self.mean) / self.scale, np.ones((len(x), 1))), axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self._design(x) @ self.w if len(self.w) > 1 else np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
