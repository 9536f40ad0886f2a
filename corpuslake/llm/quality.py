"""Quality by compression: zstandard dictionaries trained on good and on bad text.

A text is cut into windows of whole words; each is compressed with both dictionaries, and the difference of the
sizes over their sum (bad less good) is its normalised difference. A text's score is calibrated from the mean
and the extremes of its windows' differences and from how far the text compresses at all.

Null and empty texts have no window and get the score that calibration gives to no evidence; repeated rows score
alike; texts of any length are scored whole; an empty table gives an empty result; without labelled rows every score is
0.5; labels with a null id or another value than 0 and 1 are skipped, and of conflicting labels the smaller counts;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import zdict
from corpuslake.llm.common import fold, small_batches

WINDOW = 512
DICTIONARY_BYTES = 16_384
CUT = 0.3


def windows(text: str | None) -> list[bytes]:
    """Pieces of about WINDOW bytes, each to the next space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + WINDOW)
        end = end if end >= 0 and end <= at + 2 * WINDOW else at + 2 * WINDOW if at + 2 * WINDOW < len(data) else len(data)
        out.append(data[at:end])
        at = end
    return out


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; where the trainer has too little to go by, none."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b""


class Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (zdict.compressor(x, trained=True) if x else zdict.compressor(b"\0" * 8) for x in (good, bad))

    def features(self, pieces: list[bytes]) -> list[float]:
        if not pieces:
            return [0.0] * 5
        g = np.fromiter((len(self.good.compress(p)) for p in pieces), float, len(pieces))
        b = np.fromiter((len(self.bad.compress(p)) for p in pieces), float, len(pieces))
        d = (b - g) / (b + g)
        n = np.fromiter(map(len, pieces), float, len(pieces))
        return [float((d * n).sum() / n.sum()), float(d.min()), float(d.max()), float(g.sum() / n.sum()), float(b.sum() / n.sum())]


class Model:
    def __init__(self, sample: list[tuple[int, bool, str]]):
        split = {(k, c): [windows(t) for label, cal, t in sample if label == k and cal == c] for k in (0, 1) for c in (False, True)}
        self.good, self.bad = (dictionary([p for t in split[k, False] for p in t]) for k in (1, 0))
        sizes = Sizes(self.good, self.bad)
        rows = [(sizes.features(t), k) for k in (0, 1) for t in split[k, True] if t]
        self.logistic = zdict.Logistic(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float))


_sizes: dict[tuple[bytes, bytes], Sizes] = {}


def score(docs: DataFrame, model: Model, held_out_remainder: int = 0, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text."""
    good, bad, logistic = model.good, model.bad, model.logistic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(b.column(2), good, bad, logistic)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return small_batches(docs).select("doc_id", fold("doc_id", held_out_remainder, zdict.FOLDS).alias("held_out"), F.col("text")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def _scores(texts: pa.Array, good: bytes, bad: bytes, logistic: zdict.Logistic) -> np.ndarray:
    if (good, bad) not in _sizes:
        _sizes.clear()
        _sizes[good, bad] = Sizes(good, bad)
    sizes = _sizes[good, bad]
    x = np.array([sizes.features(windows(t.as_py())) for t in texts], float)
    return logistic(x) if len(x) else np.empty(0)


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the cut."""
    good, bad, logistic = model.good, model.bad, model.logistic
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), good, bad, logistic) >= cut))

    return small_batches(docs).mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(zdict.labelled_sample(docs, labels, "quality"))
