"""Toxicity by compression distance: windows are compressed with dictionaries of toxic and of ordinary text.

zstandard's own trainer makes the dictionaries, from all windows of the toxic and of the ordinary training texts. A window is a word
with the spaces around it (of a very long word, each piece), before a marker: zstandard begins no match in the last
bytes of its input and stores what it can't shorten, and the marker, which is in every training window and so in both
dictionaries, takes both away. What a trainer picks beside a class's own words is chance, so there are PAIRS pairs of
dictionaries, each trained without another part of the texts, and a window's distance is the mean over the pairs of
the ordinary length less the toxic one.

Thresholds are calibrated on texts that no dictionary has seen: the distances beyond which given shares of the windows of
ordinary texts lie. A text's score comes from its largest distances and from how many of its windows pass each
threshold, by a logistic regression on the same texts. Distinct windows are compressed once while a worker's table
holds them; the table starts anew when full, which changes no score.

Null and empty texts have no windows and get the score of a text without any distance; repeated rows score
alike; texts of any length are scored whole, in slices of rows bounded in bytes; an empty table gives an empty result;
without labelled rows of both classes every score is 0.5 or that of the one class; labels with a null id or another
value than 0 and 1 are skipped, and of conflicting labels the smaller counts; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import zdict
from corpuslake.llm.common import fold, slices, small_batches

MARKER = bytes(range(128, 144))
PAIRS = 4
DICTIONARY_BYTES, SEGMENT, MATCH = 8_192, 16, 6
LONGEST = 64
#: Shares of ordinary windows below each threshold.
QUANTILES = (0.99, 0.999, 0.9999)
FEATURES = 3 + 2 * len(QUANTILES)
TABLE_LIMIT = 800_000
BLOCK = 4_096


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between white space; words beyond LONGEST bytes in pieces."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if any(len(w) > LONGEST for w in words):
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def window(word: bytes) -> bytes:
    return b" " + word + b" " + MARKER


def dictionary(texts: list[list[bytes]]) -> bytes:
    """What the trainer makes of the windows of these texts; where it has too little to go by, the marker alone."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [window(w) for t in texts for w in t], k=SEGMENT, d=MATCH, f=18, accel=1, level=3, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    fast = {"window_log": 14, "hash_log": 13, "chain_log": 13, "search_log": 5, "min_match": 3, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY2}
    return zdict.compressor(content, trained=True, **fast) if content else zdict.compressor(MARKER, **fast)


class Distances:
    """Distances of windows, each compressed once while it stays in the table."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.toxic, self.ordinary = [compressor(x) for x in toxic], [compressor(x) for x in ordinary]
        self.table: dict[bytes, float] = {}

    def learn(self, texts: list[list[bytes]]) -> None:
        """Compresses the windows of these texts that the table lacks."""
        if len(self.table) > TABLE_LIMIT:
            self.table.clear()
        fresh = list({w for t in texts for w in t} - self.table.keys())
        for at in range(0, len(fresh), BLOCK):
            part = fresh[at : at + BLOCK]
            windows = [window(w) for w in part]
            total = np.zeros(len(part), np.int64)
            for sign, made in ((1, self.ordinary), (-1, self.toxic)):
                for c in made:
                    sizes = c.multi_compress_to_buffer(windows)
                    total += sign * np.fromiter((len(sizes[i]) for i in range(len(part))), np.int64, len(part))
            self.table.update(zip(part, (total / max(len(self.toxic), 1)).tolist()))

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """Of a text whose windows the table has."""
        return np.fromiter(map(self.table.__getitem__, tokens), float, len(tokens))


class Thresholds:
    def __init__(self, ordinary: np.ndarray):
        """From the distances of windows of ordinary texts."""
        self.middle = float(np.median(ordinary)) if len(ordinary) else 0.0
        self.at = [float(x) for x in np.quantile(ordinary, QUANTILES)] if len(ordinary) else [0.0] * len(QUANTILES)

    def features(self, d: np.ndarray) -> list[float]:
        n = len(d)
        if not n:
            return [0.0] * FEATURES
        top = np.sort(np.partition(d, n - min(n, 3))[-3:])[::-1]
        top = np.minimum(top, self.at[-1] + 3) - self.middle
        out = [float(top[min(i, n - 1)]) for i in range(3)]
        for t in self.at:
            beyond = int((d > t).sum())
            out += [(beyond / n) ** 0.5, float(np.log1p(beyond) - 0.5 * np.log1p(n))]
        return out


class Model:
    def __init__(self, sample: list[tuple[int, bool, str]]):
        split = {(k, c): [words_of(t) for label, cal, t in sample if label == k and cal == c] for k in (0, 1) for c in (False, True)}

        def trained(texts: list[list[bytes]]) -> list[bytes]:
            part = [zlib.crc32(b" ".join(t)) % PAIRS for t in texts]
            return [dictionary([t for t, p in zip(texts, part) if p != i]) for i in range(PAIRS)]

        self.toxic, self.ordinary = trained(split[1, False]), trained(split[0, False])
        apart = Distances(self.toxic, self.ordinary)
        apart.learn(split[0, True] + split[1, True])
        found = {k: [apart.of(t) for t in split[k, True]] for k in (0, 1)}
        self.thresholds = Thresholds(np.concatenate([np.empty(0), *found[0]]))
        rows = [self.thresholds.features(d) for k in (0, 1) for d in found[k]]
        self.logistic = zdict.Logistic(np.array(rows, float).reshape(len(rows), FEATURES), np.repeat([0.0, 1.0], [len(found[0]), len(found[1])]))


_distances: dict[tuple, Distances] = {}


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    key = (*model.toxic, *model.ordinary)
    if key not in _distances:
        _distances.clear()
        _distances[key] = Distances(model.toxic, model.ordinary)
    apart = _distances[key]
    tokens = [words_of(t) for t in texts]
    apart.learn(tokens)
    return model.logistic(np.array([model.thresholds.features(apart.of(t)) for t in tokens], float).reshape(len(texts), FEATURES))


def score(docs: DataFrame, model: Model, held_out_remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                s = scores(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return small_batches(docs).select("doc_id", fold("doc_id", held_out_remainder, zdict.FOLDS).alias("held_out"), F.col("text")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(zdict.labelled_sample(docs, labels, "toxic"))
