"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of widths 2, 3 and 4 slide over windows of a fixed number of bytes; each filter's
maximum over the window goes through a softmax layer. It is trained by Adam on windows of a bounded sample of
labelled texts. Every byte of every text is scored: a text is cut into windows, the last one ending with the
text, and its windows' probabilities are averaged. For scoring, embedding and filters are folded into two tables
over byte pairs, so that a filter's response is the sum of two looked-up rows.

Null texts and texts without a letter are `und` with score 0; so is every text where nothing could be learned.
Rows with a null language are scored and never learned from; repeated rows score alike; of ties between languages the
first by name counts; texts of any length are scored whole, in pieces; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import fold, slices, small_batches

WINDOW = 128
PAD = 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
SPAN = max(WIDTHS)
#: Bytes that are scored at once; a multiple of WINDOW.
PIECE = 4_096 * WINDOW
UNKNOWN = "und"

#: Bound of the sample: expected texts of each language, and windows of each text (placed evenly over all of it).
TEXTS_PER_LANG = 400
WINDOWS_PER_TEXT = 4
STEPS, BATCH, RATE = 500, 96, 0.01


# ---------------------------------------------------------------- windows


def text_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows as byte numbers with PAD behind short texts, the window count of each text); every text has one at least."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(-(-lengths // WINDOW), 1)
    offset = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(texts) else lengths
    buffer = np.frombuffer(b"".join(texts) + b"\0" * WINDOW, np.uint8)
    text = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.minimum(nth * WINDOW, np.maximum(lengths[text] - WINDOW, 0))
    at = start[:, None] + np.arange(WINDOW)
    out = buffer[offset[text][:, None] + at].astype(np.int32)
    out[at >= lengths[text][:, None]] = PAD
    return out, counts


def split_text(data: bytes) -> list[bytes]:
    """Pieces whose windows are those of the whole text: the last window ends with the text."""
    out = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
    if len(out[-1]) < WINDOW:
        out[-1] = data[-WINDOW:]
    return out


# ---------------------------------------------------------------- the network


class Network:
    """Byte embedding, filters of several widths, maximum over positions, softmax."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        k = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, (2 / (SPAN * EMBED)) ** 0.5, (SPAN, EMBED, k)).astype(np.float32)
        self.mask = np.zeros((SPAN, 1, k), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters *= self.mask
        self.bias = np.zeros(k, np.float32)
        self.dense = rng.normal(0, (1 / k) ** 0.5, (k, len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.shift]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy on windows x with class numbers y."""
        n = len(x)
        patches = np.stack([x[:, j : x.shape[1] - SPAN + 1 + j] for j in range(SPAN)], axis=2)
        e = self.embed[patches]
        z = e.reshape(n, -1, SPAN * EMBED) @ self.filters.reshape(SPAN * EMBED, -1)
        top = z.argmax(axis=1)
        h = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + self.bias
        a = np.maximum(h, 0)
        logits = a @ self.dense + self.shift
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        g = (p @ self.dense.T) * (h > 0)
        best = patches[np.arange(n)[:, None], top]  # n, filters, SPAN
        taken = self.embed[best]
        d_filters = np.einsum("nk,nkse->sek", g, taken, optimize=True) * self.mask
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, best, np.einsum("nk,sek->nkse", g, self.filters, optimize=True))
        return [d_embed, d_filters, g.sum(0), a.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.parameters()]
        second = [np.zeros_like(w) for w in self.parameters()]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            for w, g, m, v in zip(self.parameters(), self.gradients(x[pick], y[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of each filter to the first and to the last byte pair of a patch, by pair number."""
        one = [np.einsum("be,ek->bk", self.embed, self.filters[j]) for j in range(SPAN)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape((PAD + 1) ** 2, -1).astype(np.float32)
        return pair(one[0], one[1]), pair(one[2], one[3])


class Scorer:
    """A trained network for many windows."""

    def __init__(self, net: Network):
        self.head, self.tail = net.tables()
        self.net = net

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), 64):
            w = x[at : at + 64]
            pairs = w[:, :-1] * (PAD + 1) + w[:, 1:]
            z = self.head[pairs[:, :-2]]
            z += self.tail[pairs[:, 2:]]
            a = np.maximum(z.max(axis=1) + self.net.bias, 0)
            logits = a @ self.net.dense + self.net.shift
            p = np.exp(logits - logits.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.empty((0, len(self.net.classes)), np.float32)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text's windows; a long text goes through in pieces with the same windows."""
        pieces = [(i, t) for i, text in enumerate(texts) for t in ([text] if len(text) <= PIECE else split_text(text))]
        total, windows = np.zeros((len(texts), len(self.net.classes))), np.zeros(len(texts))
        at = 0
        while at < len(pieces):
            n = 1
            while at + n < len(pieces) and sum(len(t) for _, t in pieces[at : at + n]) < PIECE and n < 64:
                n += 1
            x, counts = text_windows([t for _, t in pieces[at : at + n]])
            sums = np.add.reduceat(self.probabilities(x), np.cumsum(counts) - counts)
            owner = [i for i, _ in pieces[at : at + n]]
            np.add.at(total, owner, sums)
            np.add.at(windows, owner, counts)
            at += n
        return total / np.maximum(windows, 1)[:, None]


# ---------------------------------------------------------------- DataFrames


def training_windows(docs: DataFrame, held_out_remainder: int = 2, modulus: int = 4) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, class numbers and classes of a bounded sample of the labelled texts outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~fold("doc_id", held_out_remainder, modulus))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return np.empty((0, WINDOW), np.int32), np.empty(0, np.int64), []
    shares = F.coalesce(*(F.when(F.col("lang") == k, F.lit(TEXTS_PER_LANG / n)) for k, n in sorted(counts.items())))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) / 1_000_000
    n = F.length("text")
    room = F.greatest(n - WINDOW, F.lit(0))
    places = F.array_distinct(F.array(*((room * i / max(WINDOWS_PER_TEXT - 1, 1)).cast("int") for i in range(WINDOWS_PER_TEXT))))
    pieces = F.transform(places, lambda i: F.substring(F.col("text"), i + 1, F.lit(WINDOW)))
    rows = known.filter(spread < shares).select("lang", pieces.alias("pieces")).limit(4 * TEXTS_PER_LANG * len(counts)).collect()
    classes = sorted(counts)
    number = {k: i for i, k in enumerate(classes)}
    pairs = sorted((p.encode("utf-8", "surrogatepass")[:WINDOW], number[r.lang]) for r in rows for p in r.pieces)
    x, _ = text_windows([p for p, _ in pairs])
    return x, np.array([k for _, k in pairs], np.int64), classes


def learn(docs: DataFrame, held_out_remainder: int = 2, modulus: int = 4) -> Network | None:
    x, y, classes = training_windows(docs, held_out_remainder, modulus)
    if not len(x):
        return None
    net = Network(classes)
    if len(classes) > 1:
        net.train(x, y)
    return net


_scorers: dict[bytes, Scorer] = {}


def identify(docs: DataFrame, net: Network | None, held_out_remainder: int = 2, modulus: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if net is not None:
            key = net.dense.tobytes()
            if key not in _scorers:
                _scorers.clear()
                _scorers[key] = Scorer(net)
            scorer = _scorers[key]
        for b in batches:
            for part in slices(b, 2):
                texts = part.column(2).to_pylist()
                lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if scorer else []
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if lettered:
                    p = scorer.texts([texts[i].encode("utf-8", "surrogatepass") for i in lettered])
                    for i, k, s in zip(lettered, p.argmax(1).tolist(), p.max(1).tolist()):
                        lang[i], score[i] = net.classes[k], min(float(s), 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return small_batches(docs).select("doc_id", fold("doc_id", held_out_remainder, modulus).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
