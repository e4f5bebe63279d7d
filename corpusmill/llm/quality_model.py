"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text's form are cut into bins. Cyclic boosting fits a shallow tree on one feature after the other, again
and again, and adds it to that feature's lookup table; then the same on the pairs of features that explain most of what
is left. A score is the logistic function of one table entry per feature and pair, added up for many rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, held_out, picked, portions

#: Labelled rows that the model is fitted on, about; chosen by a hash of their id.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 6
RATE, LEAST_WEIGHT, RIDGE = 0.15, 2.0, 1.0

FEATURES = (
    "log_words", "mean_word", "long_words", "symbols", "pipes", "exclamations", "digits", "upper", "other_marks",
    "non_ascii", "distinct_words", "doubled_words", "top_word", "log_lines", "words_a_line", "repeated_lines",
)
_UPPER, _DIGITS, _LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(c for c in range(128) if chr(c).isalpha())
_SPACES, _HIGH = b" \t\n\x0b\x0c\r", bytes(range(128, 256))
_SYMBOLS, _ENDS = b"#*$%&<>", b".,"


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; those of a null or empty text are all 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = lambda chars: (size - len(raw.translate(None, chars))) / size
    known: dict[bytes, int] = {}
    for w in words:
        known[w] = known.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = size - size * count(_SPACES)
    shares = [count(_SYMBOLS), raw.count(b"|") / size, raw.count(b"!") / size, count(_DIGITS), count(_UPPER)]
    high = count(_HIGH)
    marks = 1 - count(_SPACES) - count(_LETTERS) - high - sum(shares[:4]) - count(_ENDS)
    return [
        float(np.log1p(n)), solid / n, sum(len(w) > 14 for w in known) / len(known), *shares, max(0.0, marks),
        high, len(known) / n, sum(map(eq, words[1:], words)) / n, max(known.values()) / n,
        float(np.log1p(len(lines))), n / len(lines), 1 - len(set(lines)) / len(lines),
    ]


def _tree(grad: np.ndarray, hess: np.ndarray, splits: int = 3) -> np.ndarray:
    """Values per bin of a tree of ``splits`` greedy cuts along the bins' order, by second-order gain."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    cuts = [0, len(grad)]
    for _ in range(splits):
        best, where = 1e-9, None
        for a, z in zip(cuts, cuts[1:], strict=False):
            at = np.arange(a + 1, z)
            if len(at):
                gl, hl, gr, hr = g[at] - g[a], h[at] - h[a], g[z] - g[at], h[z] - h[at]
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (g[z] - g[a]) ** 2 / (h[z] - h[a] + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = -1
                if gain.max() > best:
                    best, where = gain.max(), int(at[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(grad))
    for a, z in zip(cuts, cuts[1:], strict=False):
        out[a:z] = (g[z] - g[a]) / (h[z] - h[a] + RIDGE)
    return out


def _square(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Values and gain of the best cut of a two-way table into four quadrants."""
    g, h = np.zeros((PAIR_BINS + 1, PAIR_BINS + 1)), np.zeros((PAIR_BINS + 1, PAIR_BINS + 1))
    g[1:, 1:], h[1:, 1:] = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, PAIR_BINS), np.arange(1, PAIR_BINS), indexing="ij"))
    quadrants = []
    for t in (g, h):
        a, b, c = t[i, j], t[i, -1] - t[i, j], t[-1, j] - t[i, j]
        quadrants.append(np.stack([a, b, c, t[-1, -1] - a - b - c]))
    value = quadrants[0] / (quadrants[1] + RIDGE)
    gain = (quadrants[0] * value).sum(0)
    k = int(gain.argmax())
    out = np.empty((PAIR_BINS, PAIR_BINS))
    out[: i[k], : j[k]], out[: i[k], j[k] :], out[i[k] :, : j[k]], out[i[k] :, j[k] :] = value[:, k]
    return out, float(gain[k])


@dataclass
class Model:
    """Bin edges and lookup tables. Without tables, every score is that of the intercept."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edge, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for p in self.pairs for f in p[:2]}
        for a, b, values in self.pairs:
            total += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: a row of features per example; y: 0 or 1. No examples give scores of a half, one class its smoothed share."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return model
    cuts = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
    model.edges, model.pair_edges = cuts(BINS), cuts(PAIR_BINS)
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, values in enumerate(model.tables):
            grad, hess = slopes()
            step = RATE * _tree(np.bincount(bins[f], grad, len(values)), np.bincount(bins[f], hess, len(values)))
            values += step
            total += step[bins[f]]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    flat = lambda a, b: coarse[a] * PAIR_BINS + coarse[b]
    two_way = lambda at, v: np.bincount(at, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    grad, hess = slopes()
    gains = [(_square(two_way(flat(a, b), grad), two_way(flat(a, b), hess))[1], a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, values in model.pairs:
            grad, hess = slopes()
            at = flat(a, b)
            step = RATE * _square(two_way(at, grad), two_way(at, hess))[0]
            values += step
            total += step.ravel()[at]
    return model


def document_features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out and f, the features, for every row."""
    rows = picked(docs, doc_id=F.col(key), held_out=held_out(F.col(key)), text=F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            values = pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["doc_id", "held_out", "f"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, f array<double>")


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` of the documents of ``document_features`` that have a label and aren't held out.

    Null labels and ids teach nothing; a document labelled both ways counts once for each. A document that stands in
    several rows counts once, by the least of their features, so repeated rows can't make the sample larger.
    """
    taught = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("doc_id"), (F.col(label).cast("int") > 0).alias("y")).filter(~held_out(F.col("doc_id"))).distinct()
    share = min(1.0, sample / max(taught.count(), 1))
    chance = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    taught = taught.filter(chance < share)
    known = rows.filter("not held_out").join(taught.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("f").alias("f"))
    got = known.join(taught, "doc_id").select("doc_id", "y", "f").toPandas().sort_values(["doc_id", "y"], kind="stable")
    x = np.array(got["f"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=float))


def predict(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``document_features``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = model.score(np.array(frame["f"].tolist(), dtype=float).reshape(-1, len(FEATURES)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": score, "predicted": (score >= threshold).astype("int32")})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns ``labels.quality`` and scores every row of ``docs``; a null text counts as empty and has a score too.

    One pass over the texts: their features are kept, and both learning and scoring read those. Null ids count as held
    out. Repeated rows give a row each; empty tables an empty one, or scores of a half if only labels are missing.
    """
    rows = cut(document_features(docs))
    return predict(rows, learn(rows, labels))
