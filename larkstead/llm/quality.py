"""Quality classifier by Bradley-Terry pairwise ranking.

A text's strength is linear in features of its characters and words. It is learned from preference
pairs (a text labelled 1 over one labelled 0): logistic loss on feature differences, by Newton's
method. A text passes above a threshold, the quantile of the sample's strengths that errs least.
The score is the logistic of strength minus threshold, so 0.5 is the threshold.

Only the fit uses a sample: at most ``SAMPLE_ROWS`` labelled rows. Every row is scored from its
own text: no shuffle. Null texts are empty and get a score; repeated rows and ids get a row each;
an empty table gives no rows. Where all usable labels are one class, every score is that class's
share, smoothed (below 0.5 for 0, above for 1); without usable labels it is 0.5. A column named as
the score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, others, slices, texts_of
from .labelled import sample

#: Labelled rows that the fit uses at most, and preference pairs drawn from them.
SAMPLE_ROWS = 20_000
PAIRS = 60_000
RIDGE = 1e-3

_GROUPS = np.zeros((256, 9))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#$%&*@~^_=+<>\\/{}[]", b"!?", b"|", b".,;:")):
    _GROUPS[list(_chars), _i] = 1


def features(text: bytes) -> list[float]:
    """Shares of kinds of characters, and what repeats, of one text."""
    words = text.split()
    if not words:
        return [0.0] * 15 + [1.0]
    upper, lower, digit, _, line, symbol, shout, bar, stop = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _GROUPS).tolist()
    n, chars = len(words), sum(map(len, words))
    distinct = len(set(words)) / n
    again = sum(map(eq, words, words[1:])) / n
    return [
        upper / chars, min(1.0, 2 * upper / (upper + lower + 1)), digit / chars, min(1.0, 10 * digit / chars), symbol / chars, min(1.0, 10 * symbol / chars),
        min(1.0, 5 * shout / n), min(1.0, 4 * bar / n), min(1.0, stop / n), min(1.0, line / n),
        min(1.0, chars / n / 20), distinct, min(1.0, distinct * n**0.5 / 8), min(1.0, 5 * again), min(1.0, np.log1p(n) / 8), 0.0,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - self.strength(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 3) -> Model:
    """Bradley-Terry strengths from pairs (labelled 1, labelled 0), and the threshold quantile."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(16), np.ones(16))
    model = Model(mean, scale, np.zeros(len(mean)), 0.0)
    if not len(good) or not len(bad):
        model.threshold = float(np.log((len(bad) + 0.5) / (len(good) + 0.5)))
        return model
    rng = np.random.default_rng(seed)
    z = ((x - mean) / scale).clip(-8, 8)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = model.weights
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = np.sort(model.strength(x))
    order = np.argsort(model.strength(x), kind="stable")
    # Errors if the lowest i are rejected: good ones among them and bad ones above.
    errors = np.concatenate([[0], np.cumsum(y[order] == 1)]) + (len(bad) - np.concatenate([[0], np.cumsum(y[order] == 0)]))
    i = int(np.argmin(errors))
    model.threshold = float((s[max(i - 1, 0)] + s[min(i, len(s) - 1)]) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_column: str = "quality", rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """A model from at most ``rows`` labelled documents."""
    label = sample(labels, label_column, usable, rows, id_column)
    wanted = docs.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"))

    def take(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            own = [i for i, x in enumerate(ids) if x in label]
            texts = texts_of(batch.column(1).take(pa.array(own, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), pa.array([features(t) for t in texts], pa.list_(pa.float64()))], names=["i", "x"])

    schema = T.StructType([wanted.schema[0], T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = map_batches(wanted, take, schema).groupBy("i").agg(F.min("x").alias("x")).orderBy("i").collect() if label else []
    return fit(np.array([r["x"] for r in found]).reshape(-1, 16), np.array([label[r["i"]] for r in found]))


def score(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """docs, all columns as they are, with a score column."""
    docs = others(docs, score_column)
    names = [*docs.columns, score_column]
    at = docs.columns.index(text_column)

    def rate(batches):
        for batch in batches:
            texts = texts_of(batch.column(at))
            x = np.array([features(t) for a, b in slices([len(t) for t in texts]) for t in texts[a:b]]).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=names)

    return map_batches(docs, rate, T.StructType(docs.schema.fields + [T.StructField(score_column, T.DoubleType())]))
