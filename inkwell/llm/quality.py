"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Statistics of the whole text (shares of character classes, word lengths, repetition, line shape) are
standardised and mapped by cos(Wx + b), W drawn once from a Gaussian by a fixed seed, which approximates
a Gaussian kernel. Each partition of the training rows sums its part of the normal equations; the sums
are added and solved with a ridge term. Scores of the training rows kept back are then made monotone by
pooling adjacent violators. The model is a few hundred numbers whatever the input.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import checkpoint, least_hashed, slices, text_or_empty

#: Labelled rows that a fit uses at most, those with the least hash of their id.
SAMPLE = 30_000
FOURIER = 384
WIDTH = 0.35
RIDGE = 1e-4
SEED = 20240229
SCORED = "doc_id long, held_out boolean, score double, predicted int"

_CLASSES = ["upper", "lower", "digit", "space", "stop", "exclaim", "bar", "symbol", "high", "newline"]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES)))
    for b in range(256):
        c = chr(b)
        if b >= 128:
            k = "high"
        elif c.isupper():
            k = "upper"
        elif c.islower():
            k = "lower"
        elif c.isdigit():
            k = "digit"
        elif c in ".,;:?":
            k = "stop"
        elif c == "!":
            k = "exclaim"
        elif c == "|":
            k = "bar"
        elif c.isspace():
            k = "space"
        else:
            k = "symbol"
        table[b, _CLASSES.index(k)] = 1
        if c == "\n":
            table[b, _CLASSES.index("newline")] = 1
    return table


_TABLE = _class_table()
N_STATS = len(_CLASSES) + 11


def statistics(text: str) -> np.ndarray:
    """Numbers that describe a text's shape; an empty text has zeros only."""
    out = np.zeros(N_STATS)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return out
    hist = np.bincount(data, minlength=256)
    k = len(_CLASSES)
    out[:k] = np.sqrt(hist @ _TABLE / len(data))
    share = hist[hist > 0] / len(data)
    out[k] = -(share * np.log2(share)).sum()
    out[k + 1] = np.log1p(len(data))
    words = text.split()
    n = len(words)
    if n:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        out[k + 2] = np.log1p(lengths.mean())
        out[k + 3] = np.log1p(lengths.std())
        out[k + 4] = sum(map(operator.eq, words[1:], words)) / n
        out[k + 5] = np.log1p(n / len(set(words)))
        out[k + 6] = (lengths == 1).mean()
        out[k + 7] = sum(w.isupper() for w in words) / n
        out[k + 8] = sum(not w[-1].isalnum() for w in words) / n
    lines = text.split("\n")
    out[k + 9] = np.log1p(len(data) / len(lines))
    out[k + 10] = 1 - len(set(lines)) / len(lines)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.w, self.b)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def fourier(z: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.sqrt(2 / len(b)) * np.cos(np.clip(z, -6, 6) @ w + b)
    return np.hstack([out, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing places and the non-decreasing values between which to interpolate."""
    order = np.argsort(x, kind="stable")
    at, total, weight = [], [], []
    for a, b in zip(x[order], y[order], strict=True):
        at.append(a)
        total.append(b)
        weight.append(1.0)
        while len(at) > 1 and total[-2] * weight[-1] >= total[-1] * weight[-2]:
            w = weight[-2] + weight[-1]
            at[-2:] = [(at[-2] * weight[-2] + at[-1] * weight[-1]) / w]
            total[-2:] = [total[-2] + total[-1]]
            weight[-2:] = [w]
    total, weight = np.asarray(total), np.asarray(weight)
    # a little of the overall rate keeps small blocks off 0 and 1, so that scores still order there
    return np.asarray(at), np.maximum.accumulate((total + y.mean()) / (weight + 1))


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, modulus: int, remainder: int, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows that are not held out: those with the least hash of their id."""
    rows = labels.where(~held_out(modulus, remainder) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return least_hashed(rows.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label")), "__id", sample)


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out (``sample``)."""
    chosen = F.broadcast(labelled_sample(labels, label, modulus, remainder, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(chosen, F.col("doc_id") == F.col("__id")).select("doc_id", "label", "text")
    stats = checkpoint(rows.mapInArrow(_stats_of, "doc_id long, label int, x array<double>"))
    width = N_STATS
    moments = stats.select(F.count("*").alias("n"), F.sum("label").alias("ones"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, WIDTH, (width, FOURIER))
    b = rng.uniform(0, 2 * np.pi, FOURIER)
    if not moments["n"] or moments["ones"] in (0, moments["n"]):  # nothing to learn from
        rate = moments["ones"] / moments["n"] if moments["n"] else 0.5
        return Model(np.zeros(width), np.ones(width), w, b, np.zeros(FOURIER + 1), np.array([0.0]), np.array([rate]))
    mean = np.array([moments[f"m{i}"] for i in range(width)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(width)])
    size = FOURIER + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.zeros((2, size, size)), np.zeros((2, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = fourier((np.array(batch.column("x").to_pylist()) - mean) / scale, w, b)
            y = batch.column("label").to_numpy()
            part = batch.column("part").to_numpy()
            for k in (0, 1):
                a[k] += z[part == k].T @ z[part == k]
                c[k] += z[part == k].T @ y[part == k]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([c.tobytes()])], ["a", "c"])

    # a fifth of the rows is kept back for the calibration; the sample is bounded, and so are these partitions
    parts = stats.withColumn("part", (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0).cast("int"))
    a, c = np.zeros((2, size, size)), np.zeros((2, size))
    for row in parts.select("label", "x", "part").coalesce(16).mapInArrow(sums, "a binary, c binary").collect():
        a += np.frombuffer(row["a"]).reshape(2, size, size)
        c += np.frombuffer(row["c"]).reshape(2, size)
    n = moments["n"]
    beta = np.linalg.solve(a[0] + RIDGE * n * np.eye(size), c[0])
    model = Model(mean, scale, w, b, beta, np.array([0.0]), np.array([0.5]))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(np.array(batch.column("x").to_pylist()))), batch.column("label")], ["r", "label"])

    kept = parts.where("part = 1").select("x", "label").mapInArrow(raw, "r double, label int").toPandas()
    if len(kept):
        model.at, model.value = isotonic(kept["r"].to_numpy(), kept["label"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, modulus: int = 3, remainder: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null text is empty, an id of null is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                s = model.score(np.array([statistics(t) for t in batch.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, SCORED)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores by a model that is fitted on the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    return score(docs, fit(docs, labels))
