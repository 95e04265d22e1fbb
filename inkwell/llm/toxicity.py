"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic documents and unlabelled text. Of clean labels it uses their number alone, for the
class prior, which can be given instead. Words, and
beginnings of words, that are more frequent among the toxic documents than in unlabelled text (by the
G statistic) become features; a linear model on them, in numpy, minimises the risk that is corrected by
the class prior p:  p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)).  Where the second term would
fall below zero, the step goes the other way, as the non-negative estimator asks. The prior is the rate
of toxic rows among the labelled rows that are not held out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import checkpoint, least_hashed, slices, text_or_empty
from inkwell.llm.quality import SCORED, held_out

#: Confirmed toxic and unlabelled documents that a fit uses at most: those with the least hash of their id.
POSITIVE, UNLABELLED = 12_000, 30_000
#: Features of the model; the toxic documents that must have one, and its least G statistic (halved).
FEATURES, SUPPORT, EVIDENCE = 2_048, 4, 7.0
STARTS = (4, 5, 6, 7)
STEPS, RATE, DECAY = 400, 0.1, 3e-4

_WORD = re.compile(r"[^\W_]+")


def terms(text: str) -> set[str]:
    """The words of a text, lower-cased, and their beginnings, marked."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words if len(w) >= 4 for k in STARTS if len(w) >= k}



@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        get = self.weights.get
        f = self.bias
        for w in set(_WORD.findall(text.lower())):
            f += get(w, 0.0)
        # beginnings count once a document, as in training
        for t in {w[:k] + "*" for w in set(_WORD.findall(text.lower())) if len(w) >= 4 for k in STARTS if len(w) >= k}:
            f += get(t, 0.0)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, f))))


class Sparse:
    """Rows of feature numbers, as one array and row bounds."""

    def __init__(self, rows: list[list[int]]):
        self.size = np.array([len(r) for r in rows], dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.size)
        self.index = np.array([i for r in rows for i in r], dtype=np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=len(self.size))

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.index, weights=g[self.row], minlength=width)


def fit_nnpu(positive: Sparse, unlabelled: Sparse, width: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam on all rows."""
    w, b = np.zeros(width), math.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    n_p, n_u = max(1, len(positive.size)), max(1, len(unlabelled.size))
    for t in range(1, steps + 1):
        fp, fu = np.clip(positive.dot(w) + b, -40, 40), np.clip(unlabelled.dot(w) + b, -40, 40)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.log1p(np.exp(fu)).mean() - prior * np.log1p(np.exp(fp)).mean()
        gu, gp_minus, gp_plus = su / n_u, -prior * sp / n_p, prior * (sp - 1) / n_p
        if negative >= 0:
            gp, gu = gp_plus + gp_minus, gu
        else:
            gp, gu = -gp_minus, -gu
        g = np.append(positive.back(gp, width) + unlabelled.back(gu, width) + DECAY * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, positive: int = POSITIVE, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Fit on bounded samples: ``positive`` confirmed toxic documents and ``unlabelled`` documents of any kind, none held out. ``prior`` is the share of toxic text, by default that among the labelled rows."""
    free = ~held_out(modulus, remainder)
    known = labels.where(free & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if prior is None:
        prior = min(0.9, max(0.005, known.select(F.avg(F.col(label).cast("double")).alias("prior")).first()["prior"] or 0.0))
    toxic = least_hashed(known.where(F.col(label) == 1).select(F.col("doc_id").alias("__id")), "__id", positive).withColumn("p", F.lit(1))
    other = least_hashed(docs.where(free & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id")), "__id", unlabelled).withColumn("u", F.lit(1))
    chosen = F.broadcast(toxic.join(other, "__id", "full"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # a text that was copied counts once; what is kept is a bounded list of ids, and the texts are read again where they are needed
    once = texts.join(chosen, F.col("doc_id") == F.col("__id")).groupBy(F.xxhash64("text").alias("h")).agg(F.max("p").alias("p"), F.max("u").alias("u"), F.min("doc_id").alias("__id"))
    once = checkpoint(once.drop("h"))
    rows = texts.join(F.broadcast(once), F.col("doc_id") == F.col("__id")).select("p", "u", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                n: dict[str, list[int]] = {}
                for p, u, text in zip(*(batch.column(c).to_pylist() for c in ("p", "u", "text")), strict=True):
                    for t in terms(text):
                        c = n.setdefault(t, [0, 0])
                        c[0] += p or 0
                        c[1] += u or 0
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([c[0] for c in n.values()], pa.int64()), pa.array([c[1] for c in n.values()], pa.int64())], ["term", "p", "u"])

    total = once.select(F.sum("p").alias("p"), F.sum("u").alias("u")).first()
    n_p, n_u = float(total["p"] or 0), float(total["u"] or 0)
    if not n_p or not n_u:
        return Model({}, math.log(prior / (1 - prior)) if n_u else -4.0)
    by_term = rows.mapInArrow(spread, "term string, p long, u long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= SUPPORT)
    expected_p = (F.col("p") + F.col("u")) * n_p / (n_p + n_u)
    expected_u = (F.col("p") + F.col("u")) * n_u / (n_p + n_u)
    g = F.col("p") * F.log(F.col("p") / expected_p) + F.col("u") * F.log((F.col("u") + 0.5) / expected_u)
    best = by_term.where((F.col("p") / n_p > 3 * F.col("u") / n_u) & (g >= EVIDENCE)).orderBy(g.desc(), "term").limit(FEATURES).select("term")
    names = [r["term"] for r in best.collect()]
    number = {t: i for i, t in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [sorted(number[t] for t in terms(x) if t in number) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("u"), pa.array(found, pa.list_(pa.int32()))], ["p", "u", "x"])

    found = rows.mapInArrow(numbered, "p int, u int, x array<int>").collect()
    w, b = fit_nnpu(Sparse([r["x"] for r in found if r["p"]]), Sparse([r["x"] for r in found if r["u"]]), len(names), prior)
    return Model(dict(zip(names, w.tolist(), strict=True)), b)


def score(docs: DataFrame, model: Model, modulus: int = 4, remainder: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null text is empty, an id of null is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                s = np.array([model.score(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold. Null and empty texts score by the bias alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column(text_col).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores by a model that learns from the toxic rows whose crc32(doc_id) mod 4 is not 2, and unlabelled text."""
    return score(docs, fit(docs, labels))
