"""Reference distributions and component models that are fitted once, kept, and only ever applied afterwards."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = tuple(i / 10 for i in range(1, 10))
#: Parts into which a pass over the values cuts each range that still holds a wanted rank.
BINS = 4_096
SCHEMAS = {"quantiles": "metric string, edges array<double>", "moments": "metric string, mean double, std double", "components": "metric string, mean double, std double, loading double"}


def quantiles(df: DataFrame, metrics: list[str], steps: Sequence[float] = STEPS) -> dict[str, list[float | None]]:
    """The exact quantiles of every metric (between two values in proportion), all None of a metric without values.

    The values are not brought together anywhere: each pass counts them in ``BINS`` parts of the ranges that hold a
    wanted rank, until all values of such a part are the same. What comes to the driver are counts of parts.
    """
    values = df.select(*[F.col(m).cast("double").alias(m) for m in metrics]).persist()
    try:
        row = values.agg(*[x for i, m in enumerate(metrics) for x in (F.count(m).alias(f"n{i}"), F.min(m).alias(f"lo{i}"), F.max(m).alias(f"hi{i}"))]).first()
        n = [row[f"n{i}"] for i in range(len(metrics))]
        ranks = [sorted({r for s in steps for r in (math.floor((k - 1) * s), math.ceil((k - 1) * s))}) if k else [] for k in n]
        found: list[dict[int, float]] = [{} for _ in metrics]
        #: ranges by metric: least and greatest value, how many values are below, the ranks in it
        open_ = [[(row[f"lo{i}"], row[f"hi{i}"], 0, r)] if r else [] for i, r in enumerate(ranks)]
        while True:
            for i, parts in enumerate(open_):
                found[i].update({r: lo for lo, hi, _, rs in parts if lo == hi for r in rs})
                open_[i] = [x for x in parts if x[0] < x[1]]
            if not any(open_):
                break
            cells = []
            for i, parts in enumerate(open_):
                for k, (lo, hi, _, _) in enumerate(parts):
                    x = F.col(metrics[i])
                    # scaled before the difference is taken, so that no range is too wide for a double
                    part = F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS), F.lit(BINS - 1))
                    cells.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), part.cast("int").alias("part"), x.alias("x"))))
            counted = values.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.i", "c.k", "c.part").agg(F.count("*").alias("n"), F.min("c.x").alias("lo"), F.max("c.x").alias("hi")).collect()
            by: dict[tuple[int, int], list] = {}
            for c in sorted(counted, key=lambda c: (c["i"], c["k"], c["part"])):
                by.setdefault((c["i"], c["k"]), []).append(c)
            new: list[list] = [[] for _ in metrics]
            for (i, k), own in by.items():
                _, _, below, rs = open_[i][k]
                for c in own:
                    if mine := [r for r in rs if below <= r < below + c["n"]]:
                        new[i].append((c["lo"], c["hi"], below, mine))
                    below += c["n"]
            open_ = new
    finally:
        values.unpersist()

    def at(i: int, s: float) -> float | None:
        if not n[i]:
            return None
        place = (n[i] - 1) * s
        a, b = found[i][math.floor(place)], found[i][math.ceil(place)]
        return a if a == b else a + (b - a) * (place - math.floor(place))

    return {m: [at(i, s) for s in steps] for i, m in enumerate(metrics)}


def fit_quantiles(df: DataFrame, metrics: list[str], eligible: Column | None = None) -> DataFrame:
    """metric, edges: the exact deciles of every metric over the eligible rows. One row per metric, to be saved and kept."""
    edges = quantiles(df if eligible is None else df.where(eligible), metrics)
    return df.sparkSession.createDataFrame([(m, e) for m, e in edges.items() if e[0] is not None], SCHEMAS["quantiles"])


def fit_moments(df: DataFrame, metrics: list[str], eligible: Column | None = None) -> DataFrame:
    """metric, mean, std over the eligible rows."""
    rows = df if eligible is None else df.where(eligible)
    row = rows.agg(*[x for m in metrics for x in (F.avg(m).alias(f"m_{m}"), F.stddev_pop(m).alias(f"s_{m}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m_{m}").alias("mean"), F.col(f"s_{m}").alias("std")) for m in metrics])).alias("x")).select("x.*")


def save(model: DataFrame, path: str) -> None:
    """Keep a fitted table. A path that holds one already is an error: a reference is fitted once."""
    model.coalesce(1).write.mode("error").parquet(path)


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A kept table of a kind (quantiles, moments, components). One that is not there is an error."""
    return spark.read.schema(SCHEMAS[kind]).parquet(path)


def z_scores(frozen: DataFrame, metrics: list[str]) -> dict[str, Column]:
    """The distance of each metric from its kept mean, in kept deviations; null where the deviation is 0."""
    kept = {r["metric"]: r for r in frozen.where(F.col("metric").isin(metrics)).collect()}
    if missing := [m for m in metrics if m not in kept]:
        raise ValueError(f"no frozen moments for {missing}")
    return {m: F.try_divide(F.col(m) - F.lit(kept[m]["mean"]), F.lit(kept[m]["std"])) for m in metrics}


def rank(value: Column, edges: Column) -> Column:
    """How many of the edges a value reaches, as a share; null stays null."""
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: e <= value)) / F.size(edges))


def apply_quantiles(df: DataFrame, frozen: DataFrame, metrics: list[str]) -> DataFrame:
    """Adds <metric>_rank of every metric. A metric that the frozen table lacks is an error: nothing is fitted here."""
    kept = {r["metric"]: r["edges"] for r in frozen.where(F.col("metric").isin(metrics)).collect()}
    if missing := [m for m in metrics if kept.get(m) is None]:
        raise ValueError(f"no frozen quantiles for {missing}")
    return df.withColumns({f"{m}_rank": F.round(rank(F.col(m), F.array(*map(F.lit, kept[m]))), 6) for m in metrics})


def complete(df: DataFrame, metrics: list[str]) -> DataFrame:
    """The metrics, all null in rows that lack one. Not a filter, which Spark would move below the columns that make the metrics, with all their work written out again inside it, once for every sentence."""
    whole = F.lit(True)
    for m in metrics:
        whole = whole & F.col(m).isNotNull() & ~F.isnan(m)
    return df.select(*[F.when(whole, F.col(m)).alias(m) for m in metrics])


def fit_pca(df: DataFrame, metrics: list[str]) -> list[tuple[str, float, float, float]]:
    """(metric, mean, std, loading) of the first component of the complete rows' correlations; the largest loading is positive."""
    rows = complete(df, metrics)
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i:]]
    got = rows.agg(*[F.avg(m).alias(f"m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"s_{m}") for m in metrics], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).first()
    std = [got[f"s_{m}"] or 1.0 for m in metrics]
    c = np.zeros((len(metrics), len(metrics)))
    for a, b in pairs:
        i, j = metrics.index(a), metrics.index(b)
        c[i, j] = c[j, i] = (got[f"c_{a}_{b}"] or 0.0) / std[i] / std[j]
    v = np.linalg.eigh(c)[1][:, -1]
    v = v * np.sign(v[np.argmax(np.abs(v))])
    return [(m, float(got[f"m_{m}"] or 0.0), float(s), float(x)) for m, s, x in zip(metrics, std, v, strict=True)]


def pca_score(model: list[tuple[str, float, float, float]]) -> Column:
    """The score of a row by a kept model; null if a metric is."""
    total = F.lit(0.0)
    for metric, mean, std, loading in model:
        total = total + (F.col(metric) - F.lit(mean)) / F.lit(std) * F.lit(loading)
    return F.round(total, 6)
