"""Word expansion: PPMI context vectors, and the nearest words to the seeds of a dimension, for review only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.profiles import Profile
from inkwell.functions.text import text, tokens


def pair_counts(df: DataFrame, p: Profile, reach: int = 2, least: int = 5) -> DataFrame:
    """w, ctx, n: ordered pairs of tokens at most ``reach`` apart, in both directions, that occur ``least`` times.

    Pairs are made inside each row's array; only counts of unordered pairs are shuffled.
    """
    rows = df.select(tokens(text(), p).alias("w"))
    apart = [F.transform(F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))), lambda b, i: F.struct(F.least(b, F.get("w", i)).alias("a"), F.greatest(b, F.get("w", i)).alias("b"))) for k in range(1, reach + 1)]
    once = rows.select(F.explode(F.concat(*apart)).alias("x")).select("x.a", "x.b").groupBy("a", "b").agg(F.count("*").alias("n"))
    # a pair of equal words counts in both directions
    once = once.withColumn("n", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))).where(F.col("n") >= least)
    both = F.array_distinct(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("ctx")), F.struct(F.col("b").alias("w"), F.col("a").alias("ctx"))))
    return once.select(F.explode(both).alias("x"), "n").select("x.w", "x.ctx", "n")


def ppmi(pairs: DataFrame) -> DataFrame:
    """w, ctx, ppmi: positive pointwise mutual information, 6 places."""
    words = pairs.groupBy("w").agg(F.sum("n").alias("n_w"))
    total = F.broadcast(pairs.agg(F.sum("n").alias("total")))
    joined = pairs.join(words, "w").join(words.select(F.col("w").alias("ctx"), F.col("n_w").alias("n_ctx")), "ctx").crossJoin(total)
    value = F.log2(F.col("n").cast("double") * F.col("total") / (F.col("n_w").cast("double") * F.col("n_ctx")))
    return joined.select("w", "ctx", F.round(F.greatest(value, F.lit(0.0)), 6).alias("ppmi"))


def candidates(vectors: DataFrame, seeds: list[str], known: list[str], top: int = 10) -> DataFrame:
    """seed, w, cosine, place: the words nearest to each seed by their vectors; known words are left out, nothing is scored."""
    norms = vectors.groupBy("w").agg(F.sqrt(F.sum(F.col("ppmi") * F.col("ppmi"))).alias("norm"))
    own = vectors.where(F.col("w").isin(*seeds)).select(F.col("w").alias("seed"), "ctx", F.col("ppmi").alias("v"))
    dots = own.join(vectors.where(~F.col("w").isin(*known)), "ctx").groupBy("seed", "w").agg(F.sum(F.col("v") * F.col("ppmi")).alias("dot"))
    cosine = F.round(F.try_divide("dot", F.col("norm") * F.col("seed_norm")), 5)
    scored = dots.join(norms, "w").join(norms.select(F.col("w").alias("seed"), F.col("norm").alias("seed_norm")), "seed").select("seed", "w", cosine.alias("cosine")).where("cosine > 0")
    place = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("cosine"), "w"))
    return scored.withColumn("place", place).where(F.col("place") <= top)
