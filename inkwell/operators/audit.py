"""Checks on results: differences of versions, violations of rules, samples to read, extreme rows, and merging by row number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def version_diff(a: DataFrame, b: DataFrame, columns: list[str], key: str = "row_no") -> DataFrame:
    """key, column, before, after of every value that two versions differ in; a row that one lacks differs in all it has."""
    one, other = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]), b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = one.join(other, key, "full")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("string").alias("before"), F.col(f"b_{c}").cast("string").alias("after")) for c in columns])
    return joined.select(key, F.explode(cells).alias("x")).select(key, "x.*").where(~F.col("before").eqNullSafe(F.col("after")))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule (a condition that should hold; null counts as broken)."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return row.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(k))])).alias("rule", "n"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "1") -> DataFrame:
    """The n rows of each stratum whose hash comes first: the same rows whatever the partitioning."""
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("place", F.row_number().over(W.partitionBy(stratum).orderBy(order, key))).where(F.col("place") <= n)


def extremes(df: DataFrame, by: str, n: int, key: str = "row_no") -> DataFrame:
    """The n rows with the greatest value, earlier rows first among equals; nulls last."""
    return df.orderBy(F.desc_nulls_last(by), key).limit(n)


def merge(outputs: list[DataFrame], key: str = "row_no") -> DataFrame:
    """One wide row per key. Columns that two outputs share are an error at once; a key that one of them lacks, or repeats, is one when the rows are made."""
    columns = [c for d in outputs for c in d.columns if c != key]
    if len(set(columns)) < len(columns):
        raise ValueError("outputs share column names")
    once = [d.withColumn(f"__in{i}", F.lit(1)) for i, d in enumerate(outputs)]
    joined = reduce(lambda a, b: a.join(b, key, "full"), once)
    lacking = reduce(lambda a, b: a | b, [F.col(f"__in{i}").isNull() for i in range(len(outputs))])
    checked = F.when(lacking, F.raise_error(F.concat(F.lit("an output lacks the row "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(key))
    again = F.lag(key).over(W.partitionBy(key).orderBy(key)).isNotNull()
    checked = F.when(again, F.raise_error(F.concat(F.lit("an output repeats the row "), F.col(key).cast("string")))).otherwise(checked)
    return joined.select(checked.alias(key), *columns)
