"""Ratings by rules: a grade beside the anchor word, sentence patterns where there is none, and a status for every row.

Cleaned text in, columns out; nothing shuffles. Interfering phrases (shareholders who buy or sell) are
struck out before matching, which needs no lookbehind. All patterns and the synonyms are our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import any_of, clean, pieces, text

GRADES = any_of(["强烈推荐", "谨慎推荐", "审慎推荐", "谨慎增持", "审慎增持", "强力买入", "买入", "推荐", "增持", "中性", "持有", "卖出", "观望", "减持"])
SYNONYMS = {"强烈推荐": "推荐", "谨慎推荐": "推荐", "审慎推荐": "推荐", "谨慎增持": "增持", "审慎增持": "增持", "强力买入": "买入"}
RULES = {
    "zh": {
        "noise": r"(大股东|控股股东|股东|高管|董事|实际控制人)[^，。；]{0,6}(增持|减持)",
        "anchored": [rf"({GRADES})[”\"」』]?的?(?:投资)?评级?", rf"评级(?:为|至|：|:)*[“\"「『]?({GRADES})"],
        "fallback": [rf"(?:维持|给予|上调至|下调至|首次给予)[^。]{{0,8}}?[“\"「『]?({GRADES})"],
        "declined": r"(未有|未给予|暂不给予|不给予|暂无)[^。]{0,4}评级",
        "action": r"(维持|上调|下调|首次)",
        "sentence": r"[。！？!?\n]+",
        "anchor_word": "评",
    },
    "latin": {
        "noise": r"Released under the Licensed under the",
        "anchored": [r"(?:Released under the|Licensed under the) (MIT|Apache)"],
        "fallback": [r"(?:Released|Licensed) under ([A-Z][A-Z]+)"],
        "declined": r"All rights reserved",
        "action": r"(Released|Licensed)",
        "sentence": r"[!?\n]+",
        "anchor_word": "under",
    },
}


def raw_rating(t: Column, rules: dict) -> Column:
    """The grade as written: the first rule that matches, or null."""
    t = F.regexp_replace(t, rules["noise"], "")
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in rules["anchored"] + rules["fallback"]])


def standard(raw: Column) -> Column:
    pairs = [x for kv in SYNONYMS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, pairs)), raw), raw)


def ratings(df: DataFrame, profile: str, id_col: str = "row_no", text_col: str = "text") -> DataFrame:
    """row_no, raw, std, action, evidence, status for every row. Null or empty text has the status no_text."""
    rules = RULES[profile]
    t = clean(text(text_col))
    bare = F.regexp_replace(t, rules["noise"], "")
    rows = df.select(F.col(id_col).cast("long").alias("row_no"), t.alias("t"), raw_rating(t, rules).alias("raw"), bare.rlike(rules["declined"]).alias("declined"))
    rows = rows.withColumn("raw", F.when(~F.col("declined"), F.col("raw")))
    said = F.filter(pieces(F.col("t"), rules["sentence"]), lambda s: s.contains(F.coalesce(F.col("raw"), F.lit(rules["anchor_word"]))))
    evidence = F.when(F.col("raw").isNotNull() | F.col("declined"), F.try_element_at(said, F.lit(1)))
    status = F.when(F.col("t") == "", "no_text").when(F.col("declined"), "declared_none").when(F.col("raw").isNull(), "missed").otherwise("extracted")
    rows = rows.select("row_no", "raw", standard(F.col("raw")).alias("std"), evidence.alias("evidence"), status.alias("status"))
    action = F.when(F.col("raw").isNotNull(), F.nullif(F.regexp_extract("evidence", rules["action"], 1), F.lit("")))
    return rows.select("row_no", "raw", "std", action.alias("action"), "evidence", "status")


def distribution(rated: DataFrame) -> DataFrame:
    """std, n, pct of the extracted ratings."""
    counts = rated.where("status = 'extracted'").groupBy("std").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("std", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


def coverage(rated: DataFrame) -> DataFrame:
    return rated.agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("extracted", "declared_none", "missed", "no_text")]).withColumn("pct", F.round(F.try_divide(100.0 * F.col("extracted"), F.col("n")), 4))
