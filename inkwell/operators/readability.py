"""Surface proxies of readability: sentence and segment lengths, character coverage, and two relative indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.profiles import Profile
from inkwell.functions.text import letters, mean_of, pieces, ratio, sentences, text, tokens


def lengths(parts: Column) -> Column:
    return F.transform(parts, lambda s: F.length(s).cast("double"))


def scorability(df: DataFrame, p: Profile, id_col: str = "doc_id") -> DataFrame:
    """row_no, scorable, missing_reason: every row stays, with the reason why it has no score."""
    t = text()
    reason = F.when(t == "", "no_text").when(letters(t, p) == 0, "no_letters").when(F.size(sentences(t, p)) < 2, "too_few_sentences")
    return df.select(F.col(id_col).alias("row_no"), reason.isNull().alias("scorable"), reason.alias("missing_reason"))


def sentence_stats(df: DataFrame, p: Profile, pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """n, mean, median and greatest length of the pieces of every row (sentences, unless a pattern is given)."""
    rows = df.select(F.col(id_col).alias("row_no"), F.array_sort(lengths(pieces(text(), pattern or p.sentence))).alias("x"))
    n = F.size("x")
    middle = (F.try_element_at("x", F.floor((n + 1) / 2).cast("int")) + F.try_element_at("x", F.floor(n / 2).cast("int") + 1)) / 2
    return rows.select("row_no", n.cast("long").alias("n"), F.round(mean_of(F.col("x")), 6).alias("mean_length"), F.when(n > 0, middle).alias("p50"), F.array_max("x").alias("longest"))


def coverage(df: DataFrame, p: Profile, id_col: str = "doc_id") -> DataFrame:
    """Shares of the letters that are in the first and the second list of common characters, and in neither."""
    t = F.lower(text())
    n = letters(t, p)
    one, two = (F.length(F.regexp_replace(t, f"[^{chars}]", "")).cast("long") for chars in p.common)
    return df.select(F.col(id_col).alias("row_no"), ratio(one, n).alias("level1"), ratio(two, n).alias("level2"), ratio(n - one - two, n).alias("rare"))


def features(df: DataFrame, p: Profile, id_col: str = "doc_id") -> DataFrame:
    """row_no and the two features of the indices: mean sentence length, and the share of uncommon characters."""
    t = text()
    low = F.lower(t)
    n = letters(low, p)
    common = F.length(F.regexp_replace(low, f"[^{p.common[0] + p.common[1]}]", "")).cast("long")
    return df.select(F.col(id_col).alias("row_no"), F.round(mean_of(lengths(sentences(t, p))), 6).alias("sentence_length"), ratio(n - common, n).alias("uncommon"), F.round(mean_of(lengths(tokens(t, p))), 6).alias("word_length"))
