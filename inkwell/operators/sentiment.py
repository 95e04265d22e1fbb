"""Lexicon sentiment under three calibers: raw, with negation, and of the body without the routine section.

Tokens stay in arrays and lists become hash sets of the plan, so scoring is one pass over the texts
without a shuffle; hits are found in the sentence they stand in, for the negators before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.profiles import Profile
from inkwell.functions.text import letters, occurrences, per_thousand, ratio, sentences, text, tokens
from inkwell.operators.frozen import quantiles

#: Tokens before a hit in which negators count; an odd number of them flips it.
REACH = 3
CALIBERS = ("raw", "negated", "body")


def body(t: Column, p: Profile) -> Column:
    """The text without its routine paragraphs."""
    kept = F.filter(F.split(t, p.paragraph), lambda x: ~x.rlike(p.routine))
    return F.array_join(kept, "\n")


def hits(t: Column, p: Profile) -> Column:
    """Every list word in order: word, sign (1 or -1), flipped."""
    listed = p.positive + p.negative

    def of_sentence(words: Column) -> Column:
        # words is a variable here, so that a sentence is cut into tokens once, and negators are looked for beside hits only
        before = lambda i: F.filter(F.slice(words, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), lambda x: x.isin(*p.negators))
        hit = lambda w, i: F.struct(w.alias("word"), F.when(w.isin(*p.positive), 1).otherwise(-1).alias("sign"), (F.size(before(i)) % 2 == 1).alias("flipped"))
        return F.filter(F.transform(words, lambda w, i: F.when(w.isin(*listed), hit(w, i))), lambda h: h.isNotNull())

    return F.flatten(F.transform(F.transform(sentences(t, p), lambda s: tokens(s, p)), of_sentence))


def without(t: Column, company: Column | None) -> Column:
    """The text without a company's name, which may hold list words; a null or empty name leaves it as it is."""
    return t if company is None else F.when(F.length(company) > 0, F.replace(t, company, F.lit(""))).otherwise(t)


def counts(df: DataFrame, p: Profile, id_col: str = "doc_id", text_col: str = "text", company_col: str | None = None) -> DataFrame:
    """Positive and negative hits by caliber, letters, and the hits themselves (h, and b of the body), of every row; a column may name the company whose name is no hit."""
    t = text(text_col)
    scored = without(t, F.col(company_col) if company_col else None)
    rows = df.select(F.col(id_col).alias("row_no"), letters(t, p).alias("letters"), hits(scored, p).alias("h"), hits(body(scored, p), p).alias("b"))

    def n(column: str, sign: int, negated: bool) -> Column:
        keep = lambda h: (h["sign"] * F.when(h["flipped"], -1).otherwise(1) == sign) if negated else (h["sign"] == sign)
        return F.size(F.filter(column, keep)).cast("long")

    return rows.select("row_no", "letters", n("h", 1, False).alias("pos_raw"), n("h", -1, False).alias("neg_raw"), n("h", 1, True).alias("pos_negated"), n("h", -1, True).alias("neg_negated"), n("b", 1, True).alias("pos_body"), n("b", -1, True).alias("neg_body"), "h", "b")


def _measures(caliber: str) -> dict[str, Column]:
    pos, neg, letter = F.col(f"pos_{caliber}"), F.col(f"neg_{caliber}"), F.col("letters")
    polarity = F.when(letter == 0, None).when(pos > neg, "positive").when(pos < neg, "negative").otherwise("neutral")
    return {"net": pos - neg, "ratio": ratio(pos, pos + neg), "density": per_thousand(pos + neg, letter), "polarity": polarity}


def scores(counted: DataFrame, caliber: str = "raw") -> DataFrame:
    """net, ratio (null without hits), density and polarity (null without letters) of a caliber."""
    return counted.select("row_no", "letters", *[c.alias(name) for name, c in _measures(caliber).items()])


def wide(counted: DataFrame) -> DataFrame:
    """28 columns per row: letters, flipped hits and hits of the routine section; of each caliber positive and negative hits, hits, net, ratio, density, polarity, and the words hit in order, flipped ones behind a minus."""
    words = lambda h, marked: F.array_join(F.transform(h, lambda x: F.concat(F.when(x["flipped"], "-").otherwise("") if marked else F.lit(""), x["word"])), " ")
    out = [F.size(F.filter("h", lambda x: x["flipped"])).cast("long").alias("flipped"), (F.size("h") - F.size("b")).cast("long").alias("routine")]
    for c in CALIBERS:
        pos, neg = F.col(f"pos_{c}"), F.col(f"neg_{c}")
        out += [pos, neg, (pos + neg).alias(f"hits_{c}"), *[x.alias(f"{name}_{c}") for name, x in _measures(c).items()], words("b" if c == "body" else "h", c != "raw").alias(f"words_{c}")]
    return counted.select("row_no", "letters", *out)


def summary(scored: DataFrame) -> DataFrame:
    """Mean and median of the net value, and the median ratio; one row."""
    middle = quantiles(scored, ["net", "ratio"], [0.5])
    median = lambda m: F.lit(middle[m][0]).cast("double")
    return scored.agg(F.round(F.avg("net"), 6).alias("mean_net")).select("mean_net", median("net").alias("median_net"), F.round(median("ratio"), 6).alias("median_ratio"))


def baseline(df: DataFrame, p: Profile) -> DataFrame:
    """The share that a random draw from the lists would give, and the median ratio against it; one row."""
    share = len(p.positive) / (len(p.positive) + len(p.negative))
    (m,) = quantiles(scores(counts(df, p)), ["ratio"], [0.5])["ratio"]
    row = (round(share, 6), None if m is None else round(m, 6), None if m is None else round(m / share, 6))
    return df.sparkSession.createDataFrame([row], "baseline double, observed double, times double")


def location_share(df: DataFrame, p: Profile, word: str, id_col: str = "doc_id") -> DataFrame:
    """Share of a word's occurrences that stand in routine paragraphs, and of rows that have the word."""
    t = text()
    everywhere, outside = occurrences(tokens(t, p), [word]), occurrences(tokens(body(t, p), p), [word])
    return df.select(everywhere.alias("a"), outside.alias("o")).agg(F.sum("a").alias("n"), F.round(F.try_divide(F.sum(F.col("a") - F.col("o")).cast("double"), F.sum("a").cast("double")), 6).alias("in_routine"), F.round(F.try_divide(F.count_if(F.col("a") > 0).cast("double"), F.count("*").cast("double")), 6).alias("of_rows"))
