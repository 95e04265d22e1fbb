"""Tone by versioned word lists: hits, densities, sentence shares, a cautious caliber, evidence with places, and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.profiles import DECISIONS, Profile, tone_words
from inkwell.functions.text import letters, occurrences, per_thousand, ratio, sentences, text, tokens

DIMS = ("strength", "extremity", "certainty", "vagueness", "hyperbole")
#: Tokens of a text whose hits are placed together.
BLOCK = 512


def by_dim(p: Profile, version: int) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {d: [] for d in DIMS}
    for w, d in tone_words(p, version):
        out[d].append(w)
    return out


def mask(t: Column, p: Profile) -> Column:
    """Names of grades overwritten by as many fillers, so that places stay what they are."""
    for phrase in p.masks:
        t = F.replace(t, F.lit(phrase), F.lit("#" * len(phrase)))
    return t


def cautious(words: Column, wanted: list[str], p: Profile) -> Column:
    """Hits that no context word stands before."""
    marked = F.transform(words, lambda w, i: w.isin(*wanted) & ~F.coalesce(F.try_element_at(words, F.when(i > 0, i).otherwise(F.lit(-1000000))).isin(*p.context), F.lit(False)))
    return F.size(F.filter(marked, lambda x: x)).cast("long")


def scores(df: DataFrame, p: Profile, version: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Hits of every dimension in the masked text, and letters."""
    rows = df.select(F.col(id_col).alias("row_no"), letters(text(), p).alias("letters"), tokens(mask(text(), p), p).alias("w"))
    return rows.select("row_no", "letters", *[occurrences(F.col("w"), ws).alias(d) for d, ws in by_dim(p, version).items()])


def _holding(parts: Column, wanted: list[str]) -> Column:
    """How many of the token arrays hold a word of a list."""
    return F.size(F.filter(parts, lambda x: F.exists(x, lambda w: w.isin(*wanted)))).cast("long")


def wide(df: DataFrame, p: Profile, version: int = 2, id_col: str = "doc_id") -> DataFrame:
    """34 columns per row: letters, words and sentences; of each dimension hits, density, share of sentences, share of hits, the cautious hits and their density; and the share of certain among certain and vague hits."""
    t = mask(text(), p)
    lists = by_dim(p, version)
    listed = [w for ws in lists.values() for w in ws]
    rows = df.select(F.col(id_col).alias("row_no"), letters(text(), p).alias("letters"), tokens(t, p).alias("w"), F.transform(sentences(t, p), lambda s: tokens(s, p)).alias("s"))
    rows = rows.withColumn("all_hits", occurrences(F.col("w"), listed))
    for d, ws in lists.items():
        rows = rows.withColumns({d: occurrences(F.col("w"), ws), f"{d}_in": _holding(F.col("s"), ws), f"{d}_cautious": cautious(F.col("w"), ws, p)})
    per_dim = [x for d in lists for x in (F.col(d), per_thousand(F.col(d), F.col("letters")).alias(f"{d}_density"), ratio(F.col(f"{d}_in"), F.size("s")).alias(f"{d}_sentences"), ratio(F.col(d), F.col("all_hits")).alias(f"{d}_share"), F.col(f"{d}_cautious"), per_thousand(F.col(f"{d}_cautious"), F.col("letters")).alias(f"{d}_cautious_density"))]
    return rows.select("row_no", "letters", F.size("s").cast("long").alias("n_sentences"), *per_dim, ratio(F.col("certainty"), F.col("certainty") + F.col("vagueness")).alias("certain_of_both"))


def hit_places(df: DataFrame, p: Profile, version: int = 1, id_col: str = "doc_id") -> DataFrame:
    """row_no, word, dim, start, end (from 0, in the raw text) and a snippet for every hit; of rows that share an id (or have none) the lengths of all are added up, as the SQL does."""
    ids = F.col(id_col)
    again = df.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(ids.alias("again"))
    if again.isEmpty():
        return _places(df, p, version, id_col)
    same = ids.eqNullSafe(F.col("again"))
    return _places(df.join(again, same, "left_anti"), p, version, id_col).unionByName(_shared_places(df.join(again, same, "left_semi"), p, version, id_col))


def _shared_places(df: DataFrame, p: Profile, version: int, id_col: str) -> DataFrame:
    """As ``hit_places``, by bringing the rows of an id together."""
    rows = df.select(F.col(id_col).alias("row_no"), text().alias("t"))
    parts = rows.select("row_no", "t", F.posexplode(F.regexp_extract_all(mask(F.col("t"), p), F.lit(rf"([^\p{{L}}]*)({p.token})"), F.lit(0))).alias("k", "part"))
    upto = F.sum(F.length("part")).over(W.partitionBy("row_no").orderBy("k").rangeBetween(W.unboundedPreceding, 0))
    placed = parts.withColumn("end", upto).withColumn("word", F.regexp_extract(F.lower("part"), f"({p.token})$", 1))
    dims = F.create_map(*[F.lit(x) for w, d in tone_words(p, version) for x in (w, d)])
    found = placed.where(F.col("word").isin(*[w for w, _ in tone_words(p, version)])).withColumn("start", F.col("end") - F.length("word"))
    return found.select("row_no", "word", F.try_element_at(dims, F.col("word")).alias("dim"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.substring("t", F.greatest(F.col("start") - 9, F.lit(1)).cast("int"), F.length("word") + 20).alias("snippet"))


def _places(df: DataFrame, p: Profile, version: int, id_col: str) -> DataFrame:
    """As ``hit_places``, for rows whose id is their own.

    Row by row: the tokens of a text, each with what stands before it, are cut into blocks; a block has its place
    and its part of the raw text, so that neither is looked for from the beginning of the text for every hit.
    """
    listed = tone_words(p, version)
    # what is left at the end is a part without a word
    parts = F.regexp_extract_all(mask(F.col("t"), p), F.lit(rf"([^\p{{L}}]*+)({p.token}|\z)"), F.lit(0))
    entry = lambda x: F.struct(F.length(x).alias("n"), F.regexp_extract(F.lower(x), f"({p.token})$", 1).alias("word"))
    rows = df.select(F.col(id_col).alias("row_no"), text().alias("t")).withColumn("parts", F.transform(parts, entry))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("parts") / BLOCK).cast("int")), lambda k: F.slice("parts", k * BLOCK + 1, F.lit(BLOCK)))

    def after(done: Column, block: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))
        size = F.aggregate(block, F.lit(0), lambda n, x: n + x["n"])
        return F.concat(done, F.array(F.struct(block.alias("parts"), start.alias("start"), (start + size).alias("end"))))

    def with_text(block: Column) -> Column:
        base = F.greatest(block["start"] - 10, F.lit(0))
        # a snippet begins 10 before its word, or with the text, and is 20 longer than it
        return F.struct(block["parts"].alias("parts"), block["start"].alias("start"), base.alias("base"), F.substring(F.col("t"), base + 1, block["end"] - base + 20).alias("raw"))

    def in_block(block: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            end = a["end"] + x["n"]
            return F.struct(end.alias("end"), F.when(x["word"].isin(*[w for w, _ in listed]), F.concat(a["hits"], F.array(F.struct(x["word"].alias("word"), end.alias("end"))))).otherwise(a["hits"]).alias("hits"))

        def hit(h: Column) -> Column:
            start = h["end"] - F.length(h["word"])
            snippet = F.substring(block["raw"], F.greatest(start - 10, F.lit(0)) - block["base"] + 1, F.length(h["word"]) + 20)
            return F.struct(h["word"].alias("word"), start.alias("start"), h["end"].alias("end"), snippet.alias("snippet"))

        none = F.array().cast("array<struct<word:string,end:int>>")
        return F.transform(F.aggregate(block["parts"], F.struct(block["start"].alias("end"), none.alias("hits")), step)["hits"], hit)

    placed = F.aggregate(blocks, F.array().cast("array<struct<parts:array<struct<n:int,word:string>>,start:int,end:int>>"), after)
    hits = F.flatten(F.transform(F.transform(placed, with_text), in_block))
    # outer, as Spark would else make the hits once more for a filter
    found = rows.select("row_no", F.explode_outer(hits).alias("h")).where(F.col("h").isNotNull())
    dims = F.create_map(*[F.lit(x) for w, d in listed for x in (w, d)])
    return found.select("row_no", "h.word", F.try_element_at(dims, F.col("h.word")).alias("dim"), F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), "h.snippet")


def lexicon(spark: SparkSession, p: Profile, version: int = 1) -> DataFrame:
    return spark.createDataFrame(tone_words(p, version), "word string, dim string")


def calibrate(words: DataFrame, decisions: DataFrame) -> DataFrame:
    """The list after word-by-word decisions (word, action, new_dim): removals go, a new dimension replaces the old."""
    joined = words.join(decisions, "word", "left").where(F.coalesce("action", F.lit("keep")) != "remove")
    return joined.select("word", F.when(F.col("action") == "redim", F.col("new_dim")).otherwise(F.col("dim")).alias("dim"), F.coalesce("action", F.lit("keep")).alias("action"))


def decisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DECISIONS), "word string, action string, new_dim string")
