"""From raw documents to packed training sequences: five stages, each one of the operators of ``inkwell.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Toxic documents go;
of equal texts one stays; of near duplicates the one with the least doc_id stays; words of passages that
occur in an earlier document go (a document that loses all its words stays, with an empty text); what is
left is packed. All stages but the last return the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from inkwell.llm.toxicity import fit, without_toxic

    docs = docs.select(*COLUMNS)
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from inkwell.llm.exact_dedup import deduplicate

    return deduplicate(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from inkwell.llm.jaccard_join import near_duplicates

    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__keep"))
    named = docs.join(kept, F.col("doc_id") == F.col("__keep"), "left_semi")
    return named.unionByName(docs.where("doc_id IS NULL"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from inkwell.llm.substring_dedup import keep_words

    kept = keep_words(docs, carry=("lang", "source"))
    return kept.select("doc_id", "text", "extra.lang", "extra.source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from inkwell.llm.packing import best_fit_packing

    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("substrings", substrings), ("packing", packing)]

#: The learnt scores of the first stage and the packing of the last cannot be said in SQL; the tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = written(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
