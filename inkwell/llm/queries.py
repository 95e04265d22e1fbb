"""The registered queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import documents, table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.packing import best_fit_packing

    return best_fit_packing(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.quality import quality_scores

    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.bpe import encoding_digests

    return encoding_digests(documents(spark, sf_dir))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.substring_dedup import substring_dedup

    return substring_dedup(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.jaccard_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.media import read_back, store

    return read_back(store(documents(spark, sf_dir)))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_quality, op3_bpe, op4_substrings, op5_line_dedup, op6_jaccard, op7_exact_dedup, op8_media, op9_html, op10_toxicity)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op4_substrings": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  places AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM d),
  windows AS (SELECT p.doc_id, i, min(p.doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS first FROM places p JOIN d ON d.doc_id = p.doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows WHERE first < doc_id),
  words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
  kept AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.k) AS text FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k GROUP BY w.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op6_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
  reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.v), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.u = d.doc_id GROUP BY d.doc_id, n.n""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY len DESC, doc_id)""",
}
