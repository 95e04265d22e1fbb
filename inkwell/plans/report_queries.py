"""Registry of the report-text queries, with the SQL that each must agree with.

``documents`` plays the reports: doc_id is the row number, source the number that is no key. Rules for
Chinese run on the written cases of ``CASES``; everything else runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.profiles import DECISIONS, LATIN, ZH, tone_words
from inkwell.operators import audit, coherence, expand, frozen, rating, readability, sentiment, tone
from inkwell.plans import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
P = LATIN

CASES = [
    (-1, "维持公司“买入”评级。", None),
    (-2, "给予“谨慎增持”评级。", None),
    (-3, "维持增持评 级。", None),
    (-4, "维持增持评", None),
    (-5, "暂不给予评级。", None),
    (-6, "大股东增持公司股份。", None),
    (-7, None, None),
    (-8, "", None),
    (-9, "业绩良好<?>风险提示：需求下滑风险", None),
    (-10, "业绩­增长", None),
    (-11, "业绩并未改善", None),
    (-12, "强烈推荐评级，强烈看好", None),
    (-13, "收入增长；利润下降。", None),
    (-14, "增长科技业绩增长，看好增长科技。", "增长科技"),
    (-15, "首次给予推荐评级。上调至买入。", None),
    (-16, "给予公司中性的投资评级，风险：下滑。", None),
]
CASES_SQL = sql.values(CASES, "doc_id, text, company")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "doc_id long, text string, company string")


def cleaned_cases(spark: SparkSession) -> DataFrame:
    return cases(spark).withColumn("text", tx.clean(tx.text()))


# ---- sources, identity, cleaning -------------------------------------------------------------


@query("SELECT doc_id AS row_no, source AS seq_no, n_chars AS wordcount, text FROM documents")
def scan_documents(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("row_no"), F.col("source").alias("seq_no"), F.col("n_chars").alias("wordcount"), "text")


LEXICON = [(w, "positive") for w in P.positive] + [(w, "negative") for w in P.negative] + tone_words(P)


@query(f"SELECT dim, count(*) AS n, sum(length(word))::BIGINT AS chars FROM {sql.values(LEXICON, 'word, dim')} GROUP BY dim")
def lexicon_profile(spark, sf_dir):
    return spark.createDataFrame(LEXICON, "word string, dim string").groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.length("word")).cast("long").alias("chars"))


CHARS = [(c, i + 1) for i, s in enumerate(P.common) for c in s]


@query(f"SELECT level, count(*) AS n, sha256(string_agg(ch, '' ORDER BY ch)) AS checksum FROM {sql.values(CHARS, 'ch, level')} GROUP BY level")
def charlist_profile(spark, sf_dir):
    return spark.createDataFrame(CHARS, "ch string, level int").groupBy("level").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("ch")), ""), 256).alias("checksum"))


@query(f"SELECT doc_id AS row_no, {sql.TEXT} AS text FROM documents")
def project_text(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("row_no"), tx.text().alias("text"))


@query(f"""
WITH p AS (SELECT doc_id, string_split_regex({sql.TEXT}, {sql.lit(P.paragraph)}) AS x FROM documents
           UNION ALL SELECT doc_id, string_split_regex({sql.TEXT}, {sql.lit(ZH.paragraph)}) FROM {CASES_SQL})
SELECT doc_id AS row_no, unnest(range(len(x))) AS para_no, unnest(x) AS paragraph FROM p""")
def paragraphs(spark, sf_dir):
    split = lambda d, p: d.select(F.col("doc_id").alias("row_no"), F.posexplode(F.split(tx.text(), p.paragraph)).alias("para_no", "paragraph"))
    return split(docs(spark, sf_dir), P).unionByName(split(cases(spark), ZH)).withColumn("para_no", F.col("para_no").cast("long"))


@query(f"SELECT doc_id AS row_no, {sql.clean(sql.TEXT)} AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {CASES_SQL})")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "text").unionByName(cases(spark).select("doc_id", "text")).select(F.col("doc_id").alias("row_no"), tx.clean(tx.text()).alias("text"))


@query(f"SELECT doc_id AS row_no, coalesce(n_chars, length({sql.TEXT})) AS wordcount FROM documents")
def text_length(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("row_no"), F.coalesce("n_chars", F.length(tx.text()).cast("long")).alias("wordcount"))


SCORABLE = f"""SELECT doc_id AS row_no, CASE WHEN {sql.TEXT} = '' THEN 'no_text' WHEN {sql.letters(sql.TEXT, P)} = 0 THEN 'no_letters'
  WHEN len({sql.sentences(sql.TEXT, P)}) < 2 THEN 'too_few_sentences' END AS missing_reason FROM documents"""


@query(f"SELECT row_no, missing_reason IS NULL AS scorable, missing_reason FROM ({SCORABLE})")
def scorability(spark, sf_dir):
    return readability.scorability(docs(spark, sf_dir), P)


@query(f"SELECT missing_reason, count(*) AS n FROM ({SCORABLE}) GROUP BY missing_reason")
def scorability_accounting(spark, sf_dir):
    return readability.scorability(docs(spark, sf_dir), P).groupBy("missing_reason").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT source) AS n_source, count(DISTINCT doc_id) AS n_row_no FROM documents")
def id_uniqueness(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_source"), F.count_distinct("doc_id").alias("n_row_no"))


@query(f"SELECT doc_id AS row_no, {sql.letters(sql.TEXT, P)} AS letters FROM documents UNION ALL SELECT doc_id, {sql.letters(sql.TEXT, ZH)} FROM {CASES_SQL}")
def letter_count(spark, sf_dir):
    count = lambda d, p: d.select(F.col("doc_id").alias("row_no"), tx.letters(tx.text(), p).alias("letters"))
    return count(docs(spark, sf_dir), P).unionByName(count(cases(spark), ZH))


# ---- ratings ---------------------------------------------------------------------------------


def _rated_sql(source: str, profile: str) -> str:
    r = rating.RULES[profile]
    raw = ", ".join(f"nullif(regexp_extract(bare, {sql.lit(p)}, 1), '')" for p in r["anchored"] + r["fallback"])
    standard = "CASE raw " + " ".join(f"WHEN {sql.lit(k)} THEN {sql.lit(v)}" for k, v in rating.SYNONYMS.items()) + " ELSE raw END"
    return f"""
SELECT row_no, raw, {standard} AS std, CASE WHEN raw IS NOT NULL THEN nullif(regexp_extract(evidence, {sql.lit(r["action"])}, 1), '') END AS action, evidence,
  CASE WHEN t = '' THEN 'no_text' WHEN declined THEN 'declared_none' WHEN raw IS NULL THEN 'missed' ELSE 'extracted' END AS status
FROM (SELECT *, CASE WHEN raw IS NOT NULL OR declined THEN list_filter({sql.pieces("t", r["sentence"])}, lambda x: contains(x, coalesce(raw, {sql.lit(r["anchor_word"])})))[1] END AS evidence
  FROM (SELECT *, CASE WHEN NOT declined THEN coalesce({raw}) END AS raw
    FROM (SELECT *, regexp_matches(bare, {sql.lit(r["declined"])}) AS declined
      FROM (SELECT row_no, t, regexp_replace(t, {sql.lit(r["noise"])}, '', 'g') AS bare
        FROM (SELECT doc_id AS row_no, {sql.clean(sql.TEXT)} AS t FROM {source})))))"""


RATED = f"({_rated_sql(CASES_SQL, 'zh')} UNION ALL {_rated_sql('documents', 'latin')})"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.ratings(cases(spark), "zh", "doc_id").unionByName(rating.ratings(docs(spark, sf_dir), "latin", "doc_id"))


@query(f"SELECT * FROM {RATED}")
def rating_extract(spark, sf_dir):
    return rated(spark, sf_dir)


def _rating_columns(name: str, *columns: str) -> None:
    def f(spark, sf_dir):
        return rated(spark, sf_dir).select("row_no", *columns)

    f.__name__ = name
    query(f"SELECT row_no, {', '.join(columns)} FROM {RATED}")(f)


_rating_columns("rating_standardize", "raw", "std")
_rating_columns("rating_action", "action")
_rating_columns("rating_evidence", "evidence")
_rating_columns("rating_status", "status")


@query(f"SELECT std, count(*) AS n, round(100::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM {RATED} WHERE status = 'extracted' GROUP BY std")
def rating_distribution(spark, sf_dir):
    return rating.distribution(rated(spark, sf_dir))


@query(f"SELECT count(*) AS n, {', '.join(f'count(*) FILTER (status = {sql.lit(s)}) AS {s}' for s in ('extracted', 'declared_none', 'missed', 'no_text'))}, round(100::DOUBLE * count(*) FILTER (status = 'extracted') / count(*), 4) AS pct FROM {RATED}")
def rating_coverage(spark, sf_dir):
    return rating.coverage(rated(spark, sf_dir))


# ---- sentiment -------------------------------------------------------------------------------


@query(f"SELECT doc_id AS row_no, len(x) AS n_tokens, len(list_distinct(x)) AS n_distinct, md5(array_to_string(x, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.tokens(sql.TEXT, P)} AS x FROM documents)")
def tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.tokens(tx.text(), P).alias("x")).select(F.col("doc_id").alias("row_no"), F.size("x").cast("long").alias("n_tokens"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"), F.md5(F.array_join("x", " ")).alias("tokens_md5"))


_SIGN = "CASE WHEN x.flipped THEN -x.sign ELSE x.sign END"
HITS = f"""SELECT row_no, letters, {sql.hits("s", P, sentiment.REACH)} AS h, {sql.hits("b", P, sentiment.REACH)} AS b
  FROM (SELECT doc_id AS row_no, {sql.letters(sql.TEXT, P)} AS letters, {sql.sentence_tokens(sql.TEXT, P)} AS s, {sql.sentence_tokens(sql.body(sql.TEXT, P), P)} AS b FROM documents)"""
COUNTS = f"""SELECT row_no, letters, len(list_filter(h, lambda x: x.sign = 1)) AS pos_raw, len(list_filter(h, lambda x: x.sign = -1)) AS neg_raw,
  len(list_filter(h, lambda x: {_SIGN} = 1)) AS pos_negated, len(list_filter(h, lambda x: {_SIGN} = -1)) AS neg_negated,
  len(list_filter(b, lambda x: {_SIGN} = 1)) AS pos_body, len(list_filter(b, lambda x: {_SIGN} = -1)) AS neg_body FROM ({HITS})"""


def _scores_sql(c: str) -> str:
    pos, neg = f"pos_{c}", f"neg_{c}"
    return f"""SELECT row_no, letters, {pos} - {neg} AS net, {sql.ratio(pos, f"{pos} + {neg}")} AS ratio, {sql.per_thousand(f"({pos} + {neg})", "letters")} AS density,
  CASE WHEN letters = 0 THEN NULL WHEN {pos} > {neg} THEN 'positive' WHEN {pos} < {neg} THEN 'negative' ELSE 'neutral' END AS polarity FROM ({COUNTS})"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.counts(docs(spark, sf_dir), P)


@query(f"SELECT row_no, pos_raw, neg_raw FROM ({COUNTS})")
def sentiment_counts(spark, sf_dir):
    return counted(spark, sf_dir).select("row_no", "pos_raw", "neg_raw")


_HITS_ZH = lambda t: f"len({sql.hits(sql.sentence_tokens(t, ZH), ZH, sentiment.REACH)})"


@query(f"""SELECT doc_id AS row_no, {_HITS_ZH(sql.TEXT)} AS hits, {_HITS_ZH(f"CASE WHEN company IS NULL OR company = '' THEN {sql.TEXT} ELSE replace({sql.TEXT}, company, '') END")} AS hits_without_company FROM {CASES_SQL}""")
def sentiment_company_excl(spark, sf_dir):
    n = lambda company, name: sentiment.counts(cases(spark), ZH, company_col=company).select("row_no", F.size("h").cast("long").alias(name))
    return n(None, "hits").join(n("company", "hits_without_company"), "row_no")


@query(f"SELECT row_no, len(h) AS hits, len(list_filter(h, lambda x: x.flipped)) AS flipped FROM ({HITS})")
def sentiment_negation(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("row_no"), sentiment.hits(tx.text(), P).alias("h")).select("row_no", F.size("h").cast("long").alias("hits"), F.size(F.filter("h", lambda x: x["flipped"])).cast("long").alias("flipped"))


@query(f"SELECT doc_id AS row_no, {sql.body(sql.TEXT, P)} AS body FROM documents")
def sentiment_body(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("row_no"), sentiment.body(tx.text(), P).alias("body"))


@query(COUNTS)
def sentiment_calibers(spark, sf_dir):
    return counted(spark, sf_dir).drop("h", "b")


_MINUS = "CASE WHEN x.flipped THEN '-' ELSE '' END || "


def _wide_sentiment_sql(hits: str) -> str:
    """SQL for the 28 columns, from row_no, letters and the hits h and b."""
    n = lambda h, sign, negated: f"len(list_filter({h}, lambda x: {_SIGN if negated else 'x.sign'} = {sign}))"
    own = {c: ("b" if c == "body" else "h", c != "raw") for c in sentiment.CALIBERS}
    counts = ", ".join(f"{n(h, 1, m)} AS pos_{c}, {n(h, -1, m)} AS neg_{c}" for c, (h, m) in own.items())
    columns = ", ".join(
        f"pos_{c}, neg_{c}, pos_{c} + neg_{c} AS hits_{c}, pos_{c} - neg_{c} AS net_{c}, {sql.ratio(f'pos_{c}', f'pos_{c} + neg_{c}')} AS ratio_{c}, {sql.per_thousand(f'(pos_{c} + neg_{c})', 'letters')} AS density_{c}, "
        f"CASE WHEN letters = 0 THEN NULL WHEN pos_{c} > neg_{c} THEN 'positive' WHEN pos_{c} < neg_{c} THEN 'negative' ELSE 'neutral' END AS polarity_{c}, "
        f"array_to_string(list_transform({h}, lambda x: {_MINUS if m else ''}x.word), ' ') AS words_{c}"
        for c, (h, m) in own.items()
    )
    return f"SELECT row_no, letters, len(list_filter(h, lambda x: x.flipped)) AS flipped, len(h) - len(b) AS routine, {columns} FROM (SELECT *, {counts} FROM ({hits}))"


@query(_wide_sentiment_sql(HITS))
def sentiment_wide(spark, sf_dir):
    return sentiment.wide(counted(spark, sf_dir))


_NAMELESS = f"CASE WHEN company IS NULL OR company = '' THEN {sql.TEXT} ELSE replace({sql.TEXT}, company, '') END"
HITS_ZH = f"""SELECT row_no, letters, {sql.hits("s", ZH, sentiment.REACH)} AS h, {sql.hits("b", ZH, sentiment.REACH)} AS b
  FROM (SELECT doc_id AS row_no, {sql.letters(sql.TEXT, ZH)} AS letters, {sql.sentence_tokens(_NAMELESS, ZH)} AS s, {sql.sentence_tokens(sql.body(_NAMELESS, ZH), ZH)} AS b FROM (SELECT doc_id, company, {sql.clean(sql.TEXT)} AS text FROM {CASES_SQL}))"""


@query(_wide_sentiment_sql(HITS_ZH))
def sentiment_zh(spark, sf_dir):
    """The written Chinese cases, cleaned, without the companies' names."""
    return sentiment.wide(sentiment.counts(cleaned_cases(spark), ZH, company_col="company"))


@query(_scores_sql("raw"))
def sentiment_scores(spark, sf_dir):
    return sentiment.scores(counted(spark, sf_dir))


@query(f"SELECT polarity, count(*) AS n FROM ({_scores_sql('raw')}) GROUP BY polarity")
def sentiment_polarity(spark, sf_dir):
    return sentiment_scores(spark, sf_dir).groupBy("polarity").agg(F.count("*").alias("n"))


@query(f"SELECT row_no, array_to_string(list_transform(h, lambda x: x.word), ' ') AS words FROM ({HITS})")
def sentiment_hits(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("row_no"), F.array_join(F.transform(sentiment.hits(tx.text(), P), lambda h: h["word"]), " ").alias("words"))


@query(f"""SELECT row_no, array_to_string(list_transform(h, lambda x: x.word), ' ') AS words, len(list_filter(h, lambda x: x.flipped)) AS flipped
FROM (SELECT doc_id AS row_no, {sql.hits(sql.sentence_tokens(sql.clean(sql.TEXT), ZH), ZH, sentiment.REACH)} AS h FROM {CASES_SQL})""")
def sentiment_hits_zh(spark, sf_dir):
    rows = cases(spark).select(F.col("doc_id").alias("row_no"), sentiment.hits(tx.clean(tx.text()), ZH).alias("h"))
    return rows.select("row_no", F.array_join(F.transform("h", lambda h: h["word"]), " ").alias("words"), F.size(F.filter("h", lambda h: h["flipped"])).cast("long").alias("flipped"))


_SHARE = len(P.positive) / (len(P.positive) + len(P.negative))


@query(f"SELECT {round(_SHARE, 6)}::DOUBLE AS baseline, round(m, 6) AS observed, round(m / {_SHARE!r}::DOUBLE, 6) AS times FROM (SELECT quantile_cont(ratio, 0.5) AS m FROM ({_scores_sql('raw')}))")
def sentiment_baseline(spark, sf_dir):
    return sentiment.baseline(docs(spark, sf_dir), P)


@query(f"SELECT round(avg(net), 6) AS mean_net, quantile_cont(net, 0.5)::DOUBLE AS median_net, round(quantile_cont(ratio, 0.5), 6) AS median_ratio FROM ({_scores_sql('raw')})")
def sentiment_summary(spark, sf_dir):
    return sentiment.summary(sentiment_scores(spark, sf_dir))


@query(f"SELECT round(corr(net, letters), 6) AS r FROM ({_scores_sql('raw')})")
def sentiment_length_corr(spark, sf_dir):
    return sentiment_scores(spark, sf_dir).agg(F.round(F.corr("net", "letters"), 6).alias("r"))


@query(f"""SELECT sum(a)::BIGINT AS n, round(sum(a - o)::DOUBLE / nullif(sum(a), 0), 6) AS in_routine, round(count(*) FILTER (a > 0)::DOUBLE / count(*), 6) AS of_rows
FROM (SELECT {sql.occurrences(sql.tokens(sql.TEXT, P), ["the"])} AS a, {sql.occurrences(sql.tokens(sql.body(sql.TEXT, P), P), ["the"])} AS o FROM documents)""")
def term_location_share(spark, sf_dir):
    return sentiment.location_share(docs(spark, sf_dir), P, "the")


@query(" UNION ALL ".join(f"SELECT '{c}' AS caliber, polarity, count(*) AS n FROM ({_scores_sql(c)}) GROUP BY polarity" for c in ("raw", "negated", "body")))
def sentiment_caliber_shift(spark, sf_dir):
    rows = counted(spark, sf_dir)
    wide = rows.select(*[F.when(F.col("letters") == 0, None).when(F.col(f"pos_{c}") > F.col(f"neg_{c}"), "positive").when(F.col(f"pos_{c}") < F.col(f"neg_{c}"), "negative").otherwise("neutral").alias(c) for c in ("raw", "negated", "body")])
    return wide.unpivot([], ["raw", "negated", "body"], "caliber", "polarity").groupBy("caliber", "polarity").agg(F.count("*").alias("n"))


# ---- readability -----------------------------------------------------------------------------


@query(f"SELECT doc_id AS row_no, unnest(range(len(x))) AS sent_no, unnest(x) AS sentence FROM (SELECT doc_id, {sql.sentences(sql.TEXT, P)} AS x FROM documents UNION ALL SELECT doc_id, {sql.sentences(sql.TEXT, ZH)} FROM {CASES_SQL})")
def sentences(spark, sf_dir):
    split = lambda d, p: d.select(F.col("doc_id").alias("row_no"), F.posexplode(tx.sentences(tx.text(), p)).alias("sent_no", "sentence"))
    return split(docs(spark, sf_dir), P).unionByName(split(cases(spark), ZH)).withColumn("sent_no", F.col("sent_no").cast("long"))


def _stats_sql(pattern: str) -> str:
    return f"""SELECT doc_id AS row_no, len(x) AS n, round(list_avg(x), 6) AS mean_length, list_median(x)::DOUBLE AS p50, list_max(x)::DOUBLE AS longest
FROM (SELECT doc_id, list_transform({sql.pieces(sql.TEXT, pattern)}, lambda s: length(s)) AS x FROM documents)"""


@query(_stats_sql(P.segment))
def punct_segments(spark, sf_dir):
    return readability.sentence_stats(docs(spark, sf_dir), P, P.segment)


@query(_stats_sql(P.sentence))
def sentence_length(spark, sf_dir):
    return readability.sentence_stats(docs(spark, sf_dir), P)


@query(_stats_sql(P.sentence_semicolon))
def sentences_semicolon(spark, sf_dir):
    return readability.sentence_stats(docs(spark, sf_dir), P, P.sentence_semicolon)


def _in(chars: str) -> str:
    return f"length(regexp_replace(lower({sql.TEXT}), '[^{chars}]', '', 'g'))"


_LOW = sql.letters(f"lower({sql.TEXT})", P)


@query(f"SELECT row_no, {sql.ratio('a', 'n')} AS level1, {sql.ratio('b', 'n')} AS level2, {sql.ratio('n - a - b', 'n')} AS rare FROM (SELECT doc_id AS row_no, {_LOW} AS n, {_in(P.common[0])} AS a, {_in(P.common[1])} AS b FROM documents)")
def char_coverage(spark, sf_dir):
    return readability.coverage(docs(spark, sf_dir), P)


FEATURES = f"""SELECT doc_id AS row_no, round(list_avg(list_transform({sql.sentences(sql.TEXT, P)}, lambda s: length(s))), 6) AS sentence_length,
  {sql.ratio(f"{_LOW} - {_in(P.common[0] + P.common[1])}", _LOW)} AS uncommon, round(list_avg(list_transform({sql.tokens(sql.TEXT, P)}, lambda w: length(w))), 6) AS word_length FROM documents"""


#: References fitted on the scorable rows of the 10,000-document table and kept; the queries *_fit fit anew, the others only apply these.
KEPT_MOMENTS = {"sentence_length": (73.32954, 114.86734), "uncommon": (0.06044, 0.04991), "word_length": (4.99256, 0.49483)}
KEPT_QUANTILES = {
    "sentence_length": (44.683334, 54.938462, 61.0, 65.358974, 69.532408, 73.171429, 77.454545, 83.456522, 94.73254),
    "uncommon": (0.02284, 0.025882, 0.027674, 0.029561, 0.03223, 0.042553, 0.059347, 0.127206, 0.148909),
    "cohesion": (0.003811, 0.012418, 0.016022, 0.018848, 0.021091, 0.023268, 0.025761, 0.029391, 0.036035),
    "connectives": (0.0, 0.076923, 0.181818, 0.238095, 0.282609, 0.32381, 0.363636, 0.416667, 0.5),
    "refs": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.03252, 0.058824),
}


def kept_quantiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KEPT_QUANTILES.items()), frozen.SCHEMAS["quantiles"])


def kept_moments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *x) for m, x in KEPT_MOMENTS.items()], frozen.SCHEMAS["moments"])


def eligible(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that may enter a reference: those that can be scored."""
    return df.join(readability.scorability(docs(spark, sf_dir), P).where("scorable").select("row_no"), "row_no", "left_semi")


READABLE = ["sentence_length", "uncommon", "word_length"]
_Z = {m: f"(({m} - {KEPT_MOMENTS[m][0]!r}::DOUBLE) / nullif({KEPT_MOMENTS[m][1]!r}::DOUBLE, 0))" for m in READABLE}
_ELIGIBLE = f"row_no IN (SELECT row_no FROM ({SCORABLE}) WHERE missing_reason IS NULL)"


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 5) AS mean, round(stddev_pop({m}), 5) AS std FROM ({FEATURES}) WHERE {_ELIGIBLE}" for m in READABLE))
def readability_fit(spark, sf_dir):
    fitted = frozen.fit_moments(eligible(readability.features(docs(spark, sf_dir), P), spark, sf_dir), READABLE)
    return fitted.select("metric", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"""SELECT row_no, round(({_Z['sentence_length']} + {_Z['word_length']}) / 2, 5) AS length_index, round(({_Z['sentence_length']} + {_Z['uncommon']}) / 2, 5) AS character_index FROM ({FEATURES})""")
def readability_index(spark, sf_dir):
    z = frozen.z_scores(kept_moments(spark), READABLE)
    return readability.features(docs(spark, sf_dir), P).select("row_no", F.round((z["sentence_length"] + z["word_length"]) / 2, 5).alias("length_index"), F.round((z["sentence_length"] + z["uncommon"]) / 2, 5).alias("character_index"))


def _ranks_sql(source: str, metrics: list[str], keep: str = "row_no") -> str:
    ranks = ", ".join(f"CASE WHEN {m} IS NOT NULL THEN round(len(list_filter({list(KEPT_QUANTILES[m])!r}::DOUBLE[], lambda e: e <= {m})) / {len(frozen.STEPS)}::DOUBLE, 6) END AS {m}_rank" for m in metrics)
    return f"SELECT {keep}, {', '.join(metrics)}, {ranks} FROM ({source})"


def _edges_sql(source: str, metrics: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{m}' AS metric, unnest(range(1, {len(frozen.STEPS) + 1})) AS step, unnest(quantile_cont({m}, {list(frozen.STEPS)!r})) AS edge FROM ({source}) WHERE {_ELIGIBLE}" for m in metrics)
    return f"SELECT metric, step, round(edge, 6) AS edge FROM ({cells})"


def fitted_edges(df: DataFrame, metrics: list[str]) -> DataFrame:
    edges = frozen.fit_quantiles(df, metrics)
    return edges.select("metric", F.posexplode("edges").alias("step", "edge")).select("metric", (F.col("step") + 1).cast("long").alias("step"), F.round("edge", 6).alias("edge"))


@query(_edges_sql(FEATURES, ["sentence_length", "uncommon"]))
def readability_reference_fit(spark, sf_dir):
    return fitted_edges(eligible(readability.features(docs(spark, sf_dir), P), spark, sf_dir), ["sentence_length", "uncommon"])


@query(_ranks_sql(FEATURES, ["sentence_length", "uncommon"]))
def readability_reference(spark, sf_dir):
    metrics = ["sentence_length", "uncommon"]
    ranked = frozen.apply_quantiles(readability.features(docs(spark, sf_dir), P), kept_quantiles(spark), metrics)
    return ranked.select("row_no", *metrics, *[f"{m}_rank" for m in metrics])


@query(f"SELECT row_no, {sql.per_thousand(sql.occurrences('w', P.adversatives), 'n')} AS adversatives, {sql.per_thousand(sql.occurrences('w', P.terms), 'n')} AS terms FROM (SELECT doc_id AS row_no, {sql.letters(sql.TEXT, P)} AS n, {sql.tokens(sql.TEXT, P)} AS w FROM documents)")
def lexicon_density(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("row_no"), tx.letters(tx.text(), P).alias("n"), tx.tokens(tx.text(), P).alias("w"))
    return rows.select("row_no", tx.per_thousand(tx.occurrences(F.col("w"), P.adversatives), F.col("n")).alias("adversatives"), tx.per_thousand(tx.occurrences(F.col("w"), P.terms), F.col("n")).alias("terms"))


# ---- tone ------------------------------------------------------------------------------------

MASKED = sql.mask(sql.TEXT, P)


def _tone_sql(version: int) -> str:
    return f"SELECT row_no, letters, {', '.join(f'{sql.occurrences("w", ws)} AS {d}' for d, ws in tone.by_dim(P, version).items())} FROM (SELECT doc_id AS row_no, {sql.letters(sql.TEXT, P)} AS letters, {sql.tokens(MASKED, P)} AS w FROM documents)"


def _cautious(ws: list[str]) -> str:
    return f"len(list_filter(w, lambda x, i: x IN {sql.among(ws)} AND NOT coalesce(w[i - 1] IN {sql.among(P.context)}, false)))"


@query(_tone_sql(1))
def tone_scores(spark, sf_dir):
    return tone.scores(docs(spark, sf_dir), P)


@query(f"SELECT dim, sum(n)::BIGINT AS hits, count(*) FILTER (n > 0) AS rows_with_hits FROM (UNPIVOT (SELECT row_no, {', '.join(tone.DIMS)} FROM ({_tone_sql(1)})) ON {', '.join(tone.DIMS)} INTO NAME dim VALUE n) GROUP BY dim")
def tone_hits(spark, sf_dir):
    return tone_scores(spark, sf_dir).unpivot("row_no", list(tone.DIMS), "dim", "n").groupBy("dim").agg(F.sum("n").alias("hits"), F.count_if(F.col("n") > 0).alias("rows_with_hits"))


@query(f"SELECT row_no, letters, {', '.join(f'{sql.occurrences("w", ws)} AS {d}' for d, ws in tone.by_dim(ZH, 1).items())} FROM (SELECT doc_id AS row_no, {sql.letters(sql.TEXT, ZH)} AS letters, {sql.tokens(sql.mask(sql.TEXT, ZH), ZH)} AS w FROM {CASES_SQL})")
def tone_scores_zh(spark, sf_dir):
    return tone.scores(cases(spark), ZH)


@query(f"SELECT row_no, {', '.join(f'{_cautious(ws)} AS {d}_cautious' for d, ws in tone.by_dim(P, 1).items())} FROM (SELECT doc_id AS row_no, {sql.tokens(MASKED, P)} AS w FROM documents)")
def tone_context(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("row_no"), tx.tokens(tone.mask(tx.text(), P), P).alias("w"))
    return rows.select("row_no", *[tone.cautious(F.col("w"), ws, P).alias(f"{d}_cautious") for d, ws in tone.by_dim(P, 1).items()])


@query(f"SELECT row_no, {', '.join(f'{sql.per_thousand(d, "letters")} AS {d}' for d in tone.DIMS)} FROM ({_tone_sql(1)})")
def tone_density(spark, sf_dir):
    return tone_scores(spark, sf_dir).select("row_no", *[tx.per_thousand(F.col(d), F.col("letters")).alias(d) for d in tone.DIMS])


def _sentence_share(ws: list[str]) -> str:
    return sql.ratio(f"len(list_filter(s, lambda x: len(list_filter(x, lambda w: w IN {sql.among(ws)})) > 0))", "len(s)")


@query(f"SELECT row_no, {', '.join(f'{_sentence_share(ws)} AS {d}' for d, ws in tone.by_dim(P, 1).items())} FROM (SELECT doc_id AS row_no, {sql.sentence_tokens(MASKED, P)} AS s FROM documents)")
def tone_sentence_share(spark, sf_dir):
    rows = tone.wide(docs(spark, sf_dir), P, 1)
    return rows.select("row_no", *[F.col(f"{d}_sentences").alias(d) for d in tone.DIMS])


PAIRS = f"""
WITH w AS (SELECT doc_id, {sql.tokens(sql.TEXT, P)} AS t FROM documents), o AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS w FROM w),
  one AS (SELECT least(a.w, b.w) AS a, greatest(a.w, b.w) AS b, count(*) AS n FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.i IN (a.i + 1, a.i + 2) GROUP BY ALL),
  kept AS (SELECT a, b, CASE WHEN a = b THEN 2 * n ELSE n END AS n FROM one WHERE CASE WHEN a = b THEN 2 * n ELSE n END >= 5),
  pairs AS (SELECT a AS w, b AS ctx, n FROM kept UNION ALL SELECT b, a, n FROM kept WHERE a <> b),
  m AS (SELECT w, sum(n) AS n_w FROM pairs GROUP BY w),
  vectors AS (SELECT p.w, p.ctx, round(greatest(log2(p.n::DOUBLE * (SELECT sum(n) FROM pairs)::DOUBLE / (x.n_w::DOUBLE * y.n_w::DOUBLE)), 0), 6) AS ppmi FROM pairs p JOIN m x ON x.w = p.w JOIN m y ON y.w = p.ctx)"""


@query(PAIRS + " SELECT * FROM vectors")
def ppmi(spark, sf_dir):
    return expand.ppmi(expand.pair_counts(docs(spark, sf_dir), P))


SEEDS = list(P.tone["strength"] + P.tone["vagueness"])
KNOWN = [w for w, _ in tone_words(P)]


@query(PAIRS + f""", norms AS (SELECT w, sqrt(sum(ppmi * ppmi)) AS norm FROM vectors GROUP BY w),
  dots AS (SELECT s.w AS seed, v.w, sum(s.ppmi * v.ppmi) AS dot FROM vectors s JOIN vectors v ON s.ctx = v.ctx WHERE s.w IN {sql.among(SEEDS)} AND v.w NOT IN {sql.among(KNOWN)} GROUP BY ALL),
  scored AS (SELECT seed, d.w, round(dot / nullif(a.norm * b.norm, 0), 5) AS cosine FROM dots d JOIN norms a ON a.w = d.w JOIN norms b ON b.w = d.seed)
SELECT seed, w, cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cosine DESC, w) AS place FROM scored WHERE cosine > 0) WHERE place <= 10""")
def ppmi_candidates(spark, sf_dir):
    return expand.candidates(ppmi(spark, sf_dir), SEEDS, KNOWN)


def _evidence_sql(source: str, p) -> str:
    return f"""
WITH p AS (SELECT doc_id, {sql.TEXT} AS t, regexp_extract_all({sql.mask(sql.TEXT, p)}, {sql.lit(rf"[^\p{{L}}]*(?:{p.token})")}) AS x FROM {source}),
  k AS (SELECT doc_id, t, unnest(range(len(x))) AS k, unnest(x) AS part FROM p),
  e AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) AS "end", regexp_extract(lower(part), {sql.lit(f"({p.token})$")}, 1) AS word FROM k)
SELECT doc_id AS row_no, e.word, dim, ("end" - length(e.word))::BIGINT AS start, "end"::BIGINT AS "end", substring(t, greatest("end" - length(e.word) - 9, 1)::BIGINT, length(e.word) + 20) AS snippet
FROM e JOIN {sql.values(tone_words(p), 'word, dim')} ON v.word = e.word"""


@query(_evidence_sql("documents", P))
def tone_evidence(spark, sf_dir):
    return tone.hit_places(docs(spark, sf_dir), P)


@query(_evidence_sql(CASES_SQL, ZH))
def tone_evidence_zh(spark, sf_dir):
    return tone.hit_places(cases(spark), ZH)


def _sample_sql(source: str, stratum: str) -> str:
    return f"SELECT row_no, {stratum}, place FROM (SELECT doc_id AS row_no, {stratum}, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat_ws('-', '1', doc_id::VARCHAR)), doc_id) AS place FROM {source}) WHERE place <= 5"


@query(_sample_sql(f"(SELECT row_no AS doc_id, polarity_negated FROM ({_wide_sentiment_sql(HITS_ZH)}))", "polarity_negated"))
def stratified_sample_zh(spark, sf_dir):
    """Written Chinese cases to read, by polarity."""
    return audit.stratified_sample(sentiment_zh(spark, sf_dir), "polarity_negated", "row_no", 5).select("row_no", "polarity_negated", "place")


@query("SELECT row_no, source, place FROM (SELECT doc_id AS row_no, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('-', '1', doc_id::VARCHAR)), doc_id) AS place FROM documents) WHERE place <= 5")
def stratified_sample(spark, sf_dir):
    return audit.stratified_sample(docs(spark, sf_dir), "source", "doc_id", 5).select(F.col("doc_id").alias("row_no"), "source", "place")


@query(f"""SELECT v.word, CASE WHEN action = 'redim' THEN new_dim ELSE dim END AS dim, coalesce(action, 'keep') AS action
FROM {sql.values(tone_words(P), 'word, dim')} LEFT JOIN (SELECT * FROM {sql.values(DECISIONS, 'word, action, new_dim')}) d ON d.word = v.word WHERE coalesce(action, 'keep') <> 'remove'""")
def lexicon_calibrate(spark, sf_dir):
    return tone.calibrate(tone.lexicon(spark, P), tone.decisions(spark))


@query(f"SELECT doc_id AS row_no, {MASKED} AS masked FROM documents UNION ALL SELECT doc_id, {sql.mask(sql.TEXT, ZH)} FROM {CASES_SQL}")
def tone_mask(spark, sf_dir):
    masked = lambda d, p: d.select(F.col("doc_id").alias("row_no"), tone.mask(tx.text(), p).alias("masked"))
    return masked(docs(spark, sf_dir), P).unionByName(masked(cases(spark), ZH))


def _wide_sql(version: int) -> str:
    lists = tone.by_dim(P, version)
    listed = [w for ws in lists.values() for w in ws]
    inner = ", ".join(f"{sql.occurrences('w', ws)} AS {d}, {_sentence_share(ws)} AS {d}_sentences, {_cautious(ws)} AS {d}_cautious" for d, ws in lists.items())
    outer = ", ".join(f"{d}, {sql.per_thousand(d, 'letters')} AS {d}_density, {d}_sentences, {sql.ratio(d, 'all_hits')} AS {d}_share, {d}_cautious, {sql.per_thousand(f'{d}_cautious', 'letters')} AS {d}_cautious_density" for d in lists)
    return f"""SELECT row_no, letters, n_sentences, {outer}, {sql.ratio('certainty', 'certainty + vagueness')} AS certain_of_both
FROM (SELECT row_no, letters, len(s) AS n_sentences, {sql.occurrences('w', listed)} AS all_hits, {inner}
  FROM (SELECT doc_id AS row_no, {sql.letters(sql.TEXT, P)} AS letters, {sql.tokens(MASKED, P)} AS w, {sql.sentence_tokens(MASKED, P)} AS s FROM documents))"""


@query(_wide_sql(2))
def tone_v2_scores(spark, sf_dir):
    return tone.wide(docs(spark, sf_dir), P)


@query(f"SELECT {', '.join(f'round(avg(CASE WHEN {d} = 0 THEN 1 ELSE 0 END), 6) AS {d}' for d in tone.DIMS)} FROM ({_tone_sql(2)})")
def tone_zero_share(spark, sf_dir):
    return tone.scores(docs(spark, sf_dir), P, 2).agg(*[F.round(F.avg((F.col(d) == 0).cast("int")), 6).alias(d) for d in tone.DIMS])


def _covered_sql(version: int) -> str:
    return f"SELECT dim, count(*) FILTER (n > 0) AS covered, count(*) AS n FROM (UNPIVOT (SELECT row_no, {', '.join(tone.DIMS)} FROM ({_tone_sql(version)})) ON {', '.join(tone.DIMS)} INTO NAME dim VALUE n) GROUP BY dim"


def covered(df: DataFrame, version: int) -> DataFrame:
    return tone.scores(df, P, version).unpivot("row_no", list(tone.DIMS), "dim", "n").groupBy("dim").agg(F.count_if(F.col("n") > 0).alias("covered"), F.count("*").alias("n"))


@query(f"SELECT dim, covered, row_number() OVER (ORDER BY covered, dim) AS place FROM ({_covered_sql(1)})")
def dim_coverage(spark, sf_dir):
    from pyspark.sql import Window as W

    return covered(docs(spark, sf_dir), 1).select("dim", "covered", F.row_number().over(W.orderBy("covered", "dim")).alias("place"))


@query(f"SELECT a.dim, round(100::DOUBLE * a.covered / a.n, 4) AS before, round(100::DOUBLE * b.covered / b.n, 4) AS after FROM ({_covered_sql(1)}) a JOIN ({_covered_sql(2)}) b ON a.dim = b.dim")
def lexicon_version_shift(spark, sf_dir):
    pct = lambda v, name: covered(docs(spark, sf_dir), v).select("dim", F.round(100.0 * F.col("covered") / F.col("n"), 4).alias(name))
    return pct(1, "before").join(pct(2, "after"), "dim")


@query(" UNION ALL ".join(f"SELECT a.row_no, '{d}' AS \"column\", a.{d}::VARCHAR AS before, b.{d}::VARCHAR AS after FROM ({_tone_sql(1)}) a FULL JOIN ({_tone_sql(2)}) b ON a.row_no = b.row_no WHERE a.{d} IS DISTINCT FROM b.{d}" for d in tone.DIMS))
def version_diff(spark, sf_dir):
    d = docs(spark, sf_dir)
    return audit.version_diff(tone.scores(d, P, 1), tone.scores(d, P, 2), list(tone.DIMS))


# ---- coherence -------------------------------------------------------------------------------


def _vectors_sql(order: str | None = None) -> str:
    sid = "sid" if order is None else f"row_number() OVER (PARTITION BY row_no ORDER BY md5(concat_ws('-', {sql.lit(order)}, row_no::VARCHAR, sid::VARCHAR)), sid) - 1"
    return f"""
s0 AS (SELECT doc_id AS row_no, unnest(range(len(x))) AS sid, unnest(x) AS sentence FROM (SELECT doc_id, {sql.sentences(sql.TEXT, P)} AS x FROM documents)),
s AS (SELECT row_no, {sid} AS sid, lower(sentence) AS sentence FROM s0),
g AS (SELECT row_no, sid, unnest(list_filter(list_transform(range(1, greatest(length(sentence) - 1, 1) + 1), lambda i: substring(sentence, i, 2)), lambda x: length(x) = 2)) AS gram FROM s),
c AS (SELECT row_no, sid, gram, count(*) AS tf FROM g GROUP BY ALL),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT row_no, sid FROM c)),
idf AS (SELECT gram, count(*) AS df, ln((1 + any_value(n)) / (1::DOUBLE + count(*))) + 1 AS idf FROM c, total GROUP BY gram),
v AS (SELECT row_no, sid, c.gram, tf * idf AS w FROM c JOIN idf ON idf.gram = c.gram),
norms AS (SELECT row_no, sid, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
sims AS (SELECT x.row_no, x.sid, round(coalesce(d.dot, 0) / (x.norm * y.norm), 6) AS cosine FROM norms x JOIN norms y ON y.row_no = x.row_no AND y.sid = x.sid + 1
  LEFT JOIN (SELECT a.row_no, a.sid, sum(a.w * b.w) AS dot FROM v a JOIN v b ON b.row_no = a.row_no AND b.sid = a.sid + 1 AND b.gram = a.gram GROUP BY ALL) d ON d.row_no = x.row_no AND d.sid = x.sid)"""


def vectors(spark: SparkSession, sf_dir: str, shuffled: str | None = None) -> DataFrame:
    return coherence.weighted(coherence.grams(coherence.sentence_rows(docs(spark, sf_dir), P, shuffled=shuffled)))


@query(f"WITH {_vectors_sql()} SELECT row_no, sid, count(*) AS n_grams, round(sqrt(sum(w * w)), 6) AS norm FROM v GROUP BY ALL")
def char_tfidf(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("row_no", "sid").agg(F.count("*").alias("n_grams"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm")).withColumn("sid", F.col("sid").cast("long"))


@query(f"WITH {_vectors_sql()} SELECT row_no, sid::BIGINT AS sid, cosine FROM sims")
def adjacent_similarity(spark, sf_dir):
    return coherence.similarities(vectors(spark, sf_dir)).withColumn("sid", F.col("sid").cast("long"))


SURFACE = f"""SELECT row_no, len(s) AS n_sentences,
  round(list_avg(list_filter(list_transform(s[2:], lambda b, i: len(list_intersect(s[i], b))::DOUBLE / nullif(len(list_distinct(list_concat(s[i], b))), 0)), lambda x: x IS NOT NULL)), 6) AS cohesion,
  {sql.ratio(f"list_sum(list_transform(s, lambda x: {sql.occurrences('x', P.connectives)}))", "len(s)")} AS connectives,
  {sql.ratio(f"len(list_filter(s, lambda x: coalesce(x[1] IN {sql.among(P.references)}, false)))", "len(s)")} AS "references"
FROM (SELECT doc_id AS row_no, {sql.sentence_tokens(sql.TEXT, P)} AS s FROM documents)"""


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence.surface(docs(spark, sf_dir), P)


@query(f"SELECT row_no, cohesion FROM ({SURFACE})")
def lexical_cohesion(spark, sf_dir):
    return surface(spark, sf_dir).select("row_no", "cohesion")


@query(f"SELECT row_no, connectives FROM ({SURFACE})")
def connectives(spark, sf_dir):
    return surface(spark, sf_dir).select("row_no", "connectives")


@query(f'SELECT row_no, "references" FROM ({SURFACE})')
def reference_links(spark, sf_dir):
    return surface(spark, sf_dir).select("row_no", "references")


@query(f"""WITH {_vectors_sql()}, cent AS (SELECT row_no, gram, sum(w) AS c FROM v GROUP BY ALL), cn AS (SELECT row_no, sqrt(sum(c * c)) AS norm FROM cent GROUP BY ALL),
  d AS (SELECT v.row_no, v.sid, sum(w * c) AS dot FROM v JOIN cent ON cent.row_no = v.row_no AND cent.gram = v.gram GROUP BY ALL)
SELECT d.row_no, round(avg(dot / n.norm) / any_value(cn.norm), 6) AS focus FROM d JOIN norms n ON n.row_no = d.row_no AND n.sid = d.sid JOIN cn ON cn.row_no = d.row_no GROUP BY d.row_no""")
def topic_focus(spark, sf_dir):
    return coherence.focus(vectors(spark, sf_dir))


METRICS = ["cohesion", "connectives", "references"]


COHERENT = ["cohesion", "connectives", "refs"]
_SURFACE_REFS = SURFACE.replace('"references"', "refs")


@query(_edges_sql(_SURFACE_REFS, COHERENT))
def frozen_quantile_fit(spark, sf_dir):
    return fitted_edges(eligible(surface(spark, sf_dir).withColumnRenamed("references", "refs"), spark, sf_dir), COHERENT)


@query(_ranks_sql(_SURFACE_REFS, COHERENT))
def frozen_quantile(spark, sf_dir):
    ranked = frozen.apply_quantiles(surface(spark, sf_dir).withColumnRenamed("references", "refs"), kept_quantiles(spark), COHERENT)
    return ranked.select("row_no", *COHERENT, *[f"{m}_rank" for m in COHERENT])


@query()
def pca_fit(spark, sf_dir):
    return spark.createDataFrame(frozen.fit_pca(surface(spark, sf_dir), METRICS), "metric string, mean double, std double, loading double")


#: A model fitted on the 1,000-document table and kept (metric, mean, std, loading).
KEPT_PCA = [("cohesion", 0.029849, 0.086365, -0.52267), ("connectives", 0.267827, 0.190879, 0.64941), ("references", 0.016628, 0.036336, 0.552342)]


@query("SELECT row_no, round(" + " + ".join(f'("{m}" - {mean}::DOUBLE) / {std}::DOUBLE * {w}::DOUBLE' for m, mean, std, w in KEPT_PCA) + f", 6) AS pc1 FROM ({SURFACE})")
def pca_score(spark, sf_dir):
    return surface(spark, sf_dir).select("row_no", frozen.pca_score(KEPT_PCA).alias("pc1"))


@query(f"SELECT row_no, round((cohesion_rank + connectives_rank + refs_rank) / 3, 6) AS score FROM ({ORACLE_SQL['frozen_quantile']})")
def coherence_score(spark, sf_dir):
    ranks = frozen_quantile(spark, sf_dir)
    return ranks.select("row_no", F.round((F.col("cohesion_rank") + F.col("connectives_rank") + F.col("refs_rank")) / 3, 6).alias("score"))


@query(f"SELECT 'original' AS ordering, count(*) AS pairs, round(avg(cosine), 5) AS mean FROM (WITH {_vectors_sql()} SELECT * FROM sims) UNION ALL SELECT 'shuffled', count(*), round(avg(cosine), 5) FROM (WITH {_vectors_sql('7')} SELECT * FROM sims)")
def shuffle_control(spark, sf_dir):
    return coherence.control(docs(spark, sf_dir), P, "7")


# ---- across pipelines ------------------------------------------------------------------------


@query(f"SELECT a.row_no, status, net, ratio, missing_reason FROM (SELECT row_no, status FROM {RATED}) a JOIN ({_scores_sql('raw')}) b ON a.row_no = b.row_no JOIN ({SCORABLE}) c ON a.row_no = c.row_no")
def merge_outputs(spark, sf_dir):
    d = docs(spark, sf_dir)
    return audit.merge([rating.ratings(d, "latin", "doc_id").select("row_no", "status"), sentiment.scores(sentiment.counts(d, P)).select("row_no", "net", "ratio"), readability.scorability(d, P).select("row_no", "missing_reason")])


_RULES = {
    "ratio_is_null_without_hits": "(ratio IS NULL) = (density IS NULL OR density = 0)",
    "polarity_follows_net": "polarity IS NULL OR (polarity = 'positive') = (net > 0)",
    "ratio_is_a_share": "ratio IS NULL OR (ratio >= 0 AND ratio <= 1)",
    "negative_ratio_below_half": "ratio IS NULL OR (ratio < 0.5) = (net < 0)",
}


@query(" UNION ALL ".join(f"SELECT {sql.lit(k)} AS rule, count(*) FILTER (NOT coalesce({c}, false)) AS n FROM ({_scores_sql('raw')})" for k, c in _RULES.items()))
def consistency_check(spark, sf_dir):
    return audit.violations(sentiment_scores(spark, sf_dir), {k: F.expr(c) for k, c in _RULES.items()})


@query(f"SELECT row_no, net, density FROM ({_scores_sql('raw')}) ORDER BY net DESC, row_no LIMIT 20")
def extreme_samples(spark, sf_dir):
    return audit.extremes(sentiment_scores(spark, sf_dir), "net", 20).select("row_no", "net", "density")
