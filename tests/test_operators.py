"""Written cases, and properties that results must have whatever the rules."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.profiles import LATIN, ZH
from inkwell.operators import audit, coherence, frozen, rating, readability, sentiment, tone
from inkwell.plans.report_queries import cases, docs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rated(spark):
    return {r["row_no"]: r for r in rating.ratings(cases(spark), "zh", "doc_id").collect()}


@pytest.mark.parametrize(
    ("row", "std", "action", "status"),
    [(-1, "买入", "维持", "extracted"), (-2, "增持", None, "extracted"), (-3, "增持", "维持", "extracted"), (-4, "增持", "维持", "extracted"), (-5, None, None, "declared_none"), (-6, None, None, "missed"), (-7, None, None, "no_text"), (-8, None, None, "no_text")],
)
def test_ratings(rated, row, std, action, status):
    r = rated[row]
    assert (r["std"], r["action"], r["status"]) == (std, action, status)


def test_raw_rating_is_kept(rated):
    assert rated[-2]["raw"] == "谨慎增持"


def test_cleaning_and_paragraphs(spark):
    rows = {r["doc_id"]: r for r in cases(spark).select("doc_id", tx.clean(tx.text()).alias("t"), F.split(tx.text(), ZH.paragraph).alias("p"), sentiment.body(tx.text(), ZH).alias("b")).collect()}
    assert rows[-10]["t"] == "业绩增长"
    assert len(rows[-9]["p"]) == 2
    assert rows[-9]["b"] == "业绩良好"


def test_semicolons_end_sentences_in_the_contrast_only(spark):
    row = cases(spark).where("doc_id = -13").select(F.size(tx.sentences(tx.text(), ZH)).alias("a"), F.size(tx.pieces(tx.text(), ZH.sentence_semicolon)).alias("b")).first()
    assert (row["a"], row["b"]) == (1, 2)


def test_masking_keeps_places(spark):
    row = cases(spark).where("doc_id = -12").select(tone.mask(tx.text(), ZH).alias("m"), tx.text().alias("t")).first()
    assert len(row["m"]) == len(row["t"])
    assert row["m"].count("强烈") == 1


def test_negators_flip_within_their_sentence(spark):
    df = spark.createDataFrame([(1, "nicht mit und"), (2, "nicht. mit"), (3, "nicht pas mit"), (4, "nicht a b c mit")], "doc_id long, text string")
    got = {r["row_no"]: (r["pos_negated"], r["neg_negated"]) for r in sentiment.counts(df, LATIN).collect()}
    assert got == {1: (0, 1), 2: (1, 0), 3: (1, 0), 4: (1, 0)}


def test_chinese_words_are_found_inside_runs_of_characters(spark):
    texts = {1: "业绩良好", 2: "业绩并未改善", 3: "未来业绩不断提升", 4: "业绩并非没有改善，收入负增长", 5: "EPS增长10%。没有亏损"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: [(h["word"], h["flipped"]) for h in r["h"]] for r in df.select("doc_id", sentiment.hits(tx.text(), ZH).alias("h")).collect()}
    assert found == {1: [("良好", False)], 2: [("改善", True)], 3: [("提升", False)], 4: [("改善", False)], 5: [("增长", False), ("亏损", True)]}
    polarity = {r["row_no"]: (r["ratio"], r["polarity"]) for r in sentiment.scores(sentiment.counts(df, ZH), "negated").collect()}
    assert polarity[1] == (1.0, "positive")
    assert polarity[2] == (0.0, "negative")


def test_masked_grade_is_one_hit_at_its_place(spark):
    case = cases(spark).where("doc_id = -12")
    assert tone.scores(case, ZH).first()["strength"] == 1
    (hit,) = tone.hit_places(case, ZH).collect()
    assert (hit["word"], hit["dim"], hit["start"], hit["end"]) == ("强烈", "strength", 7, 9)


def test_company_names_are_no_hits(spark):
    case = cases(spark).where("doc_id = -14")
    assert sentiment.counts(case, ZH).first()["pos_raw"] == 4
    assert sentiment.counts(case, ZH, company_col="company").first()["pos_raw"] == 2


def test_wide_sentiment_of_a_chinese_case(spark):
    row = sentiment.wide(sentiment.counts(cases(spark).where("doc_id in (-9, -11)"), ZH)).orderBy("row_no").collect()
    assert len(row[0]) == 28
    assert (row[0]["words_raw"], row[0]["words_negated"], row[0]["polarity_negated"]) == ("改善", "-改善", "negative")
    assert (row[1]["words_raw"], row[1]["words_body"], row[1]["routine"]) == ("良好 风险 下滑 风险", "良好", 3)


def test_long_sentences_take_time_in_proportion(spark):
    def seconds(words):
        df = spark.createDataFrame([(1, "mit pas und wort " * (words // 4))], "doc_id long, text string")
        began = time.time()
        assert sentiment.counts(df, LATIN).first()["pos_raw"] == words // 4
        return time.time() - began

    seconds(2_000)
    assert seconds(64_000) < 8 * seconds(16_000) + 2


def test_doubled_text_has_the_same_ratio(spark):
    d = docs(spark, SF).select("doc_id", "text")
    once = sentiment.scores(sentiment.counts(d, LATIN)).select("row_no", "ratio")
    twice = sentiment.scores(sentiment.counts(d.withColumn("text", F.concat_ws("\n", "text", "text")), LATIN)).select("row_no", F.col("ratio").alias("r2"))
    assert once.join(twice, "row_no").where("NOT ratio <=> r2").count() == 0


def test_every_row_stays(spark):
    d = docs(spark, SF)
    for out in (sentiment.counts(d, LATIN), readability.scorability(d, LATIN), tone.wide(d, LATIN), coherence.surface(d, LATIN), rating.ratings(d, "latin", "doc_id")):
        assert out.count() == d.count()
    assert len(tone.wide(d, LATIN).columns) == 34


def test_untouched_dimensions_are_the_same_in_both_versions(spark):
    d = docs(spark, SF)
    assert audit.version_diff(tone.scores(d, LATIN, 1), tone.scores(d, LATIN, 2), ["vagueness"]).count() == 0


def test_shuffled_sentences_are_less_alike(spark):
    a, b = "der hund und der hund.", "xyz wv qj."
    df = spark.createDataFrame([(i, " ".join([a] * 6 + [b] * 6)) for i in range(4)], "doc_id long, text string")
    mean = lambda seed: coherence.similarities(coherence.weighted(coherence.grams(coherence.sentence_rows(df, LATIN, shuffled=seed)))).agg(F.avg("cosine")).first()[0]
    assert mean("7") < mean(None)


def test_frozen_tables_are_never_fitted_again(spark):
    d = spark.range(10).select(F.col("id").cast("double").alias("x"))
    kept = frozen.fit_quantiles(d, ["x"])
    assert frozen.apply_quantiles(d, kept, ["x"]).agg(F.max("x_rank")).first()[0] == 1.0
    with pytest.raises(ValueError, match="frozen"):
        frozen.apply_quantiles(d.withColumn("y", F.col("x")), kept, ["y"])


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), 1e300, -1e300, 0.0, rng.random() * 1e-9, 5.0]) for _ in range(3_000)]
    d = spark.createDataFrame([(v, None if i % 3 else float(i), None) for i, v in enumerate(values)], "x double, y double, z double").repartition(4)
    got = frozen.quantiles(d, ["x", "y", "z"])
    assert got["x"] == pytest.approx(np.quantile(values, frozen.STEPS))
    assert got["y"] == pytest.approx(np.quantile(range(0, 3_000, 3), frozen.STEPS))
    assert got["z"] == [None] * 9
    assert frozen.quantiles(d.limit(0), ["x"])["x"] == [None] * 9


def test_references_are_saved_once_and_loaded(spark, tmp_path):
    d = spark.range(101).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2 == 0).alias("ok"))
    frozen.save(frozen.fit_quantiles(d, ["x"], F.col("ok")), f"{tmp_path}/q")
    frozen.save(frozen.fit_moments(d, ["x"]), f"{tmp_path}/m")
    assert frozen.load(spark, f"{tmp_path}/q", "quantiles").first()["edges"] == pytest.approx([10.0 * i for i in range(1, 10)])
    z = frozen.z_scores(frozen.load(spark, f"{tmp_path}/m", "moments"), ["x"])["x"]
    assert d.agg(F.stddev_pop(z)).first()[0] == pytest.approx(1)
    with pytest.raises(Exception, match="exist"):
        frozen.save(frozen.fit_moments(d, ["x"]), f"{tmp_path}/m")
    with pytest.raises(ValueError, match="frozen"):
        frozen.z_scores(frozen.load(spark, f"{tmp_path}/m", "moments"), ["y"])


def test_pca_signs_and_scores(spark):
    d = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0 + 1).alias("b"))
    model = frozen.fit_pca(d, ["a", "b"])
    assert max(x for *_, x in model) > 0
    assert abs(d.agg(F.avg(frozen.pca_score(model))).first()[0]) < 1e-6


def test_merge_refuses_shared_names(spark):
    d = spark.range(3).select(F.col("id").alias("row_no"), F.lit(1).alias("x"))
    with pytest.raises(ValueError, match="share"):
        audit.merge([d, d])


def test_merge_refuses_rows_that_do_not_match(spark):
    a, b = spark.range(3).select(F.col("id").alias("row_no"), F.lit(1).alias("x")), spark.range(3).select(F.col("id").alias("row_no"), F.lit(2).alias("y"))
    assert sorted(map(tuple, audit.merge([a, b]).collect())) == [(0, 1, 2), (1, 1, 2), (2, 1, 2)]
    with pytest.raises(Exception, match="lacks the row 2"):
        audit.merge([a, b.where("row_no < 2")]).collect()
    with pytest.raises(Exception, match="repeats the row"):
        audit.merge([a, b.unionByName(b)]).collect()


def test_weights_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    d = docs(spark, SF).limit(30)
    rows = lambda: sorted((r["row_no"], r["sid"], r["gram"], round(r["w"], 9)) for r in coherence.weighted(coherence.grams(coherence.sentence_rows(d, LATIN))).collect())
    few = rows()
    monkeypatch.setattr(coherence, "BROADCAST", 10)
    assert rows() == few


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sentiment.scores(sentiment.counts(d, LATIN)).count() == 0
    assert tone.hit_places(d, LATIN).count() == 0
    assert coherence.similarities(coherence.weighted(coherence.grams(coherence.sentence_rows(d, LATIN)))).count() == 0


@pytest.mark.parametrize("most", [500_000, 10])
def test_shuffled_control_of_odd_rows_agrees_with_sql(spark, tmp_path, monkeypatch, most):
    import duckdb

    from inkwell.plans import report_queries

    rng = random.Random(3)
    some = lambda: "".join(rng.choice(["ab", "ba c", "É𝔘漢", "x", ". ", "! ", "\n", "und A"]) for _ in range(rng.randrange(60)))
    # ids that several rows share have no sentence in common, so that no order is left open
    rows = [(i, some()) for i in range(40)] + [(50, None), (51, ""), (52, "x. ab. ab. y. ab. ba"), (None, "ab. ba. ab. ba c"), (None, "ab. ab"), (53, "one sentence"), (53, ". "), (54, "ab")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(coherence, "BROADCAST", most)
    monkeypatch.setattr(coherence, "SLICE_BYTES", 300)
    monkeypatch.setattr(coherence, "SLICE_SENTENCES", 7)
    got = sorted(map(tuple, report_queries.shuffle_control(spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.sql(report_queries.ORACLE_SQL["shuffle_control"]).fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1.1e-5)


def test_shuffled_control_makes_no_row_per_gram(spark):
    """Two passes over the texts, and no join, sort or window of grams."""
    d = spark.createDataFrame([(i, "ab ba. ba c. ab") for i in range(5)], "doc_id long, text string")
    plan = coherence.control(d, LATIN, "7")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Generate explode(transform", "Join", "Sort "))


def test_fitting_components_splits_each_text_once(spark):
    metrics = ["cohesion", "connectives", "references"]
    plan = frozen.complete(coherence.surface(docs(spark, SF), LATIN), metrics).agg(*[F.corr("cohesion", m) for m in metrics[1:]])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_components_are_fitted_on_complete_rows(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 100.0), (100.0, None), (float("nan"), 100.0), (100.0, float("nan"))]
    got = frozen.fit_pca(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    want = frozen.fit_pca(spark.createDataFrame(rows[:3], "a double, b double"), ["a", "b"])
    assert [x[0] for x in got] == ["a", "b"]
    assert [v for x in got for v in x[1:]] == pytest.approx([v for x in want for v in x[1:]])
    assert got[0][1:3] == pytest.approx((2.0, (2 / 3) ** 0.5))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_places_of_hits_in_odd_texts_agree_with_sql(spark, tmp_path, monkeypatch, block):
    import duckdb

    from inkwell.plans import report_queries

    rng = random.Random(4)
    some = lambda n: "".join(rng.choice(["and ", "y", " of ", "En", "é", "𝔘漢 ", "is", " ", "12", "\n", "Licensed under the ", "to."]) for _ in range(n))
    rows = [(i, some(rng.randrange(50))) for i in range(60)] + [(70, None), (71, ""), (72, " 1\n"), (73, "and"), (74, "to" + " " * 40 + "to\n"), (75, "x and " * 700), (80, "x and y of"), (80, "is it of some and more"), (None, "to and y"), (None, "or so en")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(tone, "BLOCK", block)
    got = report_queries.tone_evidence(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(c.sql(f"SELECT {', '.join(f'"{x}"' for x in got.columns)} FROM ({report_queries.ORACLE_SQL['tone_evidence']})").fetchall(), key=str)


def test_places_of_hits_are_found_row_by_row(spark):
    plan = tone.hit_places(docs(spark, SF), LATIN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all(") == 1


def test_places_of_hits_take_time_in_proportion_to_the_text(spark):
    def seconds(n):
        began = time.time()
        tone.hit_places(spark.createDataFrame([(1, "1 " * n + "and " * n)], "doc_id long, text string"), LATIN).agg(F.sum(F.length("snippet"))).collect()
        return time.time() - began

    seconds(10)
    assert seconds(100_000) < 20
