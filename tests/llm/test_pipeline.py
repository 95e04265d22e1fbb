"""The stages, each on its own input, and the whole against the operators."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_llm_operators import components_brute, windows_brute

import __spark_entry__ as entry
import corpus_pipeline as cp
from inkwell.llm import packing
from inkwell.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in cp.STAGES:
        docs.append(written(stage(spark, docs[-1], SF)))
    return docs


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(outputs):
    for df in outputs[:-1]:
        assert df.columns == cp.COLUMNS
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact", "near", "substrings", "packing"]


def test_toxicity_keeps_rows_as_they_are(outputs):
    assert outputs[1].exceptAll(outputs[0]).count() == 0
    assert 0 < outputs[1].count() < outputs[0].count()


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_exact_stage(outputs):
    """Against a dictionary of all texts without white space."""
    best = {}
    for i, t in rows_of(outputs[1]):
        best.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i))
    assert ids(outputs[2]) == {min(g)[1] for g in best.values()}
    assert outputs[2].exceptAll(outputs[1]).count() == 0


def test_near_stage(outputs):
    """Against the similarity of all pairs."""
    component = components_brute(rows_of(outputs[2]))
    assert ids(outputs[3]) == {i for i, (_, c) in component.items() if c == i}
    assert outputs[3].exceptAll(outputs[2]).count() == 0


def test_substring_stage(outputs):
    """Against a dictionary of all windows."""
    expected = windows_brute(rows_of(outputs[3]))
    got = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows_of(outputs[4])}
    assert got == {i: h for i, (_, _, h) in expected.items()}
    assert outputs[4].where("n_chars <> length(text)").count() == 0
    assert outputs[4].join(outputs[3].select("doc_id", "lang", "source"), ["doc_id", "lang", "source"]).count() == outputs[3].count()


def test_packing_stage(outputs):
    """Against the tokenizer library, and the bound that the number of ids gives."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    got = outputs[5].toPandas()
    lengths = got.groupby("doc_id").length.sum().to_dict()
    assert lengths == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows_of(outputs[4])}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_run_is_the_stages(spark, outputs):
    assert entry.queries()["pipeline"] is cp.run
    out = cp.run(spark, SF)
    assert out.exceptAll(outputs[5]).count() == 0
    assert out.count() == outputs[5].count()


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("packed", F.lit(1))
    kept = {"toxicity": [None, 1, 2, 3, 3], "exact": [1, 3], "near": [1, 3], "substrings": [1, 3], "packing": [1, 3]}
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF))
        assert sorted(map(str, [r["doc_id"] for r in docs.select("doc_id").collect()])) == sorted(map(str, kept[name])), name
