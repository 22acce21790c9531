"""The stages in a row against plain versions, and on odd rows."""

import pytest

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import bpe, stages

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = stages.quality_stage(spark, docs, SF)
    assert good.columns == docs.columns and good.dtypes == docs.dtypes
    left = {r.doc_id: r.text for r in good.collect()}
    assert all((i in left) == bool(q) for i, q in label.items())
    named = stages.language_stage(spark, good, SF)
    assert {r.doc_id for r in named.collect()} == set(left)
    single = stages.near_duplicate_stage(spark, named, SF)
    comp = brute.near(left)
    assert {r.doc_id for r in single.collect()} == {i for i, c in comp.items() if i == c}
    clean = stages.decontamination_stage(spark, single, SF)
    texts = {r.doc_id: r.text for r in single.collect()}
    hit = brute.hits(list(texts.values()), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    want = {i: t for (i, t), h in zip(texts.items(), hit) if not h[1]}
    assert {r.doc_id: r.text for r in clean.collect()} == want
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(stages.RANKS)), special_tokens={})
    assert {r.doc_id: r.ids for r in stages.encoding_stage(spark, clean, SF).collect()} == {i: enc.encode_ordinary(t) for i, t in want.items()}


def test_run_and_odd_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() < 200
    text = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").first().text
    rows = [(1, text, "en", "s", 1, "a"), (1, text, "en", "s", 1, "a"), (None, text + " One more sentence here.", None, None, None, None), (2, None, None, None, None, None), (3, "", "en", "s", 0, "b"), (4, "a", "en", "s", 1, "verdict")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, verdict string").withColumnRenamed("verdict", "row")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert stages.near_duplicate_stage(spark, docs, SF).where("doc_id = 1").count() == 1
    assert stages.quality_stage(spark, docs, SF).where("text is null or text = ''").count() == 0


def test_entry_registers_every_operator():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
