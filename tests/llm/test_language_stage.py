"""Texts in no learned language do not pass the language stage, however long they are."""

import random

from tidemark.llm import stages

SF = "/root/testdata/sf0.01"


def test_unlearned_languages_and_random_letters_are_rejected(spark):
    r = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300 and doc_id < 600").collect()
    other = [d.text for d in docs if d.lang == "fr"]
    rows = [(d.doc_id, d.text, d.lang) for d in docs if d.lang in ("en", "de", "es")]
    own = {i for i, _, _ in rows}
    rows += [(10_000 + i, t, None) for i, t in enumerate(other)]
    rows += [(20_000 + i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)), None) for i, n in enumerate([20, 60, 300, 5000] * 5)]
    left = {x.doc_id for x in stages.language_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF).collect()}
    assert len(left & own) >= 0.99 * len(own)
    assert not any(i >= 20_000 for i in left) and sum(10_000 <= i < 20_000 for i in left) <= 0.02 * len(other)
