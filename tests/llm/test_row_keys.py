"""One id on two texts, and texts without an id."""

from tests.llm.test_operators import prose
from tidemark.llm import stages

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, note string"


def left(stage, spark, rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), SF).collect())


def test_a_copy_under_an_id_leaves_its_other_text(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a, "x"), (5, a + " more", "x"), (5, b, "x"), (5, b, "y"), (None, c, "x"), (None, c, "y"), (None, c + " more", "x"), (None, a, "x"), (2 ** 63 - 1, prose(60, 4), "x")]
    got = left(stages.near_duplicate_stage, spark, rows)
    assert len(got) == 4 and (5, b) in got and (2 ** 63 - 1, prose(60, 4)) in got
    assert sum(t.startswith(a) for _, t in got) == 1 and sum(i == -1 and t.startswith(c) for i, t in got) == 1


def test_a_leaked_text_leaves_the_other_of_its_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    rows = [(5, item, "x"), (5, prose(60, 2), "x"), (None, item, "x"), (None, prose(60, 3), "x"), (7, prose(60, 4), "x")]
    assert left(stages.decontamination_stage, spark, rows) == sorted([(5, prose(60, 2)), (-1, prose(60, 3)), (7, prose(60, 4))])
