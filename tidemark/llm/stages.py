"""Corpus stages: each takes and returns whole rows of documents, so that its decisions take effect.

Defined results: rows keep all their columns, whatever their names; null texts are rejected by the quality and language
stages; the near-duplicate and decontamination stages judge and remove by id and text, so one text of a repeated id does
not take another with it; texts without ``doc_id`` take part like others; of rows equal in id and text the near-duplicate
stage keeps one; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, language, neardup, quality
from tidemark.llm.common import stored, table

#: Least posterior of the language a document is kept for; its margin (see ``language``) must not be negative either.
LANGUAGE_SCORE = 0.5
#: File of the tokenizer's ranks, the window of the benchmark in words, and how far a word may stand from its place in it.
RANKS, WINDOW, NEAR = "byte_bpe_multi_50k.tiktoken", 10, 2


def _where(docs: DataFrame, verdict: Column, keep) -> DataFrame:
    """Rows that ``keep(verdict)`` holds for; the verdict is computed once, beside the row."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), verdict.alias("verdict")).where(keep(F.col("verdict"))).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready = quality.prepared(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return ready.select("row", quality.judge(ready, quality.fit(ready)).alias("verdict")).where(F.col("verdict")["score"] >= quality.THRESHOLD).select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return _where(docs, language.predictor(docs, model)(F.col("text").cast("string")), lambda v: (v["lang"] != "und") & (v["score"] >= LANGUAGE_SCORE) & (v["margin"] >= 0))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``: whole rows, and a number for each pair of id and text.

    It is the id itself where one text has it. Further texts of an id, and texts without one, get numbers outside all ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"), F.hash("text").alias("g"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    pairs = rows.select("id", "h", "g").distinct()
    first = pairs.where("id is not null").groupBy("id").agg(F.min(F.struct("h", "g")).alias("f"), F.count(F.lit(1)).alias("n"))
    more = first.where("n > 1").join(pairs, "id").where(F.struct("h", "g") != F.col("f")).select("id", "h", "g")
    extra = stored(more.unionByName(pairs.where("id is null")).withColumn("number", F.monotonically_increasing_id()), "keys")
    top = extra.agg(F.max("number")).first()[0]
    if top is None:
        return rows.select(F.col("id").alias("doc_id"), "text", "row")
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if high is None or high <= 2 ** 63 - 2 - top:
        number = F.col("number") + F.lit((high if high is not None else -1) + 1)
    elif low >= -2 ** 63 + 1 + top:
        number = F.lit(low - 1) - F.col("number")
    else:
        raise ValueError("doc_id covers the whole range of long, so no number is left for repeated ids")
    extra = extra.select(F.col("id").alias("i"), F.col("h").alias("hh"), F.col("g").alias("gg"), number.alias("number"))
    return (rows.join(extra, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")) & (F.col("g") == F.col("gg")), "left")
            .select(F.coalesce("number", "id").alias("doc_id"), "text", "row"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    judged = neardup.near_duplicates(rows)
    kept = neardup.pick(rows, judged.where(~F.col("kept")).select("doc_id").distinct(), "left_anti")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    found = decontaminate.decontaminate(rows.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), WINDOW, NEAR)
    leaked = found.where(F.col("contaminated") | (F.size("near_items") > 0)).select("doc_id").distinct()
    return neardup.pick(rows, leaked, "left_anti").select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")
