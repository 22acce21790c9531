"""Readers and writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.bars import CODE, DATE, normalize_names, parse_date, upsert


def read_files(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None,
               rows_per_file: int | None = None) -> DataFrame:
    """Parquet files united by name; optional projection and row limit per file."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    cols = list(columns or df.columns)
    if rows_per_file is None:
        return df.select(*cols)
    # a row's place in its file tells whether it is among the first: no sort, no task that holds a file
    return df.where(F.col("_metadata.row_index") < rows_per_file).select(*cols)


def read_glob(spark: SparkSession, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.option("mergeSchema", True).parquet(pattern)
    return df.select(*columns) if columns else df


def read_directory(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.option("mergeSchema", True).parquet(path)


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
              columns: Sequence[str] | None = None, skip_bad: bool = False, merge_schema: bool = True) -> DataFrame:
    """Bars in a date range with standard names and types; on DATE columns the range reaches the scan.

    A damaged file is an error unless ``skip_bad``; ``unread_files`` then names what was left out.
    """
    reader = spark.read.option("mergeSchema", merge_schema).option("ignoreCorruptFiles", skip_bad)
    df = normalize_names(reader.parquet(path))
    if not isinstance(df.schema[DATE].dataType, T.DateType):
        df = df.withColumn(DATE, parse_date(DATE))
    if start:
        df = df.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(DATE) <= F.lit(end).cast("date"))
    casts = {c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "amount") if c in df.columns}
    if "volume" in df.columns:
        casts["volume"] = F.col("volume").cast("long")
    df = df.withColumns({CODE: F.col(CODE).cast("string"), **casts})
    return df.select(*columns) if columns else df


def unread_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the Parquet files from which ``read_bars(skip_bad=True)`` got no row."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    read = spark.read.schema("code string").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    return listed.join(read.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path")).distinct(), "path", "left_anti")


def query_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """Run Spark SQL with frames bound to the names used in the text."""
    return spark.sql(sql, **views) if "{" in sql else _with_views(spark, sql, views)


def _with_views(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def query_parquet(spark: SparkSession, pattern: str, where: str | None = None,
                  order_by: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(pattern)
    df = df.where(where) if where else df
    df = df.orderBy(*order_by) if order_by else df
    return df.limit(limit) if limit is not None else df


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", mode: str = "overwrite",
                  partition_by: Sequence[str] = (), rows_per_file: int = 0) -> None:
    writer = df.write.mode(mode).option("compression", codec)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def save_daily(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per trade date; an overwrite replaces only the dates present in ``df``."""
    (df.repartition(DATE, F.pmod(F.xxhash64(CODE), F.lit(8))).write.mode(mode)
       .option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(path))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest date folder; the maximum prunes the scan."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max(DATE)).first()[0]
    return df.where(F.col(DATE) == F.lit(newest))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_daily(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str] = (CODE, DATE),
                 sequence: str | None = None) -> None:
    """Merge bars into date folders, rewriting only the folders ``new`` touches.

    The merged rows go to a sibling folder first, because a job may not
    overwrite the folders it reads; its name is new for each run, so writers do
    not meet there. A table that does not exist yet is made. Keys that occur
    twice in ``new`` need ``sequence``.
    """
    dates = new.select(DATE).distinct()
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], new.schema)
    old = old.join(dates, DATE, "left_semi")
    merged = upsert(old.select(*new.columns) if set(new.columns) <= set(old.columns) else old, new, keys, sequence)
    staged = f"{path.rstrip('/')}_staged-{uuid.uuid4().hex}"
    save_daily(merged, staged, "overwrite")
    part = spark.read.parquet(staged).join(dates, DATE, "left_semi")
    save_daily(part, path, "overwrite")


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **props: str) -> None:
    df.write.jdbc(url, table, mode=mode, properties=props)


def kafka_payload(df: DataFrame, key: str = CODE) -> DataFrame:
    """``key, value`` columns as the Kafka sink expects them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str, key: str = CODE) -> None:
    (kafka_payload(df, key).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def for_each_batch(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Skip empty micro-batches."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(batch, batch_id)
    return run
