"""Nothing is lost without a word: upserts, walks, damaged files, folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import Ema, with_ema
from tidemark.operators import quality, strategies, text
from tidemark.sources import bars as B
from tidemark.sources import files as S
from tidemark.streaming import stream as ST

DAY = dt.date(2024, 1, 2)


def bars(spark, rows):
    return spark.createDataFrame(rows, "code string, trade_date date, close double, seq long")


def test_upsert_needs_an_order_for_repeated_keys(spark):
    old, new = bars(spark, [("1", DAY, 1.0, 0)]), bars(spark, [("1", DAY, 2.0, 1), ("1", DAY, 3.0, 2)])
    with pytest.raises(Exception, match="several rows for one key"):
        B.upsert(old, new).collect()
    assert [r.close for r in B.upsert(old, new, sequence="seq").collect()] == [3.0]
    assert B.upsert(old.drop("seq"), new, sequence="seq").columns == ["code", "trade_date", "close"]


def test_sink_makes_its_table_and_replays(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = ST.upsert_sink(spark, path, "seq")
    for _ in range(2):
        sink(bars(spark, [("1", DAY, 2.0, 1), ("1", DAY, 3.0, 2), ("2", DAY, 5.0, 1)]), 1)
    assert sorted((r.code, r.close) for r in spark.read.parquet(path).collect()) == [("1", 3.0), ("2", 5.0)]


def test_walk_goes_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(15)] + [(15, 3)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in quality.lineage_reach(edges, start).collect()} == {i: i for i in range(1, 16)}
    assert quality.lineage_reach(edges, start, max_depth=4).count() == 4


def test_damaged_file_is_an_error_or_named(spark, tmp_path):
    path = tmp_path / "bars"
    bars(spark, [("1", DAY, 1.0, 0)]).coalesce(1).write.parquet(str(path))
    (path / "bad.parquet").write_bytes(b"PAR1 no parquet PAR1")
    with pytest.raises(Exception):
        S.read_bars(spark, str(path)).collect()
    assert S.read_bars(spark, str(path), skip_bad=True).count() == 1
    assert [r.path.rsplit("/")[-1] for r in S.unread_files(spark, str(path)).collect()] == ["bad.parquet"]


def test_no_machine_local_checkpoint_on_a_cluster():
    from tidemark import session

    class Conf(dict):
        pass

    class Context:
        master, applicationId = "spark://host:7077", "x"
        getConf = lambda self: Conf()

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_average_of_span_one_is_the_value(spark):
    df = bars(spark, [("1", DAY + dt.timedelta(i), float(i * i), i) for i in range(5)])
    rows = with_ema(df, {"one": Ema("close", span=1), "two": Ema("close", span=2)}).collect()
    assert all(r.one == r.close for r in rows) and any(r.two != r.close for r in rows)


def test_names_cleaning_confidence_and_allocation(spark):
    assert B.normalize_names(spark.createDataFrame([(1.0,)], "pct_change double")).columns == ["pct_chg"]
    one = spark.createDataFrame([("1", DAY, 1.0, 2.0, 1.0, 1.1, v) for v in (5, 9, 7)], "code string, trade_date date, open double, high double, low double, close double, volume long")
    assert [r.volume for r in quality.clean_bars(one).collect()] == [9]
    said = text.sentiment(spark.createDataFrame([("good bad good-ish",), ("x",)], "text string"), positive=["good"], negative=["bad"], intensifiers=[]).collect()
    assert [round(r.confidence, 6) for r in said] == [0.7, 0.3]
    shares = strategies.kelly(spark.createDataFrame([(0.6, 2.0), (0.5, 1.0)], "win_rate double, profit_loss_ratio double"), total=10).orderBy(F.desc("kelly")).collect()
    assert [r.allocation for r in shares] == [8, 2] or sum(r.allocation for r in shares) <= 11


def test_screens_return_all_rows_unless_asked(spark):
    from tidemark.operators import filters, scoring
    df = spark.range(50).selectExpr("cast(id as string) as code", "'S' as grade", "cast(id as double) as enhanced_score")
    assert filters.grade_screen(df, "S", 0).count() == 50 and filters.grade_screen(df, "S", 0, top=3).count() == 3
    assert scoring.top_n(df, "enhanced_score", None).count() == 50
