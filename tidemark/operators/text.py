"""Lexicon sentiment and duplicate news."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default lexicon.
POSITIVE = ["增长", "上涨", "利好", "超预期", "看好", "突破", "创新", "领先", "扩张", "提升", "改善", "强劲", "优异", "成功", "合作",
            "签约", "订单", "中标", "获批", "通过", "完成", "达成"]
NEGATIVE = ["下跌", "亏损", "利空", "不及预期", "看空", "跌破", "下滑", "衰退", "恶化", "风险", "问题", "违规", "处罚", "调查", "诉讼",
            "仲裁", "违约", "逾期", "停产", "裁员", "减持"]
INTENSIFIERS = ["大幅", "显著", "明显", "严重", "重大", "急剧"]


def sentiment(df: DataFrame, text: str = "text", positive: Sequence[str] = tuple(POSITIVE), negative: Sequence[str] = tuple(NEGATIVE),
              intensifiers: Sequence[str] = tuple(INTENSIFIERS)) -> DataFrame:
    """Score in [-1, 1], label at ±0.2, confidence by the number of hits and matched keywords; whole texts, JVM-side."""
    def hits(words: Sequence[str]):
        return F.array_compact(F.array(*[F.when(F.contains(F.col(text), F.lit(w)), w) for w in words]))

    x = df.withColumns({"_p": hits(positive), "_n": hits(negative), "_i": F.size(hits(intensifiers))})
    raw = (F.size("_p") - F.size("_n")) * 0.2 * (1 + F.col("_i") * 0.5)
    x = x.withColumn("sentiment_score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    s = F.col("sentiment_score")
    return x.withColumns({
        "sentiment": F.when(s > 0.2, "positive").when(s < -0.2, "negative").otherwise("neutral"),
        "confidence": F.least(F.lit(1.0), (F.size("_p") + F.size("_n")) * 0.2 + 0.3),
        "keywords": F.array_join(F.concat("_p", "_n"), ",")}).drop("_p", "_n", "_i")


def market_sentiment(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("sentiment_score").alias("avg_score"),
        *[F.count_if(F.col("sentiment") == k).alias(k) for k in ("positive", "negative", "neutral")])


def duplicate_news(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Flag texts whose trimmed lower-case content occurred in a row with a smaller key.

    First keys per content hash come from a map-side minimum, so a group of
    copies never gathers in one task.
    """
    x = df.withColumn("_h", F.sha2(F.lower(F.trim(text)), 256))
    first = x.groupBy("_h").agg(F.min(key).alias("_first"))
    return x.join(first, "_h").withColumn("is_duplicate", F.col(key) > F.col("_first")).drop("_h", "_first")
