"""The nine quote scans, on a batch and on a stream of the same quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quote_scans as Q
from tidemark.plans import inputs as I
from tidemark.plans.catalog import query, rounded
from tidemark.plans.ctes import sql
from tidemark.plans.q_stream import to_files
from tidemark.plans.q_technical import P, roll
from tidemark.streaming.stream import scan_stream


def quotes(events):
    """Events as quotes of the codes; the numbers follow from the event's id."""
    k = lambda n: F.pmod("event_id", F.lit(n))
    return events.select(
        "event_id", I.code_of_mod("user_id").alias("code"), (22 + k(90) / 10).alias("price"), (k(160) / 10 - 5).alias("change_pct"), (k(130) / 10).alias("turnover_rate"),
        k(101).cast("double").alias("volume"), (k(40) / 10).alias("volume_ratio"), (k(110) / 10).alias("amplitude"), F.lit(10.0).alias("limit_pct"), (k(3) == 0).alias("in_pool"),
        F.when(k(4) != 0, k(4).cast("int")).alias("consecutive_limit"))


SCANS = sql(f"""
WITH h AS (SELECT *, row_number() OVER ({P}) AS i, {roll('avg', 'close', 5)} AS m5, {roll('avg', 'close', 10)} AS m10, {roll('avg', 'close', 20)} AS m20,
 max(high) OVER ({P} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS h60, CASE WHEN count(volume) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)=5 THEN avg(volume) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS av,
 row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS rn FROM bars),
q AS (SELECT event_id, lpad(CAST(user_id%100 AS VARCHAR), 6, '0') AS code, 22+event_id%90/10::DOUBLE AS price, event_id%160/10::DOUBLE-5 AS ch, event_id%130/10::DOUBLE AS tu, (event_id%101)::DOUBLE AS vo,
 event_id%40/10::DOUBLE AS vr, event_id%110/10::DOUBLE AS am, event_id%3=0 AND event_id%160/10::DOUBLE-5>=10*0.98::DOUBLE AS lu, CASE WHEN event_id%4<>0 THEN event_id%4 ELSE 1 END AS co FROM events),
j AS (SELECT q.*, i, m5, m10, m20, h60, coalesce(m5>m10 AND m10>m20, false) AS up, CASE WHEN coalesce(av, vo)>0 THEN vo/coalesce(av, vo) ELSE 0 END AS sg FROM q LEFT JOIN (SELECT * FROM h WHERE rn=1) USING (code)),
u AS (SELECT event_id, code, 'limit_up' AS signal, (90+co*5)::DOUBLE AS s FROM j WHERE lu
UNION ALL SELECT event_id, code, 'fast_rise', ch*10 FROM j WHERE ch>=5 AND ch<10*0.98::DOUBLE
UNION ALL SELECT event_id, code, 'volume_price', tu*20 FROM j WHERE ch>=3 AND tu>=5 AND vr>=2
UNION ALL SELECT event_id, code, 'breakout_high', 80+ch*5 FROM j WHERE ch>3 AND i>=30 AND price>=h60*0.98::DOUBLE
UNION ALL SELECT event_id, code, 'near_limit', least(ch,9)*8+CASE WHEN 10-ch<2 THEN 30 WHEN 10-ch<5 THEN 20 WHEN 10-ch<8 THEN 10 ELSE 0 END+CASE WHEN up THEN 15 ELSE 0 END+CASE WHEN price>m20 THEN 10 ELSE 0 END
 +CASE WHEN sg>2 THEN 15 WHEN sg>1.5 THEN 10 ELSE 0 END+least(tu,15)*1.5 FROM j WHERE NOT lu AND ch>5 AND tu>=5 AND i>=20
UNION ALL SELECT event_id, code, 'reversal', 70+ch*5 FROM j WHERE ch BETWEEN -3 AND 2 AND tu>=5 AND i>=30 AND price<m20*1.1::DOUBLE AND price>m5
UNION ALL SELECT event_id, code, 'high_turnover', tu*5 FROM j WHERE tu>=10 AND ch>0
UNION ALL SELECT event_id, code, 'strong_signal', 85+vr*3 FROM j WHERE vr>2.5 AND am>6.5 AND ch>2.44::DOUBLE AND i>=30 AND up
UNION ALL SELECT event_id, code, 'quality_non_limit', CASE WHEN up THEN 25 ELSE 0 END+CASE WHEN price>m20 THEN 15 ELSE 0 END+CASE WHEN price<m20*1.15::DOUBLE THEN 10 ELSE 0 END+CASE WHEN sg>1.5 THEN 20 ELSE 0 END+least(ch,10)*2
 FROM j WHERE NOT lu AND ch>0 AND tu>=3 AND am>3 AND i>=20)
SELECT event_id, code, signal, round(s,6) AS signal_score FROM u""", "bars")

query("m22_quote_scans", SCANS)(
    lambda s, d: rounded(Q.quote_scans(quotes(I.table(s, d, "events")), Q.history_features(I.bars(s, d))).select("event_id", "code", "signal", "signal_score"), 6))


@query("st06_quote_scans", SCANS)
def streamed_scans(s, d):
    live = s.readStream.schema(I.table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return to_files(s, rounded(scan_stream(quotes(live), Q.history_features(I.bars(s, d))).select("event_id", "code", "signal", "signal_score"), 6))
