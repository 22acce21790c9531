"""DuckDB text of the derived market tables, and the composer for oracle queries."""

from __future__ import annotations

LEGS = """
legs AS (
  SELECT code, trade_date, px AS open, px * (1 + l_tax * CAST(0.5 AS DOUBLE)) AS high,
         px * (1 - l_discount * CAST(0.4 AS DOUBLE)) AS low,
         px * (1 - l_discount * CAST(0.4 AS DOUBLE))
           + (px * (1 + l_tax * CAST(0.5 AS DOUBLE)) - px * (1 - l_discount * CAST(0.4 AS DOUBLE)))
             * (CAST(l_partkey % 11 AS DOUBLE) / CAST(10.0 AS DOUBLE)) AS close,
         l_quantity AS volume, l_extendedprice AS amount,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_linestatus
  FROM (SELECT *, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS trade_date,
               CAST(20.0 AS DOUBLE) + sqrt(sqrt(l_extendedprice / l_quantity)) AS px FROM lineitem))"""

BARS = """
bars AS (
  SELECT code, trade_date,
         first(open ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(high) AS high, min(low) AS low,
         last(close ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         CAST(sum(volume) AS BIGINT) AS volume, sum(amount) AS amount,
         CAST(sum(volume) AS DOUBLE) / 10.0 AS turnover
  FROM legs GROUP BY code, trade_date)"""

STOCKS = """
stocks AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code,
         CASE WHEN s_suppkey % 17 = 3 THEN '*ST ' WHEN s_suppkey % 23 = 5 THEN '退市 ' ELSE '' END || s_name AS name,
         n_name AS industry, CAST(DATE '1999-01-01' + CAST((s_suppkey * 37) % 1100 AS INTEGER) AS DATE) AS list_date,
         s_acctbal AS acctbal, abs(s_acctbal) * CAST(5e6 AS DOUBLE) AS market_cap,
         abs(s_acctbal) * CAST(3e6 AS DOUBLE) AS float_market_cap,
         s_acctbal / CAST(80 AS DOUBLE) AS pe_ttm, s_acctbal / CAST(700 AS DOUBLE) AS pb,
         s_acctbal / CAST(200 AS DOUBLE) - 5 AS roe, CAST(s_suppkey % 7 AS DOUBLE) AS grade_no
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

CHG = """
chg AS (
  SELECT *, (close - preclose) / preclose * 100 AS pct_chg
  FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS preclose FROM bars))"""

SNAP = """
lastbar AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1),
snap AS (SELECT * FROM lastbar JOIN stocks USING (code))"""

STATEMENTS = """
stm AS (
  SELECT code, CAST(date_trunc('quarter', trade_date) AS DATE) AS report_date, sum(l_extendedprice) AS rev, sum(volume) AS qty,
         sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS ret,
         sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) AS opn, count(*) AS n
  FROM legs GROUP BY ALL),
bs AS (
  SELECT code, report_date, rev * 3 AS total_assets, opn * CAST(2.5 AS DOUBLE) AS total_liabilities,
         rev * 3 - opn * CAST(2.5 AS DOUBLE) AS total_equity, rev * CAST(1.2 AS DOUBLE) AS total_current_assets,
         opn * CAST(1.1 AS DOUBLE) AS total_current_liabilities, ret * CAST(0.5 AS DOUBLE) AS inventory,
         rev * CAST(0.3 AS DOUBLE) AS cash_and_deposits, opn * CAST(0.4 AS DOUBLE) AS accounts_receivable,
         qty * 10 AS share_capital FROM stm),
inc AS (
  SELECT code, report_date, rev AS total_revenue, rev * CAST(0.95 AS DOUBLE) AS operating_revenue,
         ret * CAST(0.9 AS DOUBLE) + rev * CAST(0.4 AS DOUBLE) AS total_cost,
         ret * CAST(0.8 AS DOUBLE) + rev * CAST(0.3 AS DOUBLE) AS operating_cost,
         rev * CAST(0.6 AS DOUBLE) - ret * CAST(0.9 AS DOUBLE) AS operating_profit,
         rev * CAST(0.5 AS DOUBLE) - ret * CAST(0.8 AS DOUBLE) AS net_profit,
         rev * CAST(0.45 AS DOUBLE) - ret * CAST(0.75 AS DOUBLE) AS net_profit_parent,
         (rev * CAST(0.45 AS DOUBLE) - ret * CAST(0.75 AS DOUBLE)) / (qty * 10) AS basic_eps FROM stm),
cf AS (
  SELECT code, report_date, rev * CAST(0.4 AS DOUBLE) - opn * CAST(0.3 AS DOUBLE) AS operating_cash_flow,
         opn * CAST(0.1 AS DOUBLE) AS cash_for_fixed_assets FROM stm)"""

EVENTS = """
ev AS (
  SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS publish_date,
         (['forecast','major','equity','halt','resume'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS kind,
         substr(o_orderpriority, 3) AS subtype, o_totalprice / CAST(100000 AS DOUBLE) AS ratio,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS importance FROM orders)"""

FLOWS = """
flows AS (
  SELECT code, trade_date, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * amount / 100) AS main_net,
         sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * volume) / sum(volume) * 100 AS main_ratio,
         avg(l_linenumber) AS hold_ratio FROM legs GROUP BY code, trade_date)"""

SEATS = """
seats AS (
  SELECT code, trade_date, 'seat' || CAST(l_partkey % 20 AS VARCHAR) AS broker_name, l_returnflag = 'A' AS is_institution,
         (volume - 20) * open AS net_buy_amount, l_orderkey, l_linenumber FROM legs)"""

TICKS = """
ticks AS (
  SELECT event_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, ts, value AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume,
         CASE WHEN event_type IN ('click','purchase','signup') THEN 'B' ELSE 'S' END AS side FROM events)"""

_NEEDS = {
    "legs": (LEGS, []), "bars": (BARS, ["legs"]), "stocks": (STOCKS, []), "chg": (CHG, ["bars"]),
    "snap": (SNAP, ["chg", "stocks"]), "stm": (STATEMENTS, ["legs"]), "ev": (EVENTS, []),
    "flows": (FLOWS, ["legs"]), "seats": (SEATS, ["legs"]), "ticks": (TICKS, []),
}


def sql(body: str, *needs: str) -> str:
    """Oracle text: the named derived tables, then ``body``.

    ``body`` is a SELECT, or further CTEs followed by a SELECT when it starts
    with ``WITH``.
    """
    seen: list[str] = []

    def add(name: str) -> None:
        text, deps = _NEEDS[name]
        for d in deps:
            add(d)
        if text not in seen:
            seen.append(text)

    for n in needs:
        add(n)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",".join(seen + ["\n" + body[5:]]) if seen else body
    return ("WITH " + ",".join(seen) + "\n" if seen else "") + body
