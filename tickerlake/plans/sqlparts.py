"""The binding rules in SQL, as named parts for the checking queries."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def half_even(px: str, factor: str) -> str:
    """SQL for px (six places) times a factor (fourteen places), half even at six places."""
    n = f"(CAST(round(CAST({px} AS DOUBLE) * 1000000) AS HUGEINT) * CAST(round({factor} * 100000000000000) AS HUGEINT))"
    q, r = f"({n} // 100000000000000)", f"({n} % 100000000000000)"
    up = f"CASE WHEN {r} > 50000000000000 OR ({r} = 50000000000000 AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    return f"(CAST({q} + {up} AS DOUBLE) / 1000000)"


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def query(body: str, recursive: bool = False) -> str:
    """``body`` with the parts it mentions, directly or through other parts, in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in order and re.search(rf"\b(from|join)\s+{name}\b", text, re.I):
                visit(PARTS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    parts = [f"{n} AS ({PARTS[n]})" for n in order]
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    head = "WITH RECURSIVE " if recursive or (m and m.group(1)) else "WITH "
    if m:
        rest = body[m.end():]
        return head + ",\n".join([*parts, rest])
    return (head + ",\n".join(parts) + "\n" + body) if parts else body


part("ticks", """
SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS trade_date, l_orderkey, l_linenumber, l_returnflag,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc,
  CAST(l_quantity AS BIGINT) AS qty,
  (CAST(round(l_extendedprice * 100) AS BIGINT) * 10000) // CAST(l_quantity AS BIGINT) AS px_u FROM lineitem""")
part("bars_u", """
SELECT instrument_id, trade_date,
  CAST(min(CAST(l_orderkey * 16 + l_linenumber AS HUGEINT) * 10000000000000 + px_u) % 10000000000000 AS BIGINT) AS open_u,
  CAST(max(CAST(l_orderkey * 16 + l_linenumber AS HUGEINT) * 10000000000000 + px_u) % 10000000000000 AS BIGINT) AS close_u,
  max(px_u) AS high_u, min(px_u) AS low_u, CAST(sum(qty) AS BIGINT) AS volume
FROM ticks GROUP BY ALL""")
part("bars", """
SELECT instrument_id, trade_date, CAST(CAST(open_u AS DECIMAL(18,0)) * 0.000001 AS DECIMAL(18,6)) AS open_px,
  CAST(CAST(high_u AS DECIMAL(18,0)) * 0.000001 AS DECIMAL(18,6)) AS high_px,
  CAST(CAST(low_u AS DECIMAL(18,0)) * 0.000001 AS DECIMAL(18,6)) AS low_px,
  CAST(CAST(close_u AS DECIMAL(18,0)) * 0.000001 AS DECIMAL(18,6)) AS close_px, volume,
  CASE WHEN instrument_id % 2 = 0 THEN 'NSE_EOD' ELSE 'BSE_EOD' END AS source_system,
  CAST(trade_date AS TIMESTAMP) + INTERVAL 12 HOUR AS ingested_at FROM bars_u""")
part("actions", """
SELECT l_orderkey * 10000000 + cents % 10000000 AS corp_action_id, instrument_id,
  CASE l_orderkey % 5 WHEN 0 THEN 'SPLIT' WHEN 1 THEN 'BONUS' WHEN 2 THEN 'DIVIDEND' WHEN 3 THEN 'RIGHTS' ELSE 'MERGER' END AS action_type,
  trade_date AS ex_date, CAST(CASE WHEN l_orderkey % 5 = 2 THEN (disc + 1) * 100 END AS DOUBLE) AS action_value,
  CAST(CASE WHEN l_orderkey % 5 IN (0, 1, 3) THEN CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 3 + 1 END END AS DOUBLE) AS action_ratio_num,
  CAST(CASE WHEN l_orderkey % 5 IN (0, 1, 3) THEN 1 END AS DOUBLE) AS action_ratio_den,
  CASE WHEN instrument_id % 2 = 0 THEN ' nse ' ELSE 'BSE' END AS source_system
FROM ticks WHERE l_returnflag = 'R' AND l_linenumber = 1 AND qty >= 40""")
part("exchanges", """
SELECT r_regionkey + 1 AS exchange_id, CASE r_regionkey WHEN 0 THEN 'NSE' WHEN 1 THEN 'BSE' ELSE 'BSE_SME' END AS exchange_code
FROM region WHERE r_regionkey < 3""")
part("instruments", """
SELECT s_suppkey AS instrument_id, md5('I' || s_suppkey) AS instrument_uuid, s_suppkey AS company_id,
  CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE s_nationkey % 3 + 1 END AS exchange_id,
  CASE WHEN s_suppkey % 13 = 0 THEN 'DUP' || (s_suppkey // 26) ELSE 'S' || upper(substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 9)) END AS symbol,
  'EQUITY' AS instrument_type,
  CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE DATE '1995-01-01' + CAST(s_suppkey * 37 % 700 AS INTEGER) END AS listing_date,
  CASE WHEN s_suppkey % 7 = 3 THEN DATE '2000-01-01' + CAST(s_suppkey % 365 AS INTEGER) END AS delisting_date,
  s_suppkey % 11 <> 5 AS is_active FROM supplier""")
part("companies", """
SELECT s_suppkey AS company_id, md5('C' || s_suppkey) AS company_uuid, s_name AS legal_name,
  CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE 'IN' || upper(substr(md5('Q' || (s_suppkey // 2)), 1, 9)) || (s_suppkey // 2 % 10) END AS isin_primary,
  r_name AS sector_code, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS industry_code
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
part("aliases", """
SELECT s_suppkey * 2 AS alias_id, s_suppkey AS instrument_id, CASE WHEN s_suppkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS source_system,
  'O' || upper(substr(md5('A' || s_suppkey), 1, 8)) AS alias_symbol, DATE '1995-01-01' AS valid_from, DATE '1998-06-30' AS valid_to FROM supplier
UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey, 'BSE',
  CASE WHEN s_suppkey % 10 = 0 THEN 'PAIR' || (s_suppkey // 20) ELSE 'N' || upper(substr(md5('B' || s_suppkey), 1, 8)) END,
  DATE '1998-07-01', CASE WHEN s_suppkey % 8 = 1 THEN DATE '2001-01-31' END FROM supplier""")
part("requests", """
SELECT CASE l_orderkey % 8
    WHEN 0 THEN coalesce(isin_primary, symbol)
    WHEN 1 THEN symbol || '.' || CASE exchange_code WHEN 'NSE' THEN 'ns' WHEN 'BSE' THEN 'BO' ELSE 'SME' END
    WHEN 2 THEN symbol WHEN 3 THEN o.alias_symbol
    WHEN 4 THEN substr(n.alias_symbol, 1, length(n.alias_symbol) - 1) || 'Z'
    WHEN 5 THEN 'zz' || o.alias_symbol WHEN 6 THEN '?' || symbol || symbol
    ELSE '  ' || lower(symbol) || ' ' END AS identifier,
  CASE WHEN l_orderkey % 16 = 2 THEN exchange_code END AS exchange_mic,
  trade_date AS as_of, exchange_code, symbol, o.alias_symbol AS old_name, l_orderkey
FROM ticks t JOIN instruments i USING (instrument_id) JOIN exchanges USING (exchange_id) JOIN companies USING (company_id)
JOIN aliases o ON o.instrument_id = t.instrument_id AND o.alias_id % 2 = 0
JOIN aliases n ON n.instrument_id = t.instrument_id AND n.alias_id % 2 = 1""")
part("feed_k", """
SELECT b.*, i.symbol AS sym, exchange_code, o.alias_symbol AS old_name, b.instrument_id * 31 + date_diff('day', DATE '1995-01-01', trade_date) AS k
FROM bars b JOIN instruments i ON i.instrument_id = b.instrument_id JOIN exchanges USING (exchange_id)
JOIN aliases o ON o.instrument_id = b.instrument_id AND o.alias_id % 2 = 0""")
part("raw_feed_all", """
SELECT CASE WHEN k % 17 = 0 THEN 'UNK' || k WHEN k % 10 = 0 THEN lower(old_name) ELSE sym END AS symbol, exchange_code AS exchange,
  lower(source_system) || ' ' AS source_system, CASE WHEN k % 6 = 0 THEN 'usd' ELSE 'INR' END AS currency_code,
  CAST(open_px AS VARCHAR) AS open, CASE WHEN k % 103 = 0 THEN '0.01' ELSE CAST(high_px AS VARCHAR) END AS high,
  CASE WHEN k % 97 = 0 THEN '99999999' ELSE CAST(low_px AS VARCHAR) END AS low,
  CASE WHEN k % 101 = 0 THEN 'n/a' WHEN k % 107 = 0 THEN '0' ELSE CAST(close_px AS VARCHAR) END AS close,
  CAST(volume AS VARCHAR) AS volume, CASE WHEN k % 3 = 0 THEN '' WHEN k % 89 = 0 THEN 'x' ELSE CAST(volume * 2 AS VARCHAR) END AS turnover,
  CASE WHEN k % 109 = 0 THEN '31/12/1999' ELSE CAST(trade_date AS VARCHAR) END AS timestamp,
  ingested_at AS ingested_ts, 'f' || instrument_id || ':' || CAST(trade_date AS VARCHAR) AS source_record_id, trade_date AS bar_date FROM feed_k""")
part("raw_feed", "SELECT * EXCLUDE (bar_date) FROM raw_feed_all WHERE bar_date >= DATE '1995-03-01'")
part("curated_bars", "SELECT * FROM bars WHERE trade_date < DATE '1995-03-01'")
part("fx_rates", """
SELECT DISTINCT 'USD' AS currency_code, trade_date, CAST(80 + month(trade_date) AS DECIMAL(18,6)) AS rate FROM ticks WHERE day(trade_date) <> 13""")
part("monthly", """
SELECT instrument_id, CAST(date_trunc('month', trade_date) AS DATE) AS date, CAST(CAST(sum(px_u) AS BIGINT) // count(*) AS DOUBLE) AS close,
  CAST(sum(qty) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2""")
part("market", """
SELECT CAST(date_trunc('month', trade_date) AS DATE) AS date, CAST(CAST(sum(px_u) AS BIGINT) // count(*) AS DOUBLE) AS close FROM ticks GROUP BY 1""")
part("action_factors", """
SELECT a.*, p.close_px AS prior_close,
  CASE WHEN action_type IN ('SPLIT','BONUS','RIGHTS') THEN CASE WHEN action_ratio_num = 0 OR action_ratio_num IS NULL OR action_ratio_den IS NULL THEN 1.0::DOUBLE ELSE action_ratio_den / action_ratio_num END
    WHEN action_type = 'DIVIDEND' AND CAST(p.close_px AS DOUBLE) > 0 AND (CAST(p.close_px AS DOUBLE) - action_value) / CAST(p.close_px AS DOUBLE) > 0
      THEN (CAST(p.close_px AS DOUBLE) - action_value) / CAST(p.close_px AS DOUBLE) ELSE 1.0::DOUBLE END AS factor
FROM actions a ASOF LEFT JOIN bars p ON a.instrument_id = p.instrument_id AND a.ex_date > p.trade_date""")
part("adjusted", f"""
SELECT *, CAST({half_even("close_px", "adj_factor")} AS DECIMAL(18,6)) AS adj_close_px FROM (
  SELECT b.*, coalesce(f.factor, 1.0::DOUBLE) AS adj_factor
  FROM bars b LEFT JOIN (SELECT b.instrument_id, b.trade_date, product(a.factor) AS factor FROM bars b JOIN action_factors a
    ON a.instrument_id = b.instrument_id AND a.ex_date > b.trade_date GROUP BY 1, 2) f USING (instrument_id, trade_date))""")
