"""Queries on prices, adjustment, normalization and indicators."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tickerlake.operators import indicators, merge, prices, timejoin
from tickerlake.plans import bindings as b
from tickerlake.plans.registry import register
from tickerlake.plans.sqlparts import half_even

D = dt.date
LATE = dt.datetime(2001, 6, 1)


@register("flagship_price_history", """
WITH h AS (SELECT a.* FROM adjusted a JOIN instruments USING (instrument_id)
  WHERE trade_date >= coalesce(listing_date, DATE '0001-01-01') AND trade_date <= coalesce(delisting_date, DATE '9999-12-31')
    AND trade_date BETWEEN DATE '1995-02-01' AND DATE '2001-09-30'),
m AS (SELECT *, count(*) OVER w50 AS n50, avg(CAST(adj_close_px AS DOUBLE)) OVER w50 AS a50 FROM h
  WINDOW w50 AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 49 PRECEDING))
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, CAST(adj_close_px AS DOUBLE) AS close_px,
  CASE WHEN n50 = 50 THEN round(a50, 9) END AS sma_50 FROM m""")
def flagship(spark, sf):
    bars = prices.adjusted_close(b.bars(spark, sf), b.actions(spark, sf), parts=b.parts(spark, sf))
    inside = prices.price_history_window(bars, b.instruments(spark, sf), D(1995, 2, 1), D(2001, 9, 30), D(2001, 12, 31))
    out = prices.adjusted_prices(inside)
    w = W.partitionBy("instrument_id").orderBy("trade_date")
    return out.select("instrument_id", "trade_date", "close_px", F.round(indicators.sma(F.col("close_px").cast("double"), 50, w), 9).alias("sma_50"))


@register("asof_dividend_close", """
SELECT corp_action_id, CAST(prior_close AS DOUBLE) AS prior_close FROM action_factors WHERE action_type = 'DIVIDEND'""")
def asof_dividend(spark, sf):
    acts = b.actions(spark, sf).where("action_type = 'DIVIDEND'")
    return prices.asof_dividend_close(acts, b.bars(spark, sf)).select("corp_action_id", "prior_close")


@register("action_factor", "SELECT corp_action_id, action_type, round(factor, 10) AS factor FROM action_factors")
def action_factor(spark, sf):
    return prices.action_factor(b.actions(spark, sf), b.bars(spark, sf)).select("corp_action_id", "action_type", F.round("factor", 10).alias("factor"))


@register("actions_after_date", """
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date,
  (SELECT count(*) FROM actions a WHERE a.instrument_id = b.instrument_id AND a.ex_date > b.trade_date AND a.ex_date >= DATE '1996-01-01') AS later_actions
FROM bars b""")
def actions_after(spark, sf):
    return prices.actions_after_date(b.bars(spark, sf), b.actions(spark, sf), D(1996, 1, 1)).select("instrument_id", "trade_date", "later_actions")


@register("factor_product", "SELECT instrument_id, round(product(factor), 10) AS factor FROM action_factors GROUP BY 1")
def factor_product(spark, sf):
    f = prices.factor_product(prices.action_factor(b.actions(spark, sf), b.bars(spark, sf)))
    return f.select("instrument_id", F.round("factor", 10).alias("factor"))


@register("cumulative_adjustment", "SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, round(adj_factor, 10) AS adj_factor FROM adjusted")
def cumulative(spark, sf):
    bars = b.bars(spark, sf)
    return prices.cumulative_adjustment(bars, prices.action_factor(b.actions(spark, sf), bars)).select(
        "instrument_id", "trade_date", F.round("adj_factor", 10).alias("adj_factor"))


@register("adjusted_close", """
WITH q AS (SELECT DISTINCT instrument_id + CASE WHEN l_orderkey % 50 = 0 THEN 1000000000 ELSE 0 END AS instrument_id,
    trade_date + CAST(l_orderkey % 2 AS INTEGER) AS as_of_date FROM ticks)
SELECT q.instrument_id, CAST(as_of_date AS VARCHAR) AS as_of_date,
  CASE WHEN i.instrument_id IS NULL THEN 'INSTRUMENT_NOT_FOUND' WHEN as_of_date > delisting_date THEN 'DELISTED' WHEN a.instrument_id IS NULL THEN 'NO_PRICE_ROW' END AS error,
  CASE WHEN i.instrument_id IS NOT NULL AND NOT coalesce(as_of_date > delisting_date, false) THEN CAST(adj_close_px AS DOUBLE) END AS adj_close_px
FROM q LEFT JOIN instruments i USING (instrument_id) LEFT JOIN adjusted a ON a.instrument_id = q.instrument_id AND a.trade_date = q.as_of_date""")
def adjusted_close(spark, sf):
    asks = b.ticks(spark, sf).select(
        F.expr("instrument_id + case when l_orderkey % 50 = 0 then 1000000000 else 0 end").alias("instrument_id"),
        F.expr("date_add(trade_date, cast(l_orderkey % 2 as int))").alias("as_of_date")).distinct()
    return prices.adjusted_close_requests(asks, b.bars(spark, sf), b.actions(spark, sf), b.instruments(spark, sf), b.parts(spark, sf)).select(
        "instrument_id", "as_of_date", "error", "adj_close_px")


@register("price_history_window", """
SELECT b.instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, CAST(close_px AS DOUBLE) AS close_px FROM bars b JOIN instruments USING (instrument_id)
WHERE trade_date >= greatest(DATE '1996-01-01', listing_date) AND trade_date <= least(DATE '2001-06-30', DATE '2001-03-31', delisting_date)""")
def price_window(spark, sf):
    return prices.price_history_window(b.bars(spark, sf), b.instruments(spark, sf), D(1996, 1, 1), D(2001, 6, 30), D(2001, 3, 31)).select(
        "instrument_id", "trade_date", "close_px")


_RATIO = "CAST(adj_close_px AS DOUBLE) / CAST(close_px AS DOUBLE)"


@register("adjusted_prices", f"""
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, CAST(adj_close_px AS DOUBLE) AS close_px,
  {half_even("open_px", _RATIO)} AS open_px, {half_even("high_px", _RATIO)} AS high_px, {half_even("low_px", _RATIO)} AS low_px FROM adjusted""")
def adjusted_prices(spark, sf):
    p = prices.adjusted_prices(prices.adjusted_close(b.bars(spark, sf), b.actions(spark, sf), parts=b.parts(spark, sf)))
    return p.select("instrument_id", "trade_date", "close_px", "open_px", "high_px", "low_px")


@register("price_frame_close", """
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS date, CAST(open_px AS DOUBLE) AS open, CAST(high_px AS DOUBLE) AS high, CAST(low_px AS DOUBLE) AS low,
  CAST(adj_close_px AS DOUBLE) AS close, volume FROM adjusted""")
def price_frame(spark, sf):
    return prices.price_frame_close(prices.adjusted_prices(prices.adjusted_close(b.bars(spark, sf), b.actions(spark, sf), parts=b.parts(spark, sf)), adjusted=False))


@register("fx_convert", """
SELECT instrument_id, CAST(b.trade_date AS VARCHAR) AS trade_date, b.ccy = 'USD' AND rate IS NULL AS fx_missing,
  CAST(CASE WHEN b.ccy = 'INR' THEN close_px ELSE CAST(close_px AS DECIMAL(24,6)) * CAST(rate AS DECIMAL(12,6)) END AS DOUBLE) AS close_px
FROM (SELECT *, CASE WHEN instrument_id % 3 = 0 THEN 'USD' ELSE 'INR' END AS ccy FROM bars) b
LEFT JOIN fx_rates f ON f.currency_code = b.ccy AND f.trade_date = b.trade_date""")
def fx(spark, sf):
    rows = b.bars(spark, sf).withColumn("currency_code", F.expr("case when instrument_id % 3 = 0 then 'usd ' else 'INR' end"))
    return prices.fx_convert(rows, b.fx_rates(spark, sf), ["close_px"]).select("instrument_id", "trade_date", "fx_missing", "close_px")


@register("asof_prior_close", """
SELECT b.instrument_id, CAST(b.trade_date AS VARCHAR) AS trade_date, CAST(p.close_px AS DOUBLE) AS prior_close
FROM bars b ASOF LEFT JOIN bars p ON b.instrument_id = p.instrument_id AND b.trade_date > p.trade_date""")
def prior_close(spark, sf):
    bars = b.bars(spark, sf)
    return prices.asof_prior_close(bars.select("instrument_id", "trade_date"), bars).select("instrument_id", "trade_date", "prior_close")


CHECKED = """
SELECT f.*, CASE WHEN regexp_full_match(timestamp, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(timestamp AS DATE) END AS day,
  TRY_CAST(f.open AS DECIMAL(24,6)) AS o, TRY_CAST(f.high AS DECIMAL(24,6)) AS h, TRY_CAST(f.low AS DECIMAL(24,6)) AS l, TRY_CAST(f.close AS DECIMAL(24,6)) AS c,
  upper(currency_code) AS ccy FROM raw_feed f"""
RESOLVED = """
SELECT k.*, x.rate, CASE WHEN ni > 1 THEN NULL WHEN ni = 1 THEN ii WHEN na = 1 THEN ai END AS instrument_id FROM (
  SELECT DISTINCT upper(trim(symbol)) AS sym, exchange AS ex, day, ccy FROM ck) k
LEFT JOIN (SELECT upper(i.symbol) AS sym, exchange_code AS ex, day, count(*) AS ni, min(i.instrument_id) AS ii FROM instruments i JOIN exchanges USING (exchange_id)
  JOIN (SELECT DISTINCT day FROM ck) ON day >= coalesce(listing_date, DATE '0001-01-01') AND day <= coalesce(delisting_date, DATE '9999-12-31') GROUP BY 1, 2, 3) USING (sym, ex, day)
LEFT JOIN (SELECT upper(alias_symbol) AS sym, exchange_code AS ex, day, count(*) AS na, min(a.instrument_id) AS ai FROM aliases a JOIN instruments i ON i.instrument_id = a.instrument_id JOIN exchanges USING (exchange_id)
  JOIN (SELECT DISTINCT day FROM ck) ON day >= coalesce(listing_date, DATE '0001-01-01') AND day <= coalesce(delisting_date, DATE '9999-12-31')
    AND day >= valid_from AND day <= coalesce(valid_to, DATE '9999-12-31') GROUP BY 1, 2, 3) USING (sym, ex, day)
LEFT JOIN fx_rates x ON x.currency_code = k.ccy AND x.trade_date = k.day"""
REASONED = """
SELECT ck.*, r.instrument_id, r.rate,
  CASE WHEN ck.day IS NULL THEN 'bad_trade_date' WHEN CAST(ck.day AS TIMESTAMP) + INTERVAL 10 HOUR > TIMESTAMP '2001-06-01 01:00:00' THEN 'future_event_ts'
    WHEN r.instrument_id IS NULL THEN 'unresolved_symbol'
    WHEN o IS NULL OR h IS NULL OR l IS NULL OR c IS NULL OR (turnover <> '' AND TRY_CAST(turnover AS DOUBLE) IS NULL) THEN 'bad_number'
    WHEN ck.ccy <> 'INR' AND rate IS NULL THEN 'missing_fx_rate' WHEN c <= 0 THEN 'close_must_be_positive'
    WHEN h < l OR h < o OR h < c THEN 'high_bound_violation' WHEN l > o OR l > c THEN 'low_bound_violation' END AS reason
FROM ck LEFT JOIN rs r ON r.sym = upper(trim(ck.symbol)) AND r.ex = ck.exchange AND r.day IS NOT DISTINCT FROM ck.day AND r.ccy = ck.ccy"""


def _feed_rows(spark, sf):
    """Typed, resolved and converted feed, before the checks."""
    from tickerlake.operators import identity

    raw = b.raw_feed(spark, sf, since="0001-01-01")
    typed = prices.typed_feed(raw, ["symbol", "exchange", "currency_code", "source_record_id"]).withColumn("as_of", F.col("trade_date"))
    found = identity.resolve_symbol_as_of(typed, b.instruments(spark, sf), b.exchanges(spark, sf), b.aliases(spark, sf))
    return prices.fx_convert(found, b.fx_rates(spark, sf), ["open_px", "high_px", "low_px", "close_px"])


@register("normalize_ohlcv_checks", f"""
WITH ck AS ({CHECKED.replace("raw_feed f", "raw_feed_all f")}), rs AS ({RESOLVED}), rz AS ({REASONED})
SELECT source_record_id, reason FROM rz""")
def normalize_checks(spark, sf):
    return prices.normalize_ohlcv_checks(_feed_rows(spark, sf), LATE).select("source_record_id", "reason")


_OK = "(s.stored OR w.prev <= 0 OR (s.a{n} / w.prev >= 0.2 AND s.a{n} / w.prev <= 5))"
WALK = """
WITH RECURSIVE {pre}
cand AS ({cand}),
pos AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, trade_date ORDER BY source_record_id) AS p FROM cand),
seq AS (SELECT instrument_id, trade_date, bool_or(stored) AS stored, max(CASE WHEN p = 1 THEN close END) AS c1, max(CASE WHEN p = 1 THEN adj END) AS a1,
  max(CASE WHEN p = 2 THEN close END) AS c2, max(CASE WHEN p = 2 THEN adj END) AS a2, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS rn FROM pos GROUP BY 1, 2),
walk AS (
  SELECT instrument_id, rn, true AS ok1, true AS ok2, c1 AS prev FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.instrument_id, s.rn, ok1, ok2, CASE WHEN ok1 THEN c1 WHEN ok2 AND c2 IS NOT NULL THEN c2 ELSE prev END FROM (
    SELECT s.*, w.prev, __1 AS ok1, __2 AS ok2 FROM walk w JOIN seq s ON s.instrument_id = w.instrument_id AND s.rn = w.rn + 1) s),
judged AS (SELECT pos.*, CASE WHEN p = 1 THEN ok1 ELSE ok2 END AS ok FROM pos JOIN seq USING (instrument_id, trade_date) JOIN walk USING (instrument_id, rn))
""".replace("__1", _OK.format(n=1)).replace("__2", _OK.format(n=2))


@register("sequential_breaker", WALK.format(pre="", cand="SELECT instrument_id, trade_date, CAST(close_px AS DOUBLE) AS close, CAST(adj_close_px AS DOUBLE) AS adj, false AS stored, '' AS source_record_id FROM adjusted") + """
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, ok AS breaker_ok FROM judged""")
def sequential_breaker(spark, sf):
    rows = prices.adjusted_close(b.bars(spark, sf), b.actions(spark, sf), parts=b.parts(spark, sf)).withColumn("ingested_ts", F.col("ingested_at")).withColumn("source_record_id", F.lit(""))
    return prices.sequential_breaker(rows).select("instrument_id", "trade_date", "breaker_ok")


NORMALIZED = WALK.format(
    pre=f"ck AS ({CHECKED}), rs AS ({RESOLVED}), rz AS ({REASONED}),"
    " good AS (SELECT *, CAST(CASE WHEN ccy = 'INR' THEN c ELSE CAST(c AS DECIMAL(24,6)) * CAST(rate AS DECIMAL(12,6)) END AS DECIMAL(18,6)) AS cx FROM rz WHERE reason IS NULL),"
    """ fct AS (SELECT a.*, CASE WHEN action_type IN ('SPLIT','BONUS','RIGHTS') THEN CASE WHEN action_ratio_num = 0 THEN 1.0::DOUBLE ELSE action_ratio_den / action_ratio_num END
      WHEN action_type = 'DIVIDEND' AND (CAST(p.close_px AS DOUBLE) - action_value) / CAST(p.close_px AS DOUBLE) > 0 THEN (CAST(p.close_px AS DOUBLE) - action_value) / CAST(p.close_px AS DOUBLE)
      ELSE 1.0::DOUBLE END AS factor FROM actions a ASOF LEFT JOIN curated_bars p ON a.instrument_id = p.instrument_id AND a.ex_date > p.trade_date),
    fp AS (SELECT g.instrument_id, g.day, product(factor) AS f FROM (SELECT DISTINCT instrument_id, day FROM good) g JOIN fct ON fct.instrument_id = g.instrument_id AND ex_date > g.day GROUP BY 1, 2),
    adjd AS (SELECT g.*, """ + half_even("cx", "coalesce(f, 1.0::DOUBLE)") + """ AS ax FROM good g LEFT JOIN fp USING (instrument_id, day)),""",
    cand="SELECT instrument_id, day AS trade_date, CAST(cx AS DOUBLE) AS close, ax AS adj, false AS stored, source_record_id FROM adjd"
    " UNION ALL SELECT instrument_id, trade_date, CAST(close_px AS DOUBLE), CAST(close_px AS DOUBLE), true, NULL FROM curated_bars",
)


def _normalized(spark, sf):
    return prices.normalize_ohlcv(
        b.raw_feed(spark, sf), b.instruments(spark, sf), b.exchanges(spark, sf), b.aliases(spark, sf),
        b.fx_rates(spark, sf), b.actions(spark, sf), b.curated_bars(spark, sf), LATE)


@register("normalize_ohlcv", NORMALIZED + """
SELECT source_record_id, instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, close AS close_px, adj AS adj_close_px FROM judged WHERE NOT stored AND ok""")
def normalize(spark, sf):
    return _normalized(spark, sf)[0].select(
        "source_record_id", "instrument_id", "trade_date", "close_px", "adj_close_px")


@register("normalize_ohlcv_rejects", NORMALIZED + """
SELECT source_record_id, reason FROM rz WHERE reason IS NOT NULL
UNION ALL SELECT source_record_id, 'adjusted_close_outlier' FROM judged WHERE NOT stored AND NOT ok""")
def normalize_rejects(spark, sf):
    return _normalized(spark, sf)[1].select("source_record_id", "reason")


def _curated(spark, sf):
    return prices.curate_ohlcv(
        b.raw_feed(spark, sf), b.instruments(spark, sf), b.exchanges(spark, sf), b.aliases(spark, sf),
        b.fx_rates(spark, sf), b.actions(spark, sf), b.curated_bars(spark, sf), LATE)


_FX = "CAST(CASE WHEN ccy = 'INR' THEN {0} ELSE CAST({0} AS DECIMAL(24,6)) * CAST(rate AS DECIMAL(12,6)) END AS DOUBLE)"


@register("normalize_ohlcv_curated", NORMALIZED + f"""
SELECT j.instrument_id, CAST(j.trade_date AS VARCHAR) AS trade_date, {_FX.format('o')} AS open_px, {_FX.format('h')} AS high_px, {_FX.format('l')} AS low_px, j.close AS close_px, j.adj AS adj_close_px,
  CAST(rz.volume AS DOUBLE) AS volume, CASE WHEN turnover <> '' THEN {_FX.format('CAST(turnover AS DECIMAL(24,6))')} END AS turnover, upper(trim(rz.source_system)) AS source_system, j.source_record_id, CAST(ingested_ts AS VARCHAR) AS ingested_at
FROM judged j JOIN rz USING (source_record_id) WHERE NOT stored AND ok
QUALIFY row_number() OVER (PARTITION BY j.instrument_id, j.trade_date ORDER BY ingested_ts DESC, j.source_record_id DESC) = 1
UNION ALL SELECT instrument_id, CAST(trade_date AS VARCHAR), CAST(open_px AS DOUBLE), CAST(high_px AS DOUBLE), CAST(low_px AS DOUBLE), CAST(close_px AS DOUBLE), NULL, CAST(volume AS DOUBLE), NULL, source_system, NULL, CAST(ingested_at AS VARCHAR) FROM curated_bars""")
def normalize_curated(spark, sf):
    return _curated(spark, sf)[0].withColumn("volume", F.col("volume").cast("double"))


_CODE = """CASE WHEN reason = 'future_event_ts' THEN 'FUTURE_EVENT_TS' WHEN reason = 'unresolved_symbol' THEN 'UNRESOLVED_SYMBOL' WHEN reason = 'missing_fx_rate' THEN 'MISSING_FX_RATE'
  WHEN reason = 'adjusted_close_outlier' THEN 'ADJUSTED_CLOSE_CIRCUIT_BREAKER' ELSE 'INVALID_OHLCV_PAYLOAD' END"""


@register("normalize_ohlcv_incidents", NORMALIZED + f"""
SELECT symbol || ':' || timestamp AS target_record_key, {_CODE} AS rule_code, 'OPEN' AS incident_status, 'MEDIUM' AS impact_level, 'DATA_ENGINEERING' AS assigned_to, reason AS resolution_notes FROM (
  SELECT symbol, timestamp, reason FROM rz WHERE reason IS NOT NULL
  UNION ALL SELECT rz.symbol, rz.timestamp, 'adjusted_close_outlier' FROM judged JOIN rz USING (source_record_id) WHERE NOT stored AND NOT ok)""")
def normalize_incidents(spark, sf):
    return _curated(spark, sf)[2].drop("opened_at")


@register("ingest_corporate_actions", """
SELECT corp_action_id, action_type, upper(trim(source_system)) AS source_system,
  CASE WHEN action_type = 'XMERGER' THEN 'UNSUPPORTED_ACTION_TYPE' WHEN i.instrument_id IS NULL THEN 'INSTRUMENT_NOT_FOUND' END AS error
FROM (SELECT corp_action_id, source_system, CASE WHEN action_type = 'MERGER' AND corp_action_id % 2 = 0 THEN 'XMERGER' ELSE action_type END AS action_type,
   instrument_id + CASE WHEN corp_action_id % 7 = 0 THEN 1000000000 ELSE 0 END AS instrument_id FROM actions) LEFT JOIN instruments i USING (instrument_id)""")
def ingest_actions(spark, sf):
    raw = b.actions(spark, sf).withColumn(
        "action_type", F.expr("case when action_type = 'MERGER' and corp_action_id % 2 = 0 then 'xMerger' else concat(' ', lower(action_type)) end")
    ).withColumn("instrument_id", F.expr("instrument_id + case when corp_action_id % 7 = 0 then 1000000000 else 0 end"))
    good, bad = prices.ingest_corporate_actions(raw, b.instruments(spark, sf), LATE)
    cols = ["corp_action_id", "action_type", "source_system"]
    return good.select(*cols, F.lit(None).cast("string").alias("error")).unionByName(bad.select(*cols, "error"))


# --- indicators ---------------------------------------------------------------------

def _by_month():
    return W.partitionBy("instrument_id").orderBy("date")


@register("pct_change", """
SELECT instrument_id, CAST(date AS VARCHAR) AS date, round(close / lag(close) OVER (PARTITION BY instrument_id ORDER BY date) - 1, 9) AS ret FROM monthly""")
def pct(spark, sf):
    return b.monthly(spark, sf).select("instrument_id", "date", F.round(indicators.pct_change(F.col("close"), _by_month()), 9).alias("ret"))


@register("sma", """
SELECT instrument_id, CAST(date AS VARCHAR) AS date,
  CASE WHEN count(*) OVER (PARTITION BY instrument_id ORDER BY date ROWS 4 PRECEDING) = 5 THEN round(avg(close) OVER (PARTITION BY instrument_id ORDER BY date ROWS 4 PRECEDING), 3) END AS sma_5,
  CASE WHEN count(*) OVER (PARTITION BY instrument_id ORDER BY date ROWS 49 PRECEDING) = 50 THEN round(avg(close) OVER (PARTITION BY instrument_id ORDER BY date ROWS 49 PRECEDING), 3) END AS sma_50
FROM monthly""")
def sma(spark, sf):
    return b.monthly(spark, sf).select("instrument_id", "date", F.round(indicators.sma(F.col("close"), 5, _by_month()), 3).alias("sma_5"), F.round(indicators.sma(F.col("close"), 50, _by_month()), 3).alias("sma_50"))


@register("sma_daily", """
WITH g AS (SELECT *, count(*) OVER w50 AS n50, avg(CAST(close_px AS DOUBLE)) OVER w50 AS a50, count(*) OVER w200 AS n200, avg(CAST(close_px AS DOUBLE)) OVER w200 AS a200, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) AS back FROM bars
  WINDOW w50 AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 49 PRECEDING), w200 AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 199 PRECEDING))
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN n50 = 50 THEN round(a50, 3) END AS sma_50, CASE WHEN n200 = 200 THEN round(a200, 3) END AS sma_200 FROM g WHERE back <= 20""")
def sma_daily(spark, sf):
    """Means of daily closes, the last 20 rows of every instrument."""
    w, px = W.partitionBy("instrument_id").orderBy("trade_date"), F.col("close_px").cast("double")
    rows = b.bars(spark, sf).select("instrument_id", "trade_date", *[F.round(indicators.sma(px, n, w), 3).alias(f"sma_{n}") for n in (50, 200)])
    return indicators.tail_each(rows, 20, ["instrument_id"], "trade_date")


@register("rsi", """
WITH d AS (SELECT *, close - lag(close) OVER (PARTITION BY instrument_id ORDER BY date) AS d FROM monthly),
g AS (SELECT *, count(d) OVER w AS n, avg(CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END) OVER w AS g, avg(CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END) OVER w AS l FROM d
  WINDOW w AS (PARTITION BY instrument_id ORDER BY date ROWS 13 PRECEDING))
SELECT instrument_id, CAST(date AS VARCHAR) AS date, CASE WHEN n = 14 AND l <> 0 THEN round(100 - 100 / (1 + g / l), 8) END AS rsi FROM g""")
def rsi(spark, sf):
    return indicators.rsi(b.monthly(spark, sf), "close", ["instrument_id"], "date").select("instrument_id", "date", F.round("rsi", 8).alias("rsi"))


@register("ema", """
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date) AS rn FROM monthly),
e AS (SELECT instrument_id, rn, date, close AS v FROM s WHERE rn = 1
  UNION ALL SELECT s.instrument_id, s.rn, s.date, 2.0::DOUBLE / 13 * s.close + (1 - 2.0::DOUBLE / 13) * e.v FROM e JOIN s ON s.instrument_id = e.instrument_id AND s.rn = e.rn + 1)
SELECT instrument_id, CAST(date AS VARCHAR) AS date, round(v, 3) AS ema_12 FROM e""")
def ema(spark, sf):
    return indicators.ema(b.monthly(spark, sf), ["instrument_id"], "date", "close", {"ema_12": 12}).select("instrument_id", "date", F.round("ema_12", 3).alias("ema_12"))


@register("macd", """
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date) AS rn FROM monthly),
e AS (SELECT instrument_id, rn, date, close AS a, close AS b, 0.0::DOUBLE AS sig FROM s WHERE rn = 1
  UNION ALL SELECT instrument_id, rn, date, a, b, 0.2::DOUBLE * (a - b) + 0.8::DOUBLE * sig FROM (
    SELECT s.instrument_id, s.rn, s.date, 2.0::DOUBLE / 13 * s.close + 11.0::DOUBLE / 13 * e.a AS a, 2.0::DOUBLE / 27 * s.close + 25.0::DOUBLE / 27 * e.b AS b, e.sig
    FROM e JOIN s ON s.instrument_id = e.instrument_id AND s.rn = e.rn + 1))
SELECT instrument_id, CAST(date AS VARCHAR) AS date, round(a - b, 2) AS macd, round(sig, 2) AS signal FROM e""")
def macd(spark, sf):
    m = indicators.macd(b.monthly(spark, sf), ["instrument_id"], "date", "close")
    return m.select("instrument_id", "date", F.round("macd", 2).alias("macd"), F.round("signal", 2).alias("signal"))


@register("bollinger", """
WITH g AS (SELECT *, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM monthly WINDOW w AS (PARTITION BY instrument_id ORDER BY date ROWS 19 PRECEDING))
SELECT instrument_id, CAST(date AS VARCHAR) AS date, CASE WHEN n = 20 THEN round(m + 2 * s, 1) END AS upper_band, CASE WHEN n = 20 THEN round(m - 2 * s, 1) END AS lower_band FROM g""")
def bollinger(spark, sf):
    up, low = indicators.bollinger(F.col("close"), _by_month())
    return b.monthly(spark, sf).select("instrument_id", "date", F.round(up, 1).alias("upper_band"), F.round(low, 1).alias("lower_band"))


@register("volume_footprint", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) AS rn FROM bars)
SELECT instrument_id, round(avg(CASE WHEN rn <= 20 THEN volume END) / greatest(avg(volume), 1), 9) AS footprint FROM r GROUP BY 1""")
def footprint(spark, sf):
    return indicators.volume_footprint(b.bars(spark, sf), ["instrument_id"], "trade_date", "volume").select("instrument_id", F.round("footprint", 9).alias("footprint"))


@register("annualized_drift", """
WITH r AS (SELECT instrument_id, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY date) - 1 AS r FROM monthly)
SELECT instrument_id, round(avg(r) * 252, 6) AS drift FROM r GROUP BY 1""")
def drift(spark, sf):
    return indicators.annualized_drift(b.monthly(spark, sf), ["instrument_id"], "date", "close").select("instrument_id", F.round("drift", 6).alias("drift"))


RET = """
WITH j AS (SELECT a.instrument_id, a.date, a.close AS asset, m.close AS market FROM monthly a JOIN market m USING (date)),
r AS (SELECT instrument_id, asset / lag(asset) OVER w - 1 AS ra, market / lag(market) OVER w - 1 AS rm FROM j WINDOW w AS (PARTITION BY instrument_id ORDER BY date))
"""


@register("covariance_beta", RET + """
SELECT instrument_id, round(covar_samp(ra, rm) / nullif(var_samp(rm), 0), 7) AS beta FROM r WHERE ra IS NOT NULL AND rm IS NOT NULL GROUP BY 1""")
def beta(spark, sf):
    r = indicators._aligned_returns(b.monthly(spark, sf), b.market(spark, sf), ["instrument_id"])
    return indicators.covariance_beta(r, ["instrument_id"]).select("instrument_id", F.round("beta", 7).alias("beta"))


@register("capm", RET + """, s AS (SELECT instrument_id, covar_samp(ra, rm) / nullif(var_samp(rm), 0) AS beta, avg(ra) AS ma, avg(rm) AS mm FROM r WHERE ra IS NOT NULL AND rm IS NOT NULL GROUP BY 1)
SELECT instrument_id, round(beta, 6) AS beta, round((ma - 0.07 / 252 - coalesce(beta * (mm - 0.07 / 252), 0)) * 252, 4) AS alpha,
  round(0.07 + coalesce(beta * (0.12 - 0.07), 0), 6) AS expected_return FROM s""")
def capm(spark, sf):
    c = indicators.capm(b.monthly(spark, sf), b.market(spark, sf), ["instrument_id"], 0.07, 0.12)
    return c.select("instrument_id", F.round("beta", 6).alias("beta"), F.round("alpha", 4).alias("alpha"), F.round("expected_return", 6).alias("expected_return"))


@register("period_change", """
SELECT instrument_id, round(max_by(close, date) / min_by(close, date) - 1, 9) AS change FROM monthly GROUP BY 1""")
def change(spark, sf):
    return indicators.period_change(b.monthly(spark, sf), ["instrument_id"], "date", "close").select("instrument_id", F.round("change", 9).alias("change"))


@register("asset_market_join", """
SELECT a.instrument_id, CAST(a.date AS VARCHAR) AS date, a.close AS asset, m.close AS market FROM monthly a JOIN market m USING (date)""")
def align(spark, sf):
    return indicators.asset_market_join(b.monthly(spark, sf), b.market(spark, sf)).select("instrument_id", "date", "asset", "market")


@register("combine_series", """
WITH s AS (SELECT CAST(date_trunc('month', trade_date) AS DATE) AS date, l_returnflag AS f, CAST(CAST(sum(px_u) AS BIGINT) // count(*) AS DOUBLE) AS close FROM ticks GROUP BY 1, 2)
SELECT CAST(date AS VARCHAR) AS date, max(CASE WHEN f = 'A' THEN close END) AS A, max(CASE WHEN f = 'N' THEN close END) AS N, max(CASE WHEN f = 'R' THEN close END) AS R FROM s GROUP BY 1""")
def combine(spark, sf):
    s = b.ticks(spark, sf).groupBy(F.trunc("trade_date", "month").alias("date"), "l_returnflag").agg(F.expr("cast(sum(px_u) div count(1) as double)").alias("close"))
    return indicators.combine_series(s, "l_returnflag", ["A", "N", "R"])


@register("tail_n", """
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, volume FROM bars ORDER BY bars.trade_date DESC, instrument_id DESC LIMIT 20""")
def tail(spark, sf):
    return indicators.tail_n(b.bars(spark, sf).select("instrument_id", "trade_date", "volume"), 20, ["trade_date", "instrument_id"])


@register("head_n", "SELECT corp_action_id, action_type FROM actions ORDER BY ex_date DESC, corp_action_id LIMIT 25")
def head(spark, sf):
    return indicators.head_n(b.actions(spark, sf), 25, [F.desc("ex_date"), F.col("corp_action_id")]).select("corp_action_id", "action_type")


@register("latest_version", """
WITH v AS (SELECT instrument_id, trade_date, px_u, l_orderkey * 16 + l_linenumber AS seq, l_orderkey % 4 AS ver FROM ticks)
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, px_u FROM v
QUALIFY row_number() OVER (PARTITION BY instrument_id, trade_date ORDER BY ver DESC, seq, px_u) = 1""")
def latest_version(spark, sf):
    v = b.ticks(spark, sf).select("instrument_id", "trade_date", "px_u", F.expr("l_orderkey * 16 + l_linenumber").alias("seq"), F.expr("l_orderkey % 4").alias("ver"))
    return merge.latest_version(v, ["instrument_id", "trade_date"], "ver", ["seq", "px_u"], ["px_u"])
