"""SQL rules of the fundamentals and valuation bindings."""

from tickerlake.plans.bindings import LINES, METRIC_RULES
from tickerlake.plans.sqlparts import part


def _duck(e: str) -> str:
    return e.replace(" div ", " // ")


part("yearly", """
SELECT instrument_id, fiscal_year, rev, gp, p123, p12, p1, p2, p3, p4, p5, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM (
  SELECT o_custkey AS instrument_id, year(o_orderdate) AS fiscal_year, CAST(sum(c) AS BIGINT) AS rev, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN c END) AS BIGINT) AS gp,
    CAST(sum(CASE WHEN p <= 3 THEN c END) AS BIGINT) AS p123, CAST(sum(CASE WHEN p <= 2 THEN c END) AS BIGINT) AS p12, CAST(sum(CASE WHEN p = 1 THEN c END) AS BIGINT) AS p1,
    CAST(sum(CASE WHEN p = 2 THEN c END) AS BIGINT) AS p2, CAST(sum(CASE WHEN p = 3 THEN c END) AS BIGINT) AS p3, CAST(sum(CASE WHEN p = 4 THEN c END) AS BIGINT) AS p4,
    CAST(sum(CASE WHEN p = 5 THEN c END) AS BIGINT) AS p5
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p FROM orders) GROUP BY 1, 2)
JOIN customer ON c_custkey = instrument_id""")
part("parsed_facts", "\nUNION ALL ".join(
    f"SELECT (instrument_id * 100 + fiscal_year - 1990) * 20 + {i} AS statement_fact_id, instrument_id, fiscal_year, 'FY' AS fiscal_period, '{st}' AS statement_type, '{k}' AS line_item_code, "
    f"CAST(CAST({_duck(e)} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(24,4)) AS value, CAST(make_date(CAST(fiscal_year AS BIGINT), 12, 31) AS TIMESTAMP) AS as_reported_ts, CAST(make_date(CAST(fiscal_year + 1 AS BIGINT), 2, 1) AS TIMESTAMP) AS ingested_at FROM yearly"
    for k, (i, st, e) in LINES.items()))
part("facts", "SELECT * FROM parsed_facts WHERE value IS NOT NULL")
part("info", """
SELECT c_custkey AS instrument_id, CAST(CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 30 / 10.0 END AS DOUBLE) AS current_ratio,
 CAST(c_custkey % 20 / 10.0 AS DOUBLE) AS quick_ratio, CAST((c_custkey % 1000 + 1) * 1000 AS DOUBLE) AS market_cap,
 CAST(c_custkey % 4 * 10 AS DOUBLE) AS current_price, CAST(c_custkey % 3 * 7 AS DOUBLE) AS regular_market_price, CAST(c_custkey % 5 AS DOUBLE) AS previous_close,
 CAST(c_custkey % 6 * 1.5 AS DOUBLE) AS trailing_eps, CAST(c_custkey % 9 * 100 AS DOUBLE) AS ebitda, CAST(c_custkey % 7 * 3 AS DOUBLE) AS book_value,
 CAST(CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 50 * 1000 END AS DOUBLE) AS total_revenue, CAST((c_custkey % 100 + 3) * 900 AS DOUBLE) AS enterprise_value,
 CAST(c_custkey % 5 * 4 AS DOUBLE) AS trailing_pe, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0.2 END AS DOUBLE) AS profit_margins, CAST(c_custkey % 4 * 0.5 AS DOUBLE) AS price_to_sales,
 CAST(CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 40 * 10 END AS DOUBLE) AS depreciation_amortization, CAST(-(c_custkey % 12 * 25) AS DOUBLE) AS capital_expenditure,
 CAST(CASE WHEN c_custkey % 2 = 0 THEN 0.3 END AS DOUBLE) AS effective_tax_rate, CAST(c_custkey % 90 * 50 AS DOUBLE) AS total_debt, CAST(c_custkey % 70 * 20 AS DOUBLE) AS total_cash,
 CAST(c_custkey % 500 AS DOUBLE) AS shares_outstanding, 0.10::DOUBLE AS wacc, CAST(CASE WHEN c_custkey % 13 = 0 THEN 0.12 ELSE 0.03 END AS DOUBLE) AS terminal_growth,
 5 AS forecast_years, 0.08::DOUBLE AS revenue_cagr, 0.18::DOUBLE AS ebit_margin FROM customer""")
part("value_instruments", """
SELECT c_custkey AS instrument_id, md5('V' || c_custkey) AS instrument_uuid, c_custkey AS company_id, c_nationkey % 3 + 1 AS exchange_id, 'C' || c_custkey AS symbol,
 CASE WHEN c_custkey % 4 <> 1 THEN DATE '1995-01-01' + CAST(c_custkey % 900 AS INTEGER) END AS listing_date,
 CASE WHEN c_custkey % 29 = 4 THEN DATE '1999-06-30' END AS delisting_date, c_custkey % 17 <> 3 AS is_active FROM customer""")
part("value_companies", """
SELECT c_custkey AS company_id, CASE WHEN c_custkey % 37 <> 0 THEN c_mktsegment END AS sector_code,
 CASE WHEN c_custkey % 37 <> 0 AND c_nationkey % 5 <> 0 THEN c_mktsegment || '_' || c_nationkey END AS industry_code FROM customer""")
part("metric_base", """
SELECT instrument_id, fiscal_year, max(CASE WHEN line_item_code = 'EBITDA' THEN value END) AS ebitda, max(CASE WHEN line_item_code = 'NET_INCOME' THEN value END) AS ni,
 max(CASE WHEN line_item_code = 'TOTAL_EQUITY' THEN value END) AS eq, max(CASE WHEN line_item_code = 'TOTAL_REVENUE' THEN value END) AS rev,
 coalesce(max(CASE WHEN line_item_code = 'TOTAL_DEBT' THEN value END), 0) AS debt, max(CASE WHEN line_item_code = 'CASH' THEN value END) AS cash, 1000 + instrument_id % 500 AS sh
FROM parsed_facts GROUP BY 1, 2""")
part("metrics", "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT (instrument_id * 100 + fiscal_year - 1990) * 20 + {i} AS metric_fact_id, instrument_id, '{k}' AS metric_code, CAST({e} AS DOUBLE) AS metric_value, make_date(CAST(fiscal_year AS BIGINT), 12, 31) AS as_of_date FROM metric_base"
    for i, (k, e) in enumerate(METRIC_RULES.items())) + ") WHERE metric_value IS NOT NULL")
part("val_requests", """
SELECT c_custkey + 1 AS val_run_id, c_custkey AS instrument_id, CAST(0.09 + c_custkey % 5 * 0.01 AS DOUBLE) AS wacc,
 CAST(CASE WHEN c_custkey % 41 = 0 THEN 0.2 ELSE 0.03 + c_custkey % 3 * 0.005 END AS DOUBLE) AS terminal_growth, CAST(3 + c_custkey % 5 AS BIGINT) AS forecast_years,
 CAST(0.02 + c_custkey % 7 * 0.01 AS DOUBLE) AS revenue_cagr, CAST(0.1 + c_custkey % 4 * 0.05 AS DOUBLE) AS ebit_margin, c_custkey % 43 = 0 AS short_capex FROM customer""")
part("statements", """
SELECT instrument_id, label, period, CASE WHEN c % 10 <> 0 THEN CAST(CASE WHEN label LIKE 'C%' AND instrument_id % 3 = 0 THEN -c ELSE c END AS DOUBLE) END AS value FROM (
 SELECT o_custkey AS instrument_id, ['Current Assets','Current Liabilities','Inventory','Total Revenue','Revenue','Cost Of Revenue','Accounts Receivable','Accounts Payable',
  'Free Cash Flow','Operating Cash Flow','Capital Expenditure','Net Income','Gross Profit','EBITDA','Stockholders Equity','Total Equity Gross Minority Interest'][o_orderkey % 16 + 1] AS label,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS period, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY 1, 2, 3)""")
part("income_long", """
SELECT o_custkey AS instrument_id, ['Total Revenue','Operating Revenue','Gross Profit','Net Income','Capital Expenditure'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS label,
 year(o_orderdate) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1, 2, 3""")
# metrics known at the valuation date, wide
part("metric_now", "SELECT instrument_id, " + ", ".join(
    f"max_by(CASE WHEN metric_code = '{k}' THEN metric_value END, as_of_date) FILTER (metric_code = '{k}') AS {n}"
    for n, k in {"ev": "ENTERPRISE_VALUE", "eqv": "EQUITY_VALUE", "ebitda": "EBITDA", "earn": "EARNINGS", "book": "BOOK_VALUE", "sales": "SALES", "nd": "NET_DEBT", "sh": "SHARE_COUNT"}.items())
    + " FROM metrics WHERE as_of_date <= DATE '2000-12-31' GROUP BY 1")
part("metric_state", """
SELECT *, CASE WHEN ev IS NULL THEN 'ENTERPRISE_VALUE' WHEN eqv IS NULL THEN 'EQUITY_VALUE' WHEN ebitda IS NULL THEN 'EBITDA' WHEN earn IS NULL THEN 'EARNINGS' WHEN book IS NULL THEN 'BOOK_VALUE'
 WHEN sales IS NULL THEN 'SALES' WHEN nd IS NULL THEN 'NET_DEBT' WHEN sh IS NULL THEN 'SHARE_COUNT' END AS missing FROM metric_now""")
part("universe", """
SELECT i.instrument_id, sector_code, industry_code, coalesce(industry_code, sector_code) AS gk, CASE WHEN industry_code IS NOT NULL THEN 'INDUSTRY' WHEN sector_code IS NOT NULL THEN 'SECTOR' END AS gkind,
 is_active AND coalesce(listing_date, DATE '0001-01-01') <= DATE '2000-12-31' AND coalesce(delisting_date, DATE '9999-12-31') >= DATE '2000-12-31' AS is_peer
FROM value_instruments i JOIN value_companies USING (company_id)""")
part("peer_pairs", """
SELECT t.instrument_id, p.instrument_id AS peer_id FROM universe t JOIN universe p ON p.is_peer AND p.instrument_id <> t.instrument_id AND p.industry_code = t.industry_code
UNION ALL SELECT t.instrument_id, p.instrument_id FROM universe t JOIN universe p ON p.is_peer AND p.instrument_id <> t.instrument_id AND t.industry_code IS NULL AND p.sector_code = t.sector_code""")
part("mult", """
SELECT instrument_id, 'EV/EBITDA' AS m, CASE WHEN ebitda > 0 THEN ev / ebitda END AS v FROM metric_state WHERE missing IS NULL
UNION ALL SELECT instrument_id, 'P/E', CASE WHEN earn > 0 THEN eqv / earn END FROM metric_state WHERE missing IS NULL
UNION ALL SELECT instrument_id, 'P/B', CASE WHEN book > 0 THEN eqv / book END FROM metric_state WHERE missing IS NULL
UNION ALL SELECT instrument_id, 'EV/Sales', CASE WHEN sales > 0 THEN ev / sales END FROM metric_state WHERE missing IS NULL""")
part("rel_multiple", """
SELECT t.instrument_id, t.m, n, q1, med, q3 FROM (SELECT s.instrument_id, x.m FROM metric_state s, (SELECT unnest(['EV/EBITDA','P/E','P/B','EV/Sales']) AS m) x WHERE s.missing IS NULL) t
LEFT JOIN (SELECT instrument_id, m, len(l) AS n, list_aggregate(l, 'median') AS med, CASE WHEN len(l) = 1 THEN l[1] ELSE list_aggregate(l[1:len(l) // 2], 'median') END AS q1,
   CASE WHEN len(l) = 1 THEN l[1] ELSE list_aggregate(l[len(l) - len(l) // 2 + 1:], 'median') END AS q3
  FROM (SELECT p.instrument_id, m, list(v ORDER BY v) AS l FROM peer_pairs p JOIN mult ON mult.instrument_id = p.peer_id WHERE v IS NOT NULL GROUP BY 1, 2)) USING (instrument_id, m)""")
part("peer_gap", """
SELECT p.instrument_id, count(*) AS gaps FROM peer_pairs p LEFT JOIN metric_state s ON s.instrument_id = p.peer_id WHERE s.instrument_id IS NULL OR s.missing IS NOT NULL GROUP BY 1""")
part("rel_value", """
SELECT instrument_id, CASE WHEN coalesce(gaps, 0) > 0 THEN 'FAILED' WHEN short > 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS rel_status,
  CASE WHEN coalesce(gaps, 0) = 0 AND short = 0 THEN eq END AS rel_equity, CASE WHEN coalesce(gaps, 0) = 0 AND short = 0 THEN pr END AS rel_price,
  CASE WHEN coalesce(gaps, 0) = 0 AND short = 0 THEN eq + nd END AS rel_enterprise, CASE WHEN coalesce(gaps, 0) = 0 AND short = 0 THEN mx END AS peers FROM (
  SELECT r.instrument_id, any_value(gaps) AS gaps, count(*) FILTER (coalesce(n, 0) < 3) AS short, max(n) AS mx, median(e) AS eq, median(e / sh) AS pr, any_value(nd) AS nd FROM (
    SELECT r.*, nd, sh, CASE m WHEN 'EV/EBITDA' THEN med * ebitda - nd WHEN 'P/E' THEN med * earn WHEN 'P/B' THEN med * book ELSE med * sales - nd END AS e
    FROM rel_multiple r JOIN metric_state USING (instrument_id)) r LEFT JOIN peer_gap g ON g.instrument_id = r.instrument_id GROUP BY 1)""")
part("dcf_base", """
SELECT * FROM (SELECT f.instrument_id, max(CASE WHEN line_item_code = 'TOTAL_REVENUE' THEN CAST(value AS DOUBLE) END) AS rev, max(CASE WHEN line_item_code = 'DEPRECIATION' THEN CAST(value AS DOUBLE) END) AS da,
  max(CASE WHEN line_item_code = 'CAPEX' THEN CAST(value AS DOUBLE) END) AS capex, max(CASE WHEN line_item_code = 'TOTAL_DEBT' THEN CAST(value AS DOUBLE) END) - max(CASE WHEN line_item_code = 'CASH' THEN CAST(value AS DOUBLE) END) AS nd,
  max(CASE WHEN line_item_code = 'SHARES_OUTSTANDING' THEN CAST(value AS DOUBLE) END) AS sh
 FROM facts f JOIN (SELECT instrument_id, max(as_reported_ts) AS mx FROM facts WHERE as_reported_ts < TIMESTAMP '2001-01-01' GROUP BY 1) g ON g.instrument_id = f.instrument_id AND g.mx = f.as_reported_ts GROUP BY 1)
WHERE rev IS NOT NULL AND da IS NOT NULL AND capex IS NOT NULL AND nd IS NOT NULL AND sh > 0""")
part("dcf_rows", """
SELECT q.*, b.rev, b.da, b.capex, b.nd, b.sh, CASE WHEN wacc <= terminal_growth THEN 'WACC must be greater than terminal growth for Gordon Growth Model'
  WHEN short_capex AND forecast_years <> 2 THEN 'Capex schedule length must match forecast_years' END AS err FROM val_requests q LEFT JOIN dcf_base b USING (instrument_id)""")
part("dcf_years", """
SELECT instrument_id, t, rev * pow(1 + revenue_cagr, t) AS r, rev * pow(1 + revenue_cagr, t) * ebit_margin * (1 - 0.25::DOUBLE) + da - capex AS fcf, pow(1 + wacc, t) AS df
FROM (SELECT *, unnest(range(1, forecast_years + 1)) AS t FROM dcf_rows WHERE err IS NULL AND rev IS NOT NULL)""")
part("dcf_val", """
SELECT r.instrument_id, pv + tv / pow(1 + wacc, forecast_years) AS ev, tv, tv / pow(1 + wacc, forecast_years) AS tpv, pv + tv / pow(1 + wacc, forecast_years) - nd AS eq, (pv + tv / pow(1 + wacc, forecast_years) - nd) / sh AS price FROM (
 SELECT q.*, y.pv, y.lastf * (1 + terminal_growth) / (wacc - terminal_growth) AS tv FROM dcf_rows q JOIN (SELECT instrument_id, sum(fcf / df) AS pv, max_by(fcf, t) AS lastf FROM dcf_years GROUP BY 1) y USING (instrument_id)) r""")
part("valued", """
SELECT *, CASE WHEN failure IS NOT NULL THEN 'FAILED' WHEN composite < 40 THEN 'OVERRIDDEN' ELSE 'SUCCESS' END AS status FROM (
 SELECT *, round_even((85.0::DOUBLE + least(peers * 20.0::DOUBLE, 100) + 75.0::DOUBLE + agreement) / 4, 2) AS composite FROM (
 SELECT q.val_run_id, q.instrument_id, v.price AS dcf_price, v.eq AS dcf_eq, v.ev AS dcf_ev, v.tpv, r.rel_status, r.rel_price, r.rel_equity, r.rel_enterprise, coalesce(r.peers, 0) AS peers,
  CASE WHEN s.instrument_id IS NULL THEN 'Missing required metric: ENTERPRISE_VALUE' WHEN s.missing IS NOT NULL THEN 'Missing required metric: ' || s.missing WHEN q.rev IS NULL THEN 'Missing fundamentals'
   WHEN q.err IS NOT NULL THEN q.err WHEN r.rel_status = 'FAILED' THEN 'Missing required metric' END AS failure,
  CASE WHEN r.rel_price IS NULL OR v.price IS NULL THEN 0 WHEN abs(v.price) + abs(r.rel_price) = 0 THEN 100
   ELSE round_even(100 - least(100, abs(v.price - r.rel_price) / ((abs(v.price) + abs(r.rel_price)) / 2) * 100), 2) END AS agreement,
  CASE WHEN r.rel_price IS NULL THEN v.price ELSE (v.price + r.rel_price) / 2 END AS blend_price, CASE WHEN r.rel_price IS NULL THEN v.eq ELSE (v.eq + r.rel_equity) / 2 END AS blend_eq,
  CASE WHEN r.rel_price IS NULL THEN v.ev ELSE (v.ev + r.rel_enterprise) / 2 END AS blend_ev
 FROM dcf_rows q LEFT JOIN dcf_val v USING (instrument_id) LEFT JOIN rel_value r USING (instrument_id) LEFT JOIN metric_state s ON s.instrument_id = q.instrument_id))""")
part("quick", """
SELECT *, pv + lastf * (1 + terminal_growth) / greatest(wacc - terminal_growth, 0.01::DOUBLE) / pow(1 + wacc, forecast_years) AS ev FROM (
 SELECT instrument_id, any_value(wacc) AS wacc, any_value(terminal_growth) AS terminal_growth, any_value(forecast_years) AS forecast_years, any_value(debt) AS debt, any_value(sh) AS sh, any_value(k) AS k, sum(f / pow(1 + wacc, t)) AS pv, max_by(f, t) AS lastf FROM (
  SELECT *, r * pow(1 + revenue_cagr, t) * ebit_margin * (1 - tax) + r * pow(1 + revenue_cagr, t) * dm - r * pow(1 + revenue_cagr, t) * cm - r * pow(1 + revenue_cagr, t) * 0.01::DOUBLE AS f FROM (
   SELECT *, unnest([1, 2, 3, 4, 5]) AS t, CASE WHEN coalesce(depreciation_amortization, 0) <> 0 THEN depreciation_amortization / r ELSE 0.03::DOUBLE END AS dm,
     CASE WHEN capital_expenditure <> 0 THEN abs(capital_expenditure) / r ELSE 0.04::DOUBLE END AS cm FROM shocked)) GROUP BY instrument_id, k)""")
part("quick_in", """
SELECT *, CASE WHEN coalesce(total_revenue, 0) <> 0 THEN total_revenue WHEN price_to_sales <> 0 THEN market_cap / price_to_sales WHEN trailing_pe <> 0 THEN market_cap / trailing_pe / coalesce(profit_margins, 0.12::DOUBLE)
   ELSE greatest(market_cap * 0.6::DOUBLE, 1) END AS r, coalesce(effective_tax_rate, 0.25::DOUBLE) AS tax, total_debt - total_cash AS debt, CASE WHEN shares_outstanding = 0 THEN 1 ELSE shares_outstanding END AS sh FROM info""")
part("shocked", """
SELECT q.* EXCLUDE (wacc, terminal_growth), a * 3 + b AS k, greatest(wacc + (a - 1) * 0.01::DOUBLE, 0.01::DOUBLE) AS wacc, greatest(terminal_growth + (b - 1) * 0.01::DOUBLE, 0) AS terminal_growth
FROM quick_in q, (SELECT unnest([0, 1, 2]) AS a) x, (SELECT unnest([0, 1, 2]) AS b) y""")
