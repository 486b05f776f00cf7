"""Queries on symbol resolution and the alias registry."""

import datetime as dt

from pyspark.sql import functions as F

from tickerlake.operators import aliases, identity, serving
from tickerlake.plans import bindings as b
from tickerlake.plans import sqlparts
from tickerlake.plans.registry import register

LIFE = "{d} >= coalesce(i.listing_date, DATE '0001-01-01') AND {d} <= coalesce(i.delisting_date, DATE '9999-12-31')"
ON_DAY = LIFE.format(d="as_of")
IN_ALIAS = "as_of >= a.valid_from AND as_of <= coalesce(a.valid_to, DATE '9999-12-31')"

sqlparts.part("asked", "SELECT DISTINCT upper(trim(identifier)) AS id, coalesce(exchange_mic, '') AS mic, as_of FROM requests")
sqlparts.part("sym_asked", "SELECT DISTINCT symbol AS sym, exchange_code AS ex, as_of FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN old_name ELSE symbol END AS symbol, exchange_code, as_of FROM requests)")
sqlparts.part("by_symbol", f"""
SELECT sym, ex, as_of, count(*) AS ni, min(i.instrument_id) AS ii FROM sym_asked q JOIN exchanges x ON x.exchange_code = q.ex
JOIN instruments i ON i.exchange_id = x.exchange_id AND upper(i.symbol) = sym AND {ON_DAY} GROUP BY 1, 2, 3""")
sqlparts.part("by_alias", f"""
SELECT sym, ex, as_of, count(*) AS na, min(i.instrument_id) AS ai FROM sym_asked q JOIN exchanges x ON x.exchange_code = q.ex
JOIN aliases a ON upper(a.alias_symbol) = sym AND {IN_ALIAS} JOIN instruments i ON i.instrument_id = a.instrument_id AND i.exchange_id = x.exchange_id AND {ON_DAY} GROUP BY 1, 2, 3""")
sqlparts.part("isin_hit", f"""
SELECT id, as_of, min(i.instrument_id) AS i1 FROM (SELECT DISTINCT id, as_of FROM asked) q JOIN companies c ON upper(c.isin_primary) = id
JOIN instruments i ON i.company_id = c.company_id AND {ON_DAY} WHERE regexp_full_match(id, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') GROUP BY 1, 2""")
sqlparts.part("ticker_asked", """
SELECT id, mic, as_of, CASE WHEN contains(id, '.') THEN regexp_replace(id, '\\.[^.]*$', '') ELSE id END AS sym,
  CASE WHEN mic <> '' THEN mic WHEN contains(id, '.') THEN
    CASE regexp_extract(id, '([^.]*)$', 1) WHEN 'NS' THEN 'NSE' WHEN 'BO' THEN 'BSE' WHEN 'SME' THEN 'BSE_SME' ELSE regexp_extract(id, '([^.]*)$', 1) END END AS ex FROM asked""")
sqlparts.part("ticker_hit", f"""
SELECT id, mic, as_of, sym, ex, min(i.instrument_id) AS i2 FROM ticker_asked q JOIN instruments i ON upper(i.symbol) = sym AND {ON_DAY}
JOIN exchanges x ON x.exchange_id = i.exchange_id WHERE q.ex IS NULL OR x.exchange_code = q.ex GROUP BY ALL HAVING count(*) = 1""")
sqlparts.part("near", """
SELECT id, alias_symbol, levenshtein(id, upper(trim(alias_symbol))) AS d FROM (SELECT DISTINCT id FROM asked), (SELECT DISTINCT alias_symbol FROM aliases)
WHERE levenshtein(id, upper(trim(alias_symbol))) <= 2""")
sqlparts.part("fuzzy_all", f"""
SELECT q.id, q.as_of, n.d, a.alias_id, a.alias_symbol, a.instrument_id, a.source_system FROM (SELECT DISTINCT id, as_of FROM asked) q JOIN near n ON n.id = q.id
JOIN aliases a ON a.alias_symbol = n.alias_symbol AND {IN_ALIAS} JOIN instruments i ON i.instrument_id = a.instrument_id AND {ON_DAY}""")
sqlparts.part("fuzzy_hit", """
SELECT id, as_of, d, count(*) AS nb, min(alias_symbol) AS nm, min(instrument_id) AS i3, min(source_system) AS src FROM fuzzy_all f
WHERE d = (SELECT min(d) FROM fuzzy_all g WHERE g.id = f.id AND g.as_of = f.as_of) GROUP BY 1, 2, 3""")


def _refs(spark, sf):
    return b.companies(spark, sf), b.instruments(spark, sf), b.exchanges(spark, sf), b.aliases(spark, sf)


def _sym_rows(spark, sf):
    return b.identifier_requests(spark, sf).select(
        F.expr("case when l_orderkey % 3 = 0 then concat(' ', lower(old_name)) else symbol end").alias("symbol"),
        F.expr("case exchange_code when 'NSE' then 'ns' else exchange_code end").alias("exchange"), "as_of", F.upper(F.trim(F.expr("case when l_orderkey % 3 = 0 then old_name else symbol end"))).alias("sym"), "exchange_code")


@register("resolve_symbol_as_of", """
SELECT sym, ex, CAST(as_of AS VARCHAR) AS as_of, CASE WHEN ni > 1 THEN NULL WHEN ni = 1 THEN ii WHEN na = 1 THEN ai END AS instrument_id,
  CASE WHEN ni = 1 THEN 'RESOLVED' WHEN ni > 1 THEN 'AMBIGUOUS' WHEN na = 1 THEN 'RESOLVED_ALIAS' ELSE 'UNRESOLVED' END AS state, CAST(cnt AS BIGINT) AS n
FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN old_name ELSE symbol END AS sym, exchange_code AS ex, as_of, count(*) AS cnt FROM requests GROUP BY 1, 2, 3)
LEFT JOIN by_symbol USING (sym, ex, as_of) LEFT JOIN by_alias USING (sym, ex, as_of)""")
def resolve_symbol(spark, sf):
    _, i, x, a = _refs(spark, sf)
    r = identity.resolve_symbol_as_of(_sym_rows(spark, sf), i, x, a)
    return r.groupBy("sym", F.col("exchange_code").alias("ex"), "as_of", "instrument_id", "state").agg(F.count(F.lit(1)).alias("n"))


@register("resolve_alias_as_of", """
SELECT sym, ex, CAST(as_of AS VARCHAR) AS as_of, CASE WHEN na = 1 THEN ai END AS instrument_id, CASE WHEN na = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS state
FROM sym_asked LEFT JOIN by_alias USING (sym, ex, as_of)""")
def resolve_alias(spark, sf):
    _, i, x, a = _refs(spark, sf)
    return identity.resolve_alias_as_of(_sym_rows(spark, sf), i, x, a).select("sym", F.col("exchange_code").alias("ex"), "as_of", "instrument_id", "state").distinct()


@register("resolve_isin", """
SELECT DISTINCT identifier, CAST(as_of AS VARCHAR) AS as_of, i1 AS instrument_id, CASE WHEN i1 IS NOT NULL THEN 'ISIN_EXACT' END AS rule_used,
  CAST(CASE WHEN i1 IS NOT NULL THEN 100 END AS BIGINT) AS confidence_score, company_uuid
FROM requests r LEFT JOIN isin_hit h ON h.id = upper(trim(identifier)) AND h.as_of = r.as_of
LEFT JOIN instruments i ON i.instrument_id = i1 LEFT JOIN companies USING (company_id)
""".replace("CAST(as_of", "CAST(r.as_of"))
def resolve_isin(spark, sf):
    c, i, _, _ = _refs(spark, sf)
    return identity.resolve_isin(b.identifier_requests(spark, sf), c, i).select(
        "identifier", "as_of", "instrument_id", "rule_used", "confidence_score", "company_uuid").distinct()


@register("resolve_ticker_exact", """
SELECT q.id, q.mic, CAST(q.as_of AS VARCHAR) AS as_of, i2 AS instrument_id, CAST(CASE WHEN i2 IS NOT NULL THEN CASE WHEN h.ex IS NULL THEN 90 ELSE 95 END END AS BIGINT) AS confidence_score,
  CASE WHEN i2 IS NOT NULL THEN CASE WHEN h.ex IS NULL THEN h.sym ELSE h.sym || '.' || h.ex END END AS matched_input
FROM asked q LEFT JOIN ticker_hit h ON h.id = q.id AND h.mic = q.mic AND h.as_of = q.as_of""")
def resolve_ticker(spark, sf):
    c, i, x, _ = _refs(spark, sf)
    return identity.resolve_ticker_exact(b.identifier_requests(spark, sf), c, i, x).select(
        F.upper(F.trim("identifier")).alias("id"), F.coalesce("exchange_mic", F.lit("")).alias("mic"), "as_of", "instrument_id", "confidence_score", "matched_input").distinct()


@register("resolve_fuzzy_alias", """
SELECT q.id, CAST(q.as_of AS VARCHAR) AS as_of, CASE WHEN nb = 1 THEN i3 END AS instrument_id, CASE WHEN nb = 1 THEN nm END AS matched_input,
  CAST(CASE WHEN nb = 1 THEN CASE WHEN d = 0 THEN 90 ELSE greatest(70, 90 - 10 * d) END END AS BIGINT) AS confidence_score,
  CASE WHEN nb = 1 THEN 'MATCHED' WHEN nb > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS state
FROM (SELECT DISTINCT id, as_of FROM asked) q LEFT JOIN fuzzy_hit f ON f.id = q.id AND f.as_of = q.as_of""")
def resolve_fuzzy(spark, sf):
    c, i, _, a = _refs(spark, sf)
    return identity.resolve_fuzzy_alias(b.identifier_requests(spark, sf), a, i, c).select(
        F.upper(F.trim("identifier")).alias("id"), "as_of", "instrument_id", "matched_input", "confidence_score", "state").distinct()


@register("resolve_cascade", """
SELECT q.id, q.mic, CAST(q.as_of AS VARCHAR) AS as_of, CASE WHEN i1 IS NOT NULL THEN i1 WHEN i2 IS NOT NULL THEN i2 WHEN nb = 1 THEN i3 END AS instrument_id,
  CASE WHEN i1 IS NOT NULL THEN 'ISIN_EXACT' WHEN i2 IS NOT NULL THEN 'TICKER_EXACT' WHEN nb = 1 THEN 'ALIAS_FUZZY' END AS rule_used,
  CAST(CASE WHEN i1 IS NOT NULL THEN 100 WHEN i2 IS NOT NULL THEN CASE WHEN t.ex IS NULL THEN 90 ELSE 95 END WHEN nb = 1 THEN CASE WHEN d = 0 THEN 90 ELSE greatest(70, 90 - 10 * d) END END AS BIGINT) AS confidence_score,
  CASE WHEN i1 IS NOT NULL THEN 'ref_company.isin_primary' WHEN i2 IS NOT NULL THEN CASE WHEN t.ex IS NULL THEN 'ref_instrument.symbol' ELSE 'ref_instrument.symbol+ref_exchange.exchange_code=' || t.ex END
    WHEN nb = 1 THEN 'ref_symbol_alias.source_system=' || src END AS source_provenance,
  CASE WHEN i1 IS NOT NULL OR i2 IS NOT NULL OR nb = 1 THEN 'MATCHED' WHEN nb > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS state
FROM asked q LEFT JOIN isin_hit h ON h.id = q.id AND h.as_of = q.as_of LEFT JOIN ticker_hit t ON t.id = q.id AND t.mic = q.mic AND t.as_of = q.as_of
LEFT JOIN fuzzy_hit f ON f.id = q.id AND f.as_of = q.as_of""")
def cascade(spark, sf):
    r = identity.resolve_cascade(b.identifier_requests(spark, sf), *_refs(spark, sf))
    return r.select(F.upper(F.trim("identifier")).alias("id"), F.coalesce("exchange_mic", F.lit("")).alias("mic"), "as_of",
                    "instrument_id", "rule_used", "confidence_score", "source_provenance", "state").distinct()


@register("best_match_rank", """
SELECT id, CAST(as_of AS VARCHAR) AS as_of, CAST(d AS BIGINT) AS distance, CAST(nb AS BIGINT) AS n_best FROM fuzzy_hit""")
def best_match(spark, sf):
    _, i, _, a = _refs(spark, sf)
    pts = b.identifier_requests(spark, sf).select(F.upper(F.trim("identifier")).alias("_id"), "as_of")
    return identity.best_match_rank(pts, a, i).select(F.col("_id").alias("id"), "as_of", "distance", "n_best")


def _incoming_aliases(spark, sf):
    """Every supplier claims a window of its neighbour's new name."""
    return b.table(spark, sf, "supplier").selectExpr(
        "s_suppkey * 2 + 1 as alias_id", "case when s_suppkey % 4 = 0 then s_suppkey else s_suppkey + 1 end as instrument_id", "'BSE' as source_system",
        "case when s_suppkey % 10 = 0 then concat('PAIR', s_suppkey div 20) else concat('N', upper(substr(md5(concat('B', s_suppkey)), 1, 8))) end as alias_symbol",
        "date_add(date'1998-01-01', cast(s_suppkey % 5 * 400 as int)) as valid_from",
        "case when s_suppkey % 3 <> 0 then date_add(date'1998-04-01', cast(s_suppkey % 5 * 400 as int)) end as valid_to")


sqlparts.part("incoming_aliases", """
SELECT s_suppkey * 2 + 1 AS alias_id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey ELSE s_suppkey + 1 END AS instrument_id, 'BSE' AS source_system,
  CASE WHEN s_suppkey % 10 = 0 THEN 'PAIR' || (s_suppkey // 20) ELSE 'N' || upper(substr(md5('B' || s_suppkey), 1, 8)) END AS alias_symbol,
  DATE '1998-01-01' + CAST(s_suppkey % 5 * 400 AS INTEGER) AS valid_from,
  CASE WHEN s_suppkey % 3 <> 0 THEN DATE '1998-04-01' + CAST(s_suppkey % 5 * 400 AS INTEGER) END AS valid_to FROM supplier""")


@register("alias_conflicts", """
SELECT n.alias_id, n.instrument_id, (SELECT count(*) FROM aliases a WHERE a.source_system = n.source_system AND a.alias_symbol = n.alias_symbol
  AND a.instrument_id <> n.instrument_id AND a.alias_id <> n.alias_id AND a.valid_from <= coalesce(n.valid_to, DATE '9999-12-31') AND n.valid_from <= coalesce(a.valid_to, DATE '9999-12-31')) AS conflicts
FROM incoming_aliases n""")
def alias_conflicts(spark, sf):
    return identity.alias_conflicts(b.aliases(spark, sf), _incoming_aliases(spark, sf)).select("alias_id", "instrument_id", "conflicts")


# a change of every supplier's alias, and for every third a chain: the stored window is closed, its rest goes to another
# instrument, a third one is refused there, the second is closed and the third one accepted behind it, then moved
# (n, op, added to the alias id, to the instrument id, days from the stored begin to the window's begin and end)
_CHAIN = [
    (1, "CLOSE", 0, 0, 0, 30), (2, "CREATE", 3000000, 1, 31, None), (3, "CREATE", 4000000, 2, 40, None), (4, "CLOSE", 3000000, 0, 0, 60),
    (5, "CREATE", 5000000, 2, 61, 90), (6, "UPDATE", 5000000, 2, 45, 90), (7, "UPDATE", 5000000, 1, 45, 90), (8, "CREATE", 6000000, 2, 91, None),
]
_CHAIN_SQL = ", ".join(f"({n}, '{op}', {plus}, {other}, {begins}, {'NULL' if ends is None else ends})" for n, op, plus, other, begins, ends in _CHAIN)
MUTATIONS = f"""
SELECT alias_id * 10 AS seq, CASE alias_id // 2 % 3 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'UPDATE' ELSE 'CLOSE' END AS op,
  CASE WHEN alias_id // 2 % 3 = 0 THEN alias_id + 1000000 WHEN alias_id // 2 % 19 = 1 THEN alias_id + 2000000 ELSE alias_id END AS alias_id,
  CASE WHEN alias_id // 2 % 23 = 4 THEN instrument_id + 1000000000 ELSE instrument_id END AS instrument_id,
  CASE WHEN alias_id // 2 % 17 = 3 THEN 'FEED' ELSE source_system END AS source_system, alias_symbol, valid_from, valid_to FROM incoming_aliases
UNION ALL SELECT alias_id * 10 + n, op, alias_id + plus, CASE WHEN op <> 'CLOSE' THEN 1 + (instrument_id + other) % (SELECT count(*) FROM supplier) END, source_system, alias_symbol,
  CASE WHEN op <> 'CLOSE' THEN valid_from + begins::INT END, valid_from + ends::INT FROM aliases, (VALUES {_CHAIN_SQL}) c(n, op, plus, other, begins, ends) WHERE alias_id % 3 = 0"""
sqlparts.part("mutations", MUTATIONS)
# one mutation after the other; ``state`` holds all aliases as they are behind it
_WALK = """
WITH RECURSIVE ordered AS (SELECT m.*, row_number() OVER (ORDER BY seq) AS k, i.instrument_id IS NOT NULL AS known FROM mutations m LEFT JOIN instruments i ON i.instrument_id = m.instrument_id),
walk AS (SELECT 0::BIGINT AS k, (SELECT list({'a': alias_id, 'i': instrument_id, 's': source_system, 'n': alias_symbol, 'f': valid_from, 't': valid_to}) FROM aliases) AS state, 0::BIGINT AS seq, '' AS op, '-' AS error
UNION ALL SELECT k, CASE WHEN error IS NOT NULL THEN state WHEN op = 'CLOSE' THEN list_append(others, {'a': own.a, 'i': own.i, 's': own.s, 'n': own.n, 'f': own.f, 't': valid_to})
   ELSE list_append(others, {'a': alias_id, 'i': instrument_id, 's': source_system, 'n': alias_symbol, 'f': valid_from, 't': valid_to}) END, seq, op, error
 FROM (SELECT *, CASE WHEN op <> 'CREATE' AND own IS NULL THEN 'ALIAS_NOT_FOUND' WHEN op = 'CREATE' AND own IS NOT NULL THEN 'ALIAS_EXISTS' WHEN op <> 'CLOSE' AND source_system = 'FEED' THEN 'UNSUPPORTED_SOURCE'
   WHEN valid_to < CASE WHEN op = 'CLOSE' THEN own.f ELSE valid_from END THEN 'REVERSED_WINDOW' WHEN op <> 'CLOSE' AND NOT known THEN 'INSTRUMENT_NOT_FOUND'
   WHEN op <> 'CLOSE' AND len(list_filter(others, lambda o: o.s = source_system AND o.n = alias_symbol AND o.i <> instrument_id AND o.f <= coalesce(valid_to, DATE '9999-12-31') AND valid_from <= coalesce(o.t, DATE '9999-12-31'))) > 0 THEN 'ALIAS_CONFLICT' END AS error
  FROM (SELECT o.*, w.state, list_filter(w.state, lambda x: x.a = o.alias_id)[1] AS own, list_filter(w.state, lambda x: x.a <> o.alias_id) AS others FROM walk w JOIN ordered o ON o.k = w.k + 1)))
"""


def _mutations(spark, sf):
    base = _incoming_aliases(spark, sf).selectExpr(
        "alias_id * 10 as seq", "case alias_id div 2 % 3 when 0 then 'CREATE' when 1 then 'UPDATE' else 'CLOSE' end as op",
        "case when alias_id div 2 % 3 = 0 then alias_id + 1000000 when alias_id div 2 % 19 = 1 then alias_id + 2000000 else alias_id end as alias_id",
        "case when alias_id div 2 % 23 = 4 then instrument_id + 1000000000 else instrument_id end as instrument_id",
        "case when alias_id div 2 % 17 = 3 then 'feed' else concat(' ', lower(source_system)) end as source_system", "alias_symbol", "valid_from", "valid_to")
    n = b.table(spark, sf, "supplier").count()
    chained = spark.createDataFrame(_CHAIN, "n long, op string, plus long, other long, begins int, ends int")
    chain = b.aliases(spark, sf).where("alias_id % 3 = 0").join(chained).selectExpr(  # the steps are a list of fixed length
        "alias_id * 10 + n as seq", "op", "alias_id + plus as alias_id", f"case when op <> 'CLOSE' then 1 + (instrument_id + other) % {n} end as instrument_id", "source_system", "alias_symbol",
        "case when op <> 'CLOSE' then date_add(valid_from, begins) end as valid_from", "date_add(valid_from, ends) as valid_to")
    return base.unionByName(chain)


@register("merge_aliases", _WALK + """
SELECT r.a AS alias_id, r.i AS instrument_id, r.s AS source_system, r.n AS alias_symbol, CAST(r.f AS VARCHAR) AS valid_from, CAST(r.t AS VARCHAR) AS valid_to
FROM (SELECT unnest(state) AS r FROM walk WHERE k = (SELECT max(k) FROM walk))""")
def merge_aliases(spark, sf):
    return aliases.merge_aliases(b.aliases(spark, sf), _mutations(spark, sf), b.instruments(spark, sf))[0]


@register("merge_aliases_errors", _WALK + "SELECT seq, op, error FROM walk WHERE k > 0 AND error IS NOT NULL")
def merge_aliases_errors(spark, sf):
    return aliases.merge_aliases(b.aliases(spark, sf), _mutations(spark, sf), b.instruments(spark, sf))[1]


@register("active_aliases", "SELECT alias_id, alias_symbol FROM aliases WHERE valid_to IS NULL OR valid_to >= DATE '2001-01-31'")
def active_aliases(spark, sf):
    return identity.active_aliases(b.aliases(spark, sf), dt.date(2001, 1, 31)).select("alias_id", "alias_symbol")


@register("bse_isin_map", """
SELECT alias_symbol, isin_primary FROM aliases JOIN instruments USING (instrument_id) JOIN companies USING (company_id) WHERE source_system = 'BSE' AND isin_primary IS NOT NULL""")
def bse_isin_map(spark, sf):
    c, i, _, a = _refs(spark, sf)
    return identity.bse_isin_map(a, i, c)


_LISTED = "FROM instruments JOIN companies USING (company_id) JOIN exchanges USING (exchange_id) WHERE exchange_code = 'NSE' AND sector_code = 'ASIA' AND is_active"


def _listed(spark, sf):
    c, i, x, _ = _refs(spark, sf)
    return serving.list_instruments(i, c, x, exchange="nse", sector="ASIA", is_active=True, page=1, size=5)


@register("list_instruments", f"SELECT instrument_id, symbol, exchange_code, sector_code, isin_primary {_LISTED} ORDER BY instrument_id LIMIT 5")
def list_instruments(spark, sf):
    return _listed(spark, sf)[0].select("instrument_id", "symbol", "exchange_code", "sector_code", "isin_primary")


@register("list_instruments_total", f"SELECT count(*) AS total {_LISTED}")
def list_instruments_total(spark, sf):
    return _listed(spark, sf)[1]


@register("search_instruments", """
SELECT instrument_id, symbol FROM instruments JOIN companies USING (company_id) WHERE contains(lower(symbol), 'dup') OR contains(lower(legal_name), 'dup') OR contains(lower(coalesce(isin_primary, '')), 'dup')""")
def search(spark, sf):
    c, i, _, _ = _refs(spark, sf)
    return serving.search_instruments(i, c, "Dup").select("instrument_id", "symbol")


@register("instrument_detail", """
SELECT instrument_id, symbol, exchange_code, legal_name, a.alias_symbol, a.source_system AS alias_source, CAST(a.valid_from AS VARCHAR) AS alias_from
FROM instruments JOIN companies USING (company_id) JOIN exchanges USING (exchange_id)
LEFT JOIN (SELECT * FROM aliases WHERE valid_to IS NULL OR valid_to >= DATE '2001-01-31') a USING (instrument_id)""")
def instrument_detail(spark, sf):
    c, i, x, a = _refs(spark, sf)
    return serving.instrument_detail(i, c, x, a, dt.date(2001, 1, 31)).select(
        "instrument_id", "symbol", "exchange_code", "legal_name", "alias_symbol", "alias_source", "alias_from")


@register("reference_counts", """
SELECT 'ref_exchange' AS table_name, count(*) AS n FROM exchanges UNION ALL SELECT 'ref_company', count(*) FROM companies
UNION ALL SELECT 'ref_instrument', count(*) FROM instruments UNION ALL SELECT 'ref_symbol_alias', count(*) FROM aliases""")
def reference_counts(spark, sf):
    c, i, x, a = _refs(spark, sf)
    return serving.reference_counts({"ref_exchange": x, "ref_company": c, "ref_instrument": i, "ref_symbol_alias": a})


@register("coverage_map", """
SELECT symbol, isin_primary AS isin, exchange_code AS exchange, CAST(last_price_date AS VARCHAR) AS last_price_date, CAST(last_val_date AS VARCHAR) AS last_val_date,
  last_val_date IS NOT NULL AS valued, CASE WHEN last_val_date IS NOT NULL THEN 'Valued' ELSE 'Not yet valued' END AS valuation_status
FROM instruments i JOIN companies USING (company_id) JOIN exchanges USING (exchange_id)
LEFT JOIN (SELECT b.instrument_id, max(trade_date) AS last_price_date FROM bars b JOIN instruments i USING (instrument_id)
  WHERE trade_date BETWEEN DATE '2001-10-01' - 3650 AND DATE '2001-10-01' AND trade_date BETWEEN coalesce(listing_date, DATE '0001-01-01') AND coalesce(delisting_date, DATE '9999-12-31') GROUP BY 1) USING (instrument_id)
LEFT JOIN (SELECT o_custkey AS instrument_id, max(CAST(o_orderdate AS TIMESTAMP)) AS last_val_date FROM orders GROUP BY 1) USING (instrument_id)""")
def coverage(spark, sf):
    c, i, x, _ = _refs(spark, sf)
    # every order is a valuation run of its customer's number; numbers without an order are the ones not valued yet
    runs = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("instrument_id"), F.col("o_orderdate").cast("timestamp").alias("as_of_ts"))
    return serving.coverage_map(i, c, x, b.bars(spark, sf), runs, dt.date(2001, 10, 1))
