"""Queries on files: scans, contracts, raw zone, sinks, scalar columns, streams.

File queries first let Spark write the given tables out as the files to be read.
"""

import datetime as dt
import io
import zipfile
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake import schemas
from tickerlake.functions import dates, numeric, text
from tickerlake.operators import ops, prices, quality, validate
from tickerlake.plans import bindings as b
from tickerlake.plans import sqlparts
from tickerlake.plans.registry import register
from tickerlake.session import work_dir
from tickerlake.sources import bhavcopy, bucketed, rawzone, sinks
from tickerlake.streaming import connector, ingest

# --- exchange files -------------------------------------------------------------------------

FILE_ROW = {
    "k": "l_orderkey * 8 + l_linenumber",
    "SC_CODE": "case when l_orderkey % 61 = 0 then '' else concat('c', instrument_id) end",
    "NAME": "case when l_orderkey % 59 = 0 then '  ' else concat(' s', instrument_id) end",
    "OPEN": "case when l_orderkey % 53 = 0 then 'abc' when l_orderkey % 47 = 0 then '-1' else cast(px as string) end",
    "HIGH": "case when l_orderkey % 43 = 0 then '0' else cast(px + 1 as string) end",
    "LOW": "case when l_orderkey % 41 = 0 then cast(px + 0.5BD as string) else cast(px as string) end",
    "CLOSE": "cast(px as string)",
    "VOLUME": "case when l_orderkey % 37 = 0 then 'x1' else cast(qty as string) end",
    "DELIV_QTY": "case when l_orderkey % 31 = 0 then ' ' when l_orderkey % 29 = 0 then '-3' else cast(qty - 1 as string) end",
    "DAY": "case l_orderkey % 5 when 0 then date_format(trade_date, 'yyyy-MM-dd') when 1 then date_format(trade_date, 'dd-MM-yyyy') when 2 then upper(date_format(trade_date, 'dd-MMM-yyyy')) when 3 then date_format(trade_date, 'dd/MM/yyyy') else case when l_orderkey % 15 = 4 then date_format(trade_date, 'yyyy/MM/dd') else '1999-01-01' end end",
    "WANTED": "cast(trade_date as string)",
}


def _file_rows(spark, sf, exchange):
    series = "element_at(array('EQ','BE','BZ','sm','ST','XX'), cast(l_orderkey % 6 as int) + 1)" if exchange == "NSE" else "element_at(array('A','B','T','mt','SM','Z'), cast(l_orderkey % 6 as int) + 1)"
    t = b.ticks(spark, sf).withColumn("px", b.scaled("px_u", 6))
    return t.selectExpr(*[f"{e} as {n}" for n, e in FILE_ROW.items()], f"{series} as SERIES")


NSE_NAMES = {"NAME": "SYMBOL", "VOLUME": "TOTTRDQTY", "DAY": "TIMESTAMP"}
BSE_NAMES = {"NAME": "SC_NAME", "VOLUME": "NO_OF_SHRS", "DAY": "DT_TM", "SERIES": "SC_GROUP"}


def _checks(exchange: str) -> str:
    sym, ser, vol, day = ("SYMBOL", "SERIES", "TOTTRDQTY", "TIMESTAMP") if exchange == "NSE" else ("SC_NAME", "SC_GROUP", "NO_OF_SHRS", "DT_TM")
    bad = "XX" if exchange == "NSE" else "Z"
    lead = "" if exchange == "NSE" else "WHEN l_orderkey % 61 = 0 THEN 'SC_CODE is required' WHEN instrument_id % 10 = 9 THEN 'Missing ISIN mapping for BSE scrip code C' || instrument_id"
    return f"""CASE {lead} WHEN l_orderkey % 53 = 0 THEN 'OPEN must be numeric' WHEN l_orderkey % 47 = 0 THEN 'OPEN must be non-negative'
 WHEN l_orderkey % 43 = 0 THEN 'HIGH must be greater than or equal to OPEN, LOW, and CLOSE' WHEN l_orderkey % 41 = 0 THEN 'LOW must be less than or equal to OPEN, HIGH, and CLOSE'
 WHEN l_orderkey % 59 = 0 THEN '{sym} is required' WHEN l_orderkey % 6 = 5 THEN 'Unsupported {exchange} series code: {bad}' WHEN l_orderkey % 37 = 0 THEN '{vol} must be numeric'
 WHEN l_orderkey % 31 <> 0 AND l_orderkey % 29 = 0 THEN 'DELIV_QTY must be non-negative' WHEN l_orderkey % 15 = 4 THEN 'Unsupported trade date format: ' || strftime(trade_date, '%Y/%m/%d')
 WHEN l_orderkey % 5 = 4 AND trade_date <> DATE '1999-01-01' THEN '{day} does not match requested trade date' END"""


sqlparts.part("nse_file", f"SELECT *, {_checks('NSE')} AS error FROM ticks")
sqlparts.part("bse_file", f"SELECT *, {_checks('BSE')} AS error FROM ticks")


def _file_sql(part: str, good: str) -> str:
    return f"""
SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS k, 'S' || instrument_id AS symbol, {good} AS series, CAST(px_u / 1000000.0::DOUBLE AS DOUBLE) AS close, CAST(qty AS DOUBLE) AS volume,
 CAST(CASE WHEN l_orderkey % 31 <> 0 THEN qty - 1 END AS DOUBLE) AS delivery_qty, CAST(trade_date AS VARCHAR) AS timestamp FROM {part} WHERE error IS NULL"""


SCAN = ["k", "symbol", "series", "close", "volume", "delivery_qty", "timestamp"]
NSE_SERIES_SQL = "['EQ','BE','BZ','SM','ST'][l_orderkey % 6 + 1]"
BSE_SERIES_SQL = "['EQ','BE','BT','MT','SM'][l_orderkey % 6 + 1]"


def _nse_files(spark, sf):
    path = work_dir(spark, "nse")
    _file_rows(spark, sf, "NSE").drop("SC_CODE").withColumnsRenamed(NSE_NAMES).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@register("scan_nse_bhavcopy", _file_sql("nse_file", NSE_SERIES_SQL))
def scan_nse(spark, sf):
    return bhavcopy.scan_nse_bhavcopy(spark, _nse_files(spark, sf), "WANTED", "quarantine", ["k"])[0].select(*SCAN)


@register("scan_nse_column_orders", _file_sql("nse_file", NSE_SERIES_SQL))
def scan_nse_orders(spark, sf):
    """A folder whose files have their columns in different orders."""
    path = work_dir(spark, "nse-orders")
    rows = _file_rows(spark, sf, "NSE").drop("SC_CODE").withColumnsRenamed(NSE_NAMES)
    odd = F.col("k") % 2 == 1
    for part, own in ((rows.where(~odd), rows.columns), (rows.where(odd), rows.columns[::-1])):
        part.select(*own).write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return bhavcopy.scan_nse_bhavcopy(spark, path, "WANTED", "quarantine", ["k"])[0].select(*SCAN)


@register("scan_nse_rejects", "SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS k, error FROM nse_file WHERE error IS NOT NULL")
def scan_nse_rejects(spark, sf):
    return bhavcopy.scan_nse_bhavcopy(spark, _nse_files(spark, sf), "WANTED", "quarantine", ["k"])[1].select("k", "error")


def _scrips(spark, sf):
    return b.table(spark, sf, "supplier").where("s_suppkey % 10 <> 9").selectExpr("concat('C', s_suppkey) as alias_symbol", "'IN' as isin_primary")


@register("scan_bse_bhavcopy", _file_sql("bse_file", BSE_SERIES_SQL))
def scan_bse(spark, sf):
    path = work_dir(spark, "bse")
    _file_rows(spark, sf, "BSE").withColumnsRenamed(BSE_NAMES).write.option("header", True).csv(path)
    return bhavcopy.scan_bse_bhavcopy(spark, path, "WANTED", _scrips(spark, sf), "quarantine", keep=["k"])[0].select(*SCAN)


def _zip_files(spark, sf):
    path = work_dir(spark, "zips")
    bhavcopy.write_zipped_csv(_file_rows(spark, sf, "BSE").withColumnsRenamed(BSE_NAMES), path)
    return path


@register("scan_bse_zipped", _file_sql("bse_file", BSE_SERIES_SQL))
def scan_bse_zipped(spark, sf):
    return bhavcopy.scan_bse_bhavcopy(spark, _zip_files(spark, sf), "WANTED", _scrips(spark, sf), "quarantine", zipped=True, keep=["k", "WANTED"])[0].select(*SCAN)


@register("scan_bse_zipped_rejects", "SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS k, error FROM bse_file WHERE error IS NOT NULL")
def scan_bse_zipped_rejects(spark, sf):
    return bhavcopy.scan_bse_bhavcopy(spark, _zip_files(spark, sf), "WANTED", _scrips(spark, sf), "quarantine", zipped=True, keep=["k", "WANTED"])[1].select("k", "error")


@lru_cache(50_000)  # equal bodies give equal archives
def _archive(body: str, kind: int) -> bytes:
    if kind == 0:
        return body.encode()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "x")
        z.writestr("EQ.CSV" if kind == 1 else "eq.csv", body)
    return buf.getvalue()


@register("read_zipped_csv", "SELECT 'p' || (l_orderkey * 8 + l_linenumber) AS path, ' s' || instrument_id AS \"SC_NAME\", CAST(qty AS VARCHAR) AS \"NO_OF_SHRS\" FROM ticks")
def zipped(spark, sf):
    rows = b.ticks(spark, sf).selectExpr("concat('p', l_orderkey * 8 + l_linenumber) as path", "l_orderkey % 3 as kind", "concat('SC_NAME,NO_OF_SHRS\n s', instrument_id, ',', qty, '\n') as body")

    @F.pandas_udf("binary")
    def pack(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for body, kind in parts:
            yield pd.Series([_archive(t, k) for t, k in zip(body, kind)])

    return bhavcopy.unzip_csv(rows.select("path", pack("body", "kind").alias("content")), ["SC_NAME", "NO_OF_SHRS"])


# --- contracts ------------------------------------------------------------------------------------

CONTRACT = schemas.__file__.replace("schemas.py", "contracts/nse_eod.json")


def _contract_rows(spark, sf):
    """Rows as maps, with drifting names, nulls and wrong types."""
    t = b.ticks(spark, sf)
    px = "cast(px_u as string)"
    return t.selectExpr(
        "l_orderkey * 8 + l_linenumber as k", "concat('S', instrument_id) as symbol",
        f"""explode(array(map_concat(map('symbol', concat('S', instrument_id), 'series', 'EQ', 'open', {px}, 'high', {px}, 'low', {px}, 'close', case when l_orderkey % 13 = 0 then null else {px} end,
          'delivery_qty', case when l_orderkey % 3 = 0 then null else '7' end, 'timestamp', case when l_orderkey % 17 = 0 then '1/2/99' else cast(trade_date as string) end),
          case when l_orderkey % 11 = 0 then map('vol', '1') else map('volume', case when l_orderkey % 7 = 0 then 'not-a-number' else cast(qty as string) end) end,
          case when l_orderkey % 19 = 0 then map('zz', '1', 'aa', '2') else map() end))) as row""")


REJECT = """CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 19 = 0 THEN 'schema_drift missing=' || CASE WHEN l_orderkey % 11 = 0 THEN '[''volume'']' ELSE '[]' END || ' extra=' ||
   CASE WHEN l_orderkey % 11 = 0 AND l_orderkey % 19 = 0 THEN '[''aa'', ''vol'', ''zz'']' WHEN l_orderkey % 11 = 0 THEN '[''vol'']' ELSE '[''aa'', ''zz'']' END
 WHEN l_orderkey % 13 = 0 THEN 'null_not_allowed field=close' WHEN l_orderkey % 7 = 0 THEN 'type_mismatch field=volume expected=decimal' WHEN l_orderkey % 17 = 0 THEN 'type_mismatch field=timestamp expected=date' END"""


@register("validate_contract", f"SELECT * FROM (SELECT l_orderkey * 8 + l_linenumber AS k, {REJECT} AS reason FROM ticks)")
def contract(spark, sf):
    good, bad = validate.validate_contract(_contract_rows(spark, sf).drop("symbol"), schemas.contract_schema(CONTRACT))
    return good.select("k", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("k", "reason"))


@register("contract_schema", f"""
SELECT 'row' AS kind, CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS name, concat_ws(' ', 'S' || instrument_id, 'EQ', px_u, px_u, px_u, px_u, CAST(qty AS INTEGER), CASE WHEN l_orderkey % 3 <> 0 THEN 7 END, strftime(trade_date, '%Y-%m-%d')) AS what FROM ticks WHERE ({REJECT}) IS NULL
UNION ALL SELECT 'field', unnest(['symbol', 'series', 'open', 'high', 'low', 'close', 'volume', 'delivery_qty', 'timestamp']),
  unnest(['string false', 'string false', 'decimal(24,6) false', 'decimal(24,6) false', 'decimal(24,6) false', 'decimal(24,6) false', 'decimal(24,6) false', 'decimal(24,6) true', 'date false'])""")
def contract_schema(spark, sf):
    schema = schemas.contract_schema(CONTRACT)
    good, _ = validate.validate_contract(_contract_rows(spark, sf).drop("symbol"), schema)
    shown = [F.col(f.name).cast("long").cast("string") if isinstance(f.dataType, T.DecimalType) else F.col(f.name).cast("string") for f in schema]
    fields = spark.createDataFrame([("field", f.name, f"{good.schema[f.name].dataType.simpleString()} {str(f.nullable).lower()}") for f in schema], "kind string, name string, what string")
    return good.select(F.lit("row").alias("kind"), F.col("k").cast("string").alias("name"), F.concat_ws(" ", *shown).alias("what")).unionByName(fields)


@register("contract_incidents", f"SELECT 'S' || instrument_id AS target_record_key, 'MEDIUM' AS impact_level, ({REJECT}) AS resolution_notes FROM ticks WHERE ({REJECT}) IS NOT NULL")
def contract_incidents(spark, sf):
    _, bad = validate.validate_contract(_contract_rows(spark, sf), schemas.contract_schema(CONTRACT))
    return quality.contract_incidents(bad, "raw_zone:NSE_EOD", dt.datetime(2024, 1, 1))[1].select("target_record_key", "impact_level", "resolution_notes")


@register("field_difference", "SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE 'en' END AS missing, CASE WHEN lang = 'en' THEN 'src' ELSE lang || ',src' END AS extra FROM documents")
def field_difference(spark, sf):
    d = validate.field_difference(F.array(F.lit("en")), F.array(F.lit("src"), F.col("lang")))
    return b.table(spark, sf, "documents").select("doc_id", F.array_join(d.missing, ",").alias("missing"), F.array_join(d.extra, ",").alias("extra"))


# --- raw zone ---------------------------------------------------------------------------------------


def _payloads(spark, sf):
    """Every event is a delivery of its type's file of the day; contents repeat."""
    e = b.table(spark, sf, "events").selectExpr("event_id", "event_type as source_system", "cast(ts as date) as trade_date", "concat('v', cast(value as bigint) div 20) as body")
    return e.select("source_system", "trade_date", F.col("event_id").alias("arrival"), F.sha2("body", 256).alias("checksum"), F.lit(2).cast("long").alias("row_count"),
                    F.concat(F.lit('[{"a":"'), F.col("body"), F.lit('"},{"a":"second"}]')).alias("rows_json"), F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")).alias("written_at"))


def _no_manifest(spark):
    return spark.createDataFrame([], "source_system string, trade_date date, current_checksum string, previous_checksum string, row_count long")


sqlparts.part("payloads", "SELECT event_type AS source_system, CAST(ts AS DATE) AS trade_date, event_id AS arrival, sha256('v' || (CAST(trunc(value) AS BIGINT) // 20)) AS checksum FROM events")
sqlparts.part("chain", "SELECT *, lag(checksum) OVER (PARTITION BY source_system, trade_date ORDER BY arrival) AS prev, row_number() OVER (PARTITION BY source_system, trade_date, checksum ORDER BY arrival) = 1 AS first FROM payloads")
sqlparts.part("kept", "SELECT * FROM chain WHERE prev IS NULL OR prev <> checksum")
sqlparts.part("current_payload", "SELECT source_system, trade_date, max_by(checksum, arrival) AS checksum, max(arrival) AS arrival FROM kept GROUP BY 1, 2")


@register("version_chain", "SELECT arrival, checksum, prev AS previous_checksum FROM chain")
def version_chain(spark, sf):
    return rawzone.version_chain(_payloads(spark, sf).select("source_system", "trade_date", "arrival", "checksum")).select("arrival", "checksum", "previous_checksum")


@register("raw_zone_write", "SELECT arrival, checksum, prev AS previous_checksum, first AS created FROM kept")
def raw_zone_write(spark, sf):
    return rawzone.raw_zone_write(_payloads(spark, sf), _no_manifest(spark))[0].select("arrival", "checksum", "previous_checksum", "created")


@register("raw_zone_manifest", "SELECT source_system, CAST(trade_date AS VARCHAR) AS trade_date, checksum AS current_checksum FROM current_payload")
def raw_zone_manifest(spark, sf):
    return rawzone.raw_zone_write(_payloads(spark, sf), _no_manifest(spark))[1].select("source_system", "trade_date", "current_checksum")


@register("idempotent_anti", "SELECT arrival FROM payloads p WHERE NOT EXISTS (SELECT 1 FROM current_payload c WHERE c.source_system = p.source_system AND c.trade_date = p.trade_date AND c.checksum = p.checksum)")
def idempotent(spark, sf):
    p = _payloads(spark, sf)
    return rawzone.idempotent_anti(p, rawzone.raw_zone_write(p, _no_manifest(spark))[1]).select("arrival")


@register("raw_zone_read_current", """
SELECT source_system, CAST(trade_date AS VARCHAR) AS trade_date, checksum || '.json:' || i AS source_record_id, CASE WHEN i = 1 THEN 'second' END AS second_row FROM current_payload, (SELECT unnest([0, 1]) AS i)""")
def raw_zone_read(spark, sf):
    path = work_dir(spark, "rawzone")
    versions, manifest = rawzone.raw_zone_write(_payloads(spark, sf), _no_manifest(spark))
    rawzone.save_versions(versions, path)
    rawzone.save_manifest(manifest, path, 0)
    r = rawzone.raw_zone_read_current(spark, path)
    return r.select("source_system", "trade_date", "source_record_id", F.when(F.col("row")["a"] == "second", "second").alias("second_row"))


# --- sinks ------------------------------------------------------------------------------------------------


@register("quarantine_write", "SELECT rkey AS record_key, rule_code, CAST(event_id AS VARCHAR) AS event_id FROM verdicts WHERE why IS NOT NULL AND severity = 'HIGH'")
def quarantine_write(spark, sf):
    from tickerlake.plans import on_ops

    path = work_dir(spark, "quarantine")
    sinks.quarantine_write(on_ops._gate(spark, sf)["quarantine"], path)
    return sinks.quarantine_read(spark, path).select("record_key", "rule_code", F.get_json_object("record", "$.event_id").alias("event_id"))


@register("export_metrics_csv", "SELECT metric_code AS metric, round(CAST(metric_value AS DOUBLE), 6) AS value FROM metrics")
def export_csv(spark, sf):
    path = work_dir(spark, "metrics")
    sinks.export_metrics_csv(b.metrics(spark, sf).select(F.col("metric_code").alias("metric"), F.col("metric_value").alias("value")), path)
    return spark.read.option("header", True).csv(path).select("metric", F.round(F.col("value").cast("double"), 6).alias("value"))


@register("normalize_history_frame", """
SELECT instrument_id, CAST(CAST(trade_date AS TIMESTAMP) AS VARCHAR) AS date, CAST(open_px AS DOUBLE) AS open, CAST(CASE WHEN instrument_id % 4 = 0 THEN low_px ELSE close_px END AS DOUBLE) AS close,
 CAST(CASE WHEN instrument_id % 3 <> 0 THEN volume END AS DOUBLE) AS volume FROM bars WHERE instrument_id % 9 <> 5""")
def history_frame(spark, sf):
    raw = b.bars(spark, sf).selectExpr("instrument_id", "case when instrument_id % 9 <> 5 then trade_date end as `Datetime`", "open_px as `Open`", "high_px as ` High`",
                                       "case when instrument_id % 4 <> 0 then close_px end as `Close`", "low_px as `Adj Close`", "case when instrument_id % 3 = 0 then 'n/a' else cast(volume as string) end as `VOLUME`")
    return validate.normalize_history_frame(raw).select("instrument_id", "date", "open", "close", "volume")


# --- scalar columns over whole tables --------------------------------------------------------------------------


def _lines(spark, sf, name: str):
    return _file_rows(spark, sf, "NSE").select("k", F.col(name).alias("v"))


@register("require_columns", "SELECT count(*) AS n FROM orders")
def require_columns(spark, sf):
    o = b.table(spark, sf, "orders")
    validate.require_columns(o, ["o_orderkey", "o_custkey"])
    return o.agg(F.count("o_orderkey").alias("n"))


@register("require_text", "SELECT l_orderkey * 8 + l_linenumber AS k, CASE WHEN l_orderkey % 59 <> 0 THEN 'S' || instrument_id END AS v FROM ticks")
def require_text(spark, sf):
    return _lines(spark, sf, "NAME").select("k", validate.require_text(F.col("v")).alias("v"))


@register("require_non_negative_decimal", "SELECT l_orderkey * 8 + l_linenumber AS k, CASE WHEN l_orderkey % 53 <> 0 AND l_orderkey % 47 <> 0 THEN px_u / 1000000.0::DOUBLE END AS v FROM ticks")
def require_decimal(spark, sf):
    return _lines(spark, sf, "OPEN").select("k", validate.require_non_negative_decimal(F.col("v")).alias("v"))


@register("optional_non_negative_decimal", "SELECT l_orderkey * 8 + l_linenumber AS k, CAST(CASE WHEN l_orderkey % 31 <> 0 AND l_orderkey % 29 <> 0 THEN qty - 1 END AS DOUBLE) AS v FROM ticks")
def optional_decimal(spark, sf):
    return _lines(spark, sf, "DELIV_QTY").select("k", validate.optional_non_negative_decimal(F.col("v")).alias("v"))


@register("parse_trade_date", "SELECT l_orderkey * 8 + l_linenumber AS k, CASE WHEN l_orderkey % 5 < 4 THEN CAST(trade_date AS VARCHAR) WHEN l_orderkey % 15 <> 4 THEN '1999-01-01' END AS v FROM ticks")
def parse_date(spark, sf):
    return _lines(spark, sf, "DAY").select("k", validate.parse_trade_date(F.col("v")).alias("v"))


@register("ohlc_bounds_raw", """
SELECT l_orderkey * 8 + l_linenumber AS k, CASE WHEN qty % 5 = 0 THEN 'HIGH must be greater than or equal to OPEN, LOW, and CLOSE' WHEN qty % 7 = 0 THEN 'LOW must be less than or equal to OPEN, HIGH, and CLOSE' END AS error FROM ticks""")
def bounds(spark, sf):
    q = b.ticks(spark, sf).selectExpr("l_orderkey * 8 + l_linenumber as k", "px_u as o", "case when qty % 5 = 0 then px_u - 1 else px_u + 9 end as h", "case when qty % 7 = 0 then px_u + 5 else px_u - 5 end as l")
    return q.select("k", validate.ohlc_bounds_raw(F.col("o"), F.col("h"), F.col("l"), F.col("o")).alias("error"))


@register("map_series", "SELECT l_orderkey * 8 + l_linenumber AS k, CASE WHEN l_orderkey % 6 <> 5 THEN ['EQ','BE','BZ','SM','ST'][l_orderkey % 6 + 1] END AS v FROM ticks")
def map_series(spark, sf):
    return _lines(spark, sf, "SERIES").select("k", validate.map_series(validate.require_text(F.col("v")), "NSE").alias("v"))


@register("normalize_identifier", "SELECT l_orderkey, upper(trim(identifier)) AS v FROM requests")
def normalize_identifier(spark, sf):
    return b.identifier_requests(spark, sf).select("l_orderkey", text.normalize_identifier(F.col("identifier")).alias("v"))


@register("split_symbol_exchange", "SELECT id, mic, sym AS symbol, ex AS exchange FROM ticker_asked")
def split_symbol(spark, sf):
    q = b.identifier_requests(spark, sf).select(F.upper(F.trim("identifier")).alias("id"), F.coalesce("exchange_mic", F.lit("")).alias("mic")).distinct()
    s = text.split_symbol_exchange(F.col("id"), F.nullif(F.col("mic"), F.lit("")))
    d = b.identifier_requests(spark, sf).select(F.upper(F.trim("identifier")).alias("id"), F.coalesce("exchange_mic", F.lit("")).alias("mic"), "as_of").distinct()
    return d.join(q.select("id", "mic", s.alias("s")), ["id", "mic"]).select("id", "mic", F.col("s.symbol").alias("symbol"), F.col("s.exchange").alias("exchange"))


@register("snake_case", """
SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace('x' || p_type || 'Total' || p_name || ' ' || p_brand || '!', '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS v FROM part""")
def snake(spark, sf):
    c = F.concat(F.lit("x"), "p_type", F.lit("Total"), "p_name", F.lit(" "), "p_brand", F.lit("!"))
    return b.table(spark, sf, "part").select("p_partkey", text.snake_case(c).alias("v"))


@register("truncate_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 256 THEN left(text, 253) || '...' ELSE text END AS v FROM documents")
def truncate(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.truncate_ellipsis(F.col("text")).alias("v"))


@register("yahoo_symbol", "SELECT instrument_id, symbol || CASE exchange_code WHEN 'NSE' THEN '.NS' WHEN 'BSE' THEN '.BO' ELSE '' END AS v FROM instruments JOIN exchanges USING (exchange_id)")
def yahoo(spark, sf):
    return b.instruments(spark, sf).join(b.exchanges(spark, sf), "exchange_id").select("instrument_id", text.yahoo_symbol(F.col("symbol"), F.col("exchange_code")).alias("v"))


@register("event_ts_default", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR AS VARCHAR) AS v FROM orders")
def event_ts(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", dates.event_ts_default(F.col("o_orderdate").cast("date")).alias("v"))


@register("subtract_trading_days", """
SELECT o_orderkey, CAST(CASE isodow(d) WHEN 6 THEN d - 5 WHEN 7 THEN d - 6 ELSE d - 7 END AS VARCHAR) AS five, CAST(CASE isodow(d) WHEN 1 THEN d - 3 WHEN 7 THEN d - 2 ELSE d - 1 END AS VARCHAR) AS one FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def trading_days(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return b.table(spark, sf, "orders").select("o_orderkey", dates.subtract_trading_days(d, 5).alias("five"), dates.subtract_trading_days(d, 1).alias("one"))


@register("period_to_start_date", """
SELECT o_orderkey, CAST(d - CASE o_orderkey % 4 WHEN 0 THEN 730 WHEN 1 THEN 180 WHEN 2 THEN 5 ELSE 365 END AS VARCHAR) AS v FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def period_start(spark, sf):
    p = F.expr("element_at(array('2y','6MO','5d','max'), cast(o_orderkey % 4 as int) + 1)")
    return b.table(spark, sf, "orders").select("o_orderkey", dates.period_to_start_date(p, F.col("o_orderdate").cast("date")).alias("v"))


@register("format_metric", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'N/A' WHEN v >= 1000 THEN format('{:,}', CAST(round_even(v, 0) AS BIGINT)) WHEN v >= 1 THEN printf('%.2f', v) ELSE printf('%.2f', v * 100) || '%' END AS v
FROM (SELECT event_id, value * CASE WHEN event_id % 3 = 0 THEN 0.001::DOUBLE WHEN event_id % 3 = 1 THEN 100.003::DOUBLE ELSE 1.0001::DOUBLE END AS v FROM events WHERE value * 100.003::DOUBLE >= 1000 OR event_id % 3 <> 1)""".replace("WHERE value * 100.003::DOUBLE >= 1000 OR event_id % 3 <> 1", "").replace("WHEN v >= 1 THEN printf('%.2f', v)", "WHEN v >= 1 THEN format('{:,.2f}', v)"))
def fmt(spark, sf):
    v = F.col("value") * F.expr("case when event_id % 3 = 0 then 0.001D when event_id % 3 = 1 then 100.003D else 1.0001D end")
    return b.table(spark, sf, "events").select("event_id", numeric.format_metric(F.when(F.col("event_id") % 10 != 0, v)).alias("v"))


@register("safe_ratio", "SELECT event_id, round(value / nullif(event_id % 5, 0), 9) AS v FROM events")
def safe_ratio(spark, sf):
    return b.table(spark, sf, "events").select("event_id", F.round(numeric.safe_ratio(F.col("value"), (F.col("event_id") % 5).cast("double")), 9).alias("v"))


@register("numeric_or_zero", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS v FROM events")
def numeric_or_zero(spark, sf):
    c = F.expr("case when event_id % 8 = 0 then 'abc' when event_id % 8 = 4 then null else cast(value as string) end")
    return b.table(spark, sf, "events").select("event_id", numeric.numeric_or_zero(c).alias("v"))


@register("first_label_value", "SELECT instrument_id, fiscal_year, coalesce(p1, p2, p3) AS v FROM yearly")
def first_label(spark, sf):
    return b.yearly(spark, sf).select("instrument_id", F.col("fiscal_year").cast("long").alias("fiscal_year"), text.first_label_value(F.col("p1"), F.col("p2"), F.col("p3")).alias("v"))


@register("abs_capex", "SELECT statement_fact_id, CAST(CASE WHEN line_item_code = 'CAPEX' THEN abs(value) ELSE -value END AS DOUBLE) AS v FROM facts")
def abs_capex(spark, sf):
    return b.facts(spark, sf).select("statement_fact_id", text.abs_capex(F.col("line_item_code"), -F.col("value")).alias("v"))


@register("valuation_status_text", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Valued' ELSE 'Not yet valued' END AS v FROM orders")
def status_text(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", text.valuation_status_text(F.col("o_orderstatus") == "F").alias("v"))


WORDS_SQL = """list_distinct(list_transform(string_split_regex(text, '\\s+'), lambda w: lower(regexp_replace(w, '^[.,:;!?()\\[\\]{}"]+|[.,:;!?()\\[\\]{}"]+$', '', 'g'))))"""
PLUS, MINUS = ["the", "des", "in", "la"], ["and", "le", "un", "of"]


@register("keyword_score", f"""
SELECT doc_id, CAST(len(list_intersect(w, {PLUS})) - len(list_intersect(w, {MINUS})) AS BIGINT) AS score FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)""")
def keyword_score(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.keyword_score(F.col("text"), PLUS, MINUS).alias("score"))


@register("keyword_intersection", f"""
SELECT conv_id, turn, CAST(len(list_intersect(w, {PLUS + MINUS})) AS BIGINT) AS hits FROM (SELECT conv_id, turn, {WORDS_SQL} AS w FROM conversations)""")
def keyword_hits(spark, sf):
    return b.table(spark, sf, "conversations").select("conv_id", "turn", F.size(text.keyword_intersection(text.words(F.col("text")), PLUS + MINUS)).alias("hits"))


@register("date_window_guard", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def window_guard(spark, sf):
    start, end = dt.date(1996, 1, 1), dt.date(1996, 12, 31)
    dates.date_window_guard(start, end)
    return b.table(spark, sf, "orders").where(F.col("o_orderdate").cast("date").between(F.lit(start), F.lit(end))).agg(F.count(F.lit(1)).alias("n"))


# --- streams ------------------------------------------------------------------------------------------------------


_B_CHECKS = _checks("NSE").replace("WHEN l_orderkey % 31 <> 0 AND l_orderkey % 29 = 0 THEN 'DELIV_QTY must be non-negative' ", "")
# delivery 0 has all rows; delivery 1 comes again for the first ten days of a month, from the sixth on with other quantities
sqlparts.part("delivered", f"""
SELECT 0 AS batch, *, l_orderkey % 31 = 0 AS blank, CASE WHEN l_orderkey % 31 = 0 THEN ' ' WHEN l_orderkey % 29 = 0 THEN '-3' ELSE CAST(qty - 1 AS VARCHAR) END <> '9' AS other FROM nse_file
UNION ALL SELECT 1, *, l_orderkey % 31 = 0, false FROM nse_file WHERE day(trade_date) <= 5
UNION ALL SELECT 1, *, {_B_CHECKS} AS error, false, CASE WHEN l_orderkey % 31 = 0 THEN ' ' WHEN l_orderkey % 29 = 0 THEN '-3' ELSE CAST(qty - 1 AS VARCHAR) END <> '9' FROM ticks WHERE day(trade_date) BETWEEN 6 AND 10""")
sqlparts.part("delivered_days", """
SELECT batch, trade_date, count(*) FILTER (error IS NULL AND NOT blank) AS n, batch = 0 OR bool_or(other) AS updated, 'NSE_EOD|' || trade_date || '|' || batch AS run FROM delivered GROUP BY 1, 2""")
_SHOWN = "CAST(l_orderkey * 8 + l_linenumber AS VARCHAR)"
FILE_ROWS = 100_000


@register("stream_bhavcopy", f"""
SELECT batch, 'valid' AS output, {_SHOWN} AS k, 'S' || instrument_id || ' ' || strftime(trade_date, '%Y-%m-%d') AS what FROM delivered WHERE error IS NULL AND NOT blank
UNION ALL SELECT batch, 'rejected', {_SHOWN}, error FROM delivered WHERE error IS NOT NULL
UNION ALL SELECT batch, 'refused', {_SHOWN}, 'null_not_allowed field=delivery_qty' FROM delivered WHERE error IS NULL AND blank
UNION ALL SELECT batch, 'incidents', 'S' || instrument_id, 'RAW_CONTRACT_VALIDATION_FAILED null_not_allowed field=delivery_qty' FROM delivered WHERE error IS NULL AND blank
UNION ALL SELECT d.batch, 'rows', {_SHOWN}, strftime(trade_date, '%Y-%m-%d') FROM delivered d JOIN delivered_days t USING (batch, trade_date) WHERE error IS NULL AND NOT blank AND updated
UNION ALL SELECT batch, 'versions', run, n || ' true ' || (batch = 1) FROM delivered_days WHERE updated
UNION ALL SELECT batch, 'manifest', run, n || ' ' || (batch = 1) FROM delivered_days WHERE updated
UNION ALL SELECT batch, 'runs', run, 'SUCCESS' FROM delivered_days
UNION ALL SELECT batch, 'events', run, 'START ~' FROM delivered_days
UNION ALL SELECT batch, 'events', run, 'END ' || n || ' ' || updated || ' ' || updated FROM delivered_days""")
def stream_files(spark, sf):
    out, cp, folder = work_dir(spark, "stream"), work_dir(spark, "stream-cp"), work_dir(spark, "nse-stream")
    rows = _file_rows(spark, sf, "NSE").drop("SC_CODE").withColumnsRenamed(NSE_NAMES)
    day = F.dayofmonth(F.col("WANTED").cast("date"))
    again = rows.where(day <= 10).withColumn("DELIV_QTY", F.when(day <= 5, F.col("DELIV_QTY")).otherwise("9"))
    contract = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name != "delivery_qty") for f in schemas.contract_schema(CONTRACT)])
    for delivery in (rows, again):
        # packed, as files arrive from an exchange; a packed file is read by one task, so that its rows are bounded
        packed = delivery.write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", FILE_ROWS)
        packed.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
        connector.stream_connector(spark, folder, out, cp, "WANTED", contract, dt.datetime(2024, 1, 1), rows.columns, ["k"]).awaitTermination()
    run = F.concat_ws("|", "source_system", "trade_date", F.col("batch").cast("string"))
    load = F.concat_ws(" ", *(F.get_json_object("metrics_payload", f"$.{n}") for n in ("row_count", "created", "updated")))
    shown = {
        "valid": ("k", F.concat_ws(" ", "symbol", "timestamp")), "rejected": ("k", F.col("error")), "refused": ("k", F.col("reason")), "incidents": ("target_record_key", F.concat_ws(" ", "rule_code", "resolution_notes")),
        "rows": ("k", F.col("trade_date").cast("string")), "versions": (run, F.concat_ws(" ", F.col("row_count").cast("string"), F.col("created").cast("string"), F.col("previous_checksum").isNotNull().cast("string"))),
        "manifest": (run, F.concat_ws(" ", F.col("row_count").cast("string"), F.col("previous_checksum").isNotNull().cast("string"))), "runs": ("pipeline_run_id", F.col("status")),
        "events": ("pipeline_run_id", F.concat_ws(" ", "event_type", F.when(F.col("event_type") == "START", F.coalesce("metrics_payload", F.lit("~"))).otherwise(load))),
    }
    parts = [connector.committed(spark, out, name).select("batch", F.lit(name).alias("output"), (F.col(k) if isinstance(k, str) else k).alias("k"), what.alias("what")) for name, (k, what) in shown.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


def _batches(spark, df, path, column):
    """Write a frame as one folder per value of ``column``, oldest value first."""
    values = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    for v in values:
        yield df.where(F.col(column) == v).drop(column), f"{path}/part={v}"


@register("stream_dedupe_payloads", "SELECT arrival, checksum, prev AS previous_checksum FROM kept")
def stream_payloads(spark, sf):
    src, out, cp = (work_dir(spark, x) for x in ("payloads", "zone", "zone-cp"))
    p = _payloads(spark, sf).withColumn("part", F.floor((F.dayofmonth("trade_date") - 1) / 10).cast("int"))
    schema = p.drop("part").schema
    for batch, path in _batches(spark, p, src, "part"):
        batch.write.parquet(path)
        ingest.stream_dedupe_payloads(spark.readStream.schema(schema).parquet(f"{src}/*"), out, cp).awaitTermination()
    return spark.read.parquet(f"{out}/versions").select("arrival", "checksum", "previous_checksum")


LATE_AS_OF = dt.datetime(2001, 7, 2, 12)


_TAKEN = "trade_date >= DATE '1996-01-01' AND CAST(trade_date AS TIMESTAMP) + INTERVAL 10 HOUR <= TIMESTAMP '2001-07-02 13:00:00'"


@register("stream_late_corrections", f"""
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, CAST(CASE WHEN instrument_id % 2 = 0 THEN close_px + 1 ELSE close_px END AS DOUBLE) AS close_px, 'stored' AS what FROM bars WHERE {_TAKEN}
UNION ALL SELECT instrument_id, CAST(trade_date AS VARCHAR), CAST(close_px + CASE WHEN n = 0 THEN 0 WHEN instrument_id % 2 = 0 THEN 1 ELSE 7 END AS DOUBLE), n || CASE WHEN trade_date < DATE '1996-01-01' THEN ' event_ts_stale' ELSE ' future_event_ts' END
FROM bars, range(2) r(n) WHERE NOT ({_TAKEN})""")
def stream_late(spark, sf):
    src, tab, stage, cp = (work_dir(spark, x) for x in ("late", "late-table", "late-stage", "late-cp"))
    rows = b.bars(spark, sf).select("instrument_id", "trade_date", "close_px", "ingested_at", F.lit("r").alias("source_record_id"), dates.event_ts_default(F.col("trade_date")).alias("event_ts"))
    for n in range(2):
        if n == 0:
            batch = rows
        else:  # corrections of what was delivered, read as it was written: bars are made once
            newer, px = F.col("instrument_id") % 2 == 0, F.col("close_px") + F.when(F.col("instrument_id") % 2 == 0, 1).otherwise(7)
            taken = F.when(newer, F.expr("ingested_at + interval 1 day")).otherwise(F.col("ingested_at"))
            batch = spark.read.schema(rows.schema).parquet(f"{src}/part=0").withColumns({"close_px": px.cast("decimal(18,6)"), "ingested_at": taken})
        batch.write.parquet(f"{src}/part={n}")
        # a window of 1436 weekdays reaches back to 1996-01-01
        ingest.stream_late_corrections(spark.readStream.schema(rows.schema).parquet(f"{src}/*"), tab, stage, cp, LATE_AS_OF, 1435).awaitTermination()
    refused = spark.read.parquet(f"{stage}/refused").select("instrument_id", "trade_date", "close_px", F.concat_ws(" ", F.col("batch").cast("string"), "reason").alias("what"))
    return spark.read.parquet(tab).select("instrument_id", "trade_date", "close_px", F.lit("stored").alias("what")).unionByName(refused)


_SEEN = "(SELECT c - CAST(CASE isodow(c) WHEN 6 THEN 362 WHEN 7 THEN 363 ELSE 364 END AS INTEGER) AS bound FROM (SELECT max(trade_date) AS c FROM bars WHERE trade_date < DATE '1998-01-01'))"


@register("stream_late_by_event_time", f"""
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, CAST(CASE WHEN instrument_id % 2 = 0 AND trade_date < DATE '1998-01-01' AND trade_date >= bound THEN close_px + 1 ELSE close_px END AS DOUBLE) AS close_px, 'stored' AS what FROM bars, {_SEEN}
UNION ALL SELECT instrument_id, CAST(trade_date AS VARCHAR), CAST(close_px + 1 AS DOUBLE), '1 event_ts_stale' FROM bars, {_SEEN} WHERE instrument_id % 2 = 0 AND trade_date < bound
UNION ALL SELECT instrument_id, CAST(trade_date AS VARCHAR), NULL, '1 superseded_row' FROM bars, {_SEEN} WHERE instrument_id % 2 = 0 AND trade_date < DATE '1998-01-01' AND trade_date >= bound""")
def stream_late_by_event_time(spark, sf):
    """Two deliveries into a bucketed table; what the first has shown decides which corrections of the second are late."""
    src, tab, stage, cp = (work_dir(spark, x) for x in ("event", "event-table", "event-stage", "event-cp"))
    rows = b.bars(spark, sf).select("instrument_id", "trade_date", "close_px", "ingested_at", F.lit("r").alias("source_record_id"), dates.event_ts_default(F.col("trade_date")).alias("event_ts"))
    first = rows.where("trade_date < date'1998-01-01'")
    newer = first.where("instrument_id % 2 = 0").withColumn("close_px", (F.col("close_px") + 1).cast("decimal(18,6)")).withColumn("ingested_at", F.expr("ingested_at + interval 1 day"))
    table = bucketed.Bucketed(f"corrections_{tab[-32:]}", tab, slots=1, buckets=bucketed.buckets_for(b.table(spark, sf, "lineitem").count()), period="yyyy")
    bucketed.open_table(spark, table, rows.drop("event_ts").schema)
    for n, batch in enumerate([first, newer.unionByName(rows.where("trade_date >= date'1998-01-01'"))]):
        batch.write.parquet(f"{src}/part={n}")
        ingest.stream_late_corrections(spark.readStream.schema(rows.schema).parquet(f"{src}/*"), table, stage, cp, None, 260).awaitTermination()
    refused = spark.read.parquet(f"{stage}/refused").select("instrument_id", "trade_date", "close_px", F.concat_ws(" ", F.col("batch").cast("string"), "reason").alias("what"))
    key = F.split("target_record_key", ":")
    gone = spark.read.parquet(f"{stage}/superseded").select(
        key[0].cast("long").alias("instrument_id"), key[1].cast("date").alias("trade_date"), F.lit(None).cast("decimal(18,6)").alias("close_px"), F.concat_ws(" ", F.col("batch").cast("string"), "failure_reason").alias("what"))
    return spark.table(table.name).select("instrument_id", "trade_date", "close_px", F.lit("stored").alias("what")).unionByName(refused).unionByName(gone)


from tickerlake.plans.on_prices import WALK  # noqa: E402


@register("stream_breaker", WALK.format(pre="", cand="SELECT instrument_id, trade_date, CAST(close_px AS DOUBLE) AS close, CAST(close_px AS DOUBLE) AS adj, false AS stored, '' AS source_record_id FROM bars") + """
SELECT instrument_id, CAST(trade_date AS VARCHAR) AS trade_date, ok AS breaker_ok, false AS late FROM judged""")
def stream_breaker(spark, sf):
    """Days come in an order of their own, so that most rows of the later batches are late."""
    src, out, cp = (work_dir(spark, x) for x in ("breaker", "breaker-out", "breaker-cp"))
    px = F.col("close_px").cast("double")
    bars = b.bars(spark, sf).select("instrument_id", "trade_date", px.alias("close"), px.alias("adj"), F.lit(0).cast("long").alias("arrived"), F.pmod(F.xxhash64("instrument_id", "trade_date"), F.lit(3)).alias("part"))
    schema, setting = bars.drop("part").schema, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(setting)
    spark.conf.set(setting, ingest.ROCKSDB)
    try:
        for batch, path in _batches(spark, bars, src, "part"):
            batch.write.parquet(path)
            ingest.stream_breaker(spark.readStream.schema(schema).parquet(f"{src}/*"), out, cp).awaitTermination()
    finally:
        spark.conf.set(setting, was)
    return ingest.breaker_verdicts(spark, out).select("instrument_id", "trade_date", "breaker_ok", "late")
