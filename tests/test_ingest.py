import datetime as dt
import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickerlake import schemas
from tickerlake.functions import dates, numeric, text
from tickerlake.operators import compliance, ops, quality, timejoin, validate
from tickerlake.sources import bhavcopy, rawzone
from tickerlake.streaming import ingest

D, NOW = dt.date, dt.datetime(2026, 6, 26, 12)
NSE = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,TOTTRDQTY,DELIV_QTY,TIMESTAMP\n"


def write(path, body):
    path.write_text(body)
    return str(path)


def test_nse_scan_modes(spark, tmp_path):
    p = write(tmp_path / "a.csv", NSE + "ITC,EQ,100,102,99,101,1000,,26-Jun-2026\nBAD,EQ,100,90,99,101,1,1,2026-06-26\n")
    good, bad = bhavcopy.scan_nse_bhavcopy(spark, p, D(2026, 6, 26), "quarantine")
    assert [(r.symbol, r.delivery_qty, r.timestamp) for r in good.collect()] == [("ITC", None, D(2026, 6, 26))]
    assert bad.head().error.startswith("HIGH must be")
    with pytest.raises(PySparkException):
        bhavcopy.scan_nse_bhavcopy(spark, p, D(2026, 6, 26)).collect()
    with pytest.raises(ValueError, match="CLOSE"):
        bhavcopy.scan_nse_bhavcopy(spark, write(tmp_path / "b.csv", NSE.replace("CLOSE,", "") + "ITC,EQ,1,1,1,1,1,2026-06-26\n"), D(2026, 6, 26))
    assert bhavcopy.scan_nse_bhavcopy(spark, write(tmp_path / "c.csv", NSE), D(2026, 6, 26)).count() == 0


def test_bse_zip_and_mapping(spark, tmp_path):
    body = "SC_CODE,SC_NAME,SC_GROUP,OPEN,HIGH,LOW,CLOSE,NO_OF_SHRS,DELIV_QTY,DT_TM\n500875,ITC,A,100,102,99,101,1000,450,2026-06-26\n999,NO,A,1,1,1,1,1,1,2026-06-26\n"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("EQ260626.CSV", body)
    (tmp_path / "eq.zip").write_bytes(buf.getvalue())
    isin = spark.createDataFrame([("500875", "INE154A01025")], "alias_symbol string, isin_primary string")
    good, bad = bhavcopy.scan_bse_bhavcopy(spark, str(tmp_path / "eq.zip"), D(2026, 6, 26), isin, "quarantine", zipped=True)
    assert [(r.symbol, r.series) for r in good.collect()] == [("ITC", "EQ")]
    assert bad.head().error == "Missing ISIN mapping for BSE scrip code 999"


def test_zipped_payloads(spark, tmp_path):
    def pack(body):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("readme.txt", "x")
            z.writestr("eq.Csv", body)
        return buf.getvalue()

    given = {
        "empty": b"", "header": b"a,b\n", "empty member": pack(b""), "no b": b"z,a\n1,2\n", "marked": pack(b"\xef\xbb\xbfa,b\n1,\n"),
        "uneven": pack(b'a,b\n1\n2,3\n\n4,5,6\n"x\ny",""\n'), "all uneven": b"b,a\n1\n"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in given.items()], "path string, content binary")
    found = sorted((tuple(r) for r in bhavcopy.unzip_csv(df, ["a", "b"]).collect()), key=str)
    assert found == sorted([("no b", "2", None), ("marked", "1", ""), ("uneven", "1", None), ("uneven", "2", "3"), ("uneven", "4", "5"), ("uneven", "x\ny", ""), ("all uneven", None, "1")], key=str)
    with pytest.raises(PySparkException, match="does not contain a CSV"):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("readme.txt", "x")
        bhavcopy.unzip_csv(spark.createDataFrame([("p", bytearray(buf.getvalue()))], "path string, content binary"), ["a"]).collect()
    # written archives are whole, one for each batch, and read back
    rows = spark.createDataFrame([(i, f'q"{i},\n' if i % 3 else f" {i}") for i in range(25_000)], "i int, t string")
    bhavcopy.write_zipped_csv(rows, str(tmp_path / "z"))
    files = list((tmp_path / "z").glob("part-*"))
    assert len(files) >= 3 and all(zipfile.ZipFile(f).testzip() is None for f in files)
    back = bhavcopy.read_zipped_csv(spark, str(tmp_path / "z"), ["t", "i"]).select(F.col("i").cast("int"), "t")
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()


def test_contract_reasons(spark):
    schema = schemas.contract_schema(schemas.__file__.replace("schemas.py", "contracts/nse_eod.json"))
    base = {f.name: "1" for f in schema.fields} | {"timestamp": "2026-06-26"}
    rows = [base, base | {"volume": "not-a-number"}, base | {"delivery_qty": None}, base | {"open": None}, base | {"extra": "1"}, {k: v for k, v in base.items() if k != "low"}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, row map<string,string>")
    good, bad = validate.validate_contract(df, schema)
    assert sorted(r.i for r in good.collect()) == [0, 2]
    assert {r.i: r.reason for r in bad.collect()} == {
        1: "type_mismatch field=volume expected=decimal", 3: "null_not_allowed field=open", 4: "schema_drift missing=[] extra=['extra']", 5: "schema_drift missing=['low'] extra=[]"}


def payloads(spark, seq, start=0):
    return spark.createDataFrame([("NSE", D(2026, 6, 26), start + i, c, 1) for i, c in enumerate(seq)], "source_system string, trade_date date, arrival long, checksum string, row_count long")


def test_raw_zone_versions(spark):
    none = spark.createDataFrame([], "source_system string, trade_date date, current_checksum string, previous_checksum string, row_count long")
    versions, manifest = rawzone.raw_zone_write(payloads(spark, "AABA"), none)
    assert [(r.arrival, r.checksum, r.previous_checksum, r.created) for r in versions.orderBy("arrival").collect()] == [(0, "A", None, True), (2, "B", "A", True), (3, "A", "B", False)]
    m = manifest.head()
    assert (m.current_checksum, m.previous_checksum) == ("A", "B")
    again, after = rawzone.raw_zone_write(payloads(spark, "A", 9), manifest)
    assert again.count() == 0 and after.head().previous_checksum == "B"
    assert rawzone.idempotent_anti(payloads(spark, "AC", 9), manifest).head().checksum == "C"


def test_manifest_reads_start_from_a_snapshot(spark, tmp_path):
    zone, schema = str(tmp_path / "zone"), rawzone.MANIFEST
    assert rawzone.newest_manifest(spark, zone).collect() == [] and rawzone.last_snapshot(spark, zone) == -1
    want = {}
    for batch in range(12):
        rows = [("NSE", D(2026, 6, 1 + k), f"c{batch}-{k}", None, batch) for k in {batch % 5, batch % 3}]
        rawzone.save_manifest(spark.createDataFrame(rows, schema).coalesce(1), zone, batch)
        want |= {r[1]: r[2] for r in rows}
        if batch == 6:
            early = dict(want)
        if batch in (4, 9):
            rawzone.take_snapshot(spark, zone, batch)
    newest = lambda *a: {r.trade_date: r.current_checksum for r in rawzone.newest_manifest(spark, zone, *a).collect()}
    assert newest() == want and newest(7) == early
    assert newest(None, spark.createDataFrame([("NSE", D(2026, 6, 2))], "source_system string, trade_date date")) == {D(2026, 6, 2): want[D(2026, 6, 2)]}
    rawzone.take_snapshot(spark, zone, 9)
    assert newest() == want and rawzone.last_snapshot(spark, zone) == 9
    for batch in range(9):  # nothing before the snapshot is opened
        for file in (tmp_path / "zone" / "manifest" / f"batch={batch}").glob("*.parquet"):
            file.write_bytes(b"broken")
    assert newest() == want


def test_sliced_lag_on_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(timejoin, "SLICE_ROWS", 200)
    n = 5000
    df = spark.range(n).selectExpr("case when id % 3 <> 2 then 'hot' else concat('k', id % 11) end as source_system", "date'2026-01-01' as trade_date", "id as arrival", "concat('c', id) as checksum")
    got = {r.arrival: r.previous_checksum for r in rawzone.version_chain(df).collect()}
    last, want = {}, {}
    for i in range(n):
        k = "hot" if i % 3 != 2 else f"k{i % 11}"
        want[i] = last.get(k)
        last[k] = f"c{i}"
    assert got == want
    assert timejoin.sliced_lag(df.limit(0), ["source_system"], "arrival", "checksum", "before").collect() == []
    cuts = df.select(F.size(timejoin.order_slices(df, "arrival"))).head()[0]
    assert 20 <= cuts <= 30


def record(**over):
    return dict(instrument_id=101, symbol="ITC", trade_date=D(2026, 6, 26), source_system="NSE", open_px=100.0, high_px=102.0, low_px=99.0, close_px=101.0, event_ts=NOW) | over


def gate(spark, *rows, curated=()):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "instrument_id long, symbol string, trade_date date, source_system string, open_px double, high_px double, low_px double, close_px double, event_ts timestamp")
    cur = spark.createDataFrame(list(curated), "instrument_id long, trade_date date, source_system string, close_px double")
    return quality.process_batch(df, cur, quality.builtin_rules(df.columns, ["instrument_id", "close_px"], NOW), 1, "raw", "market_ohlcv_1d", "t", NOW)


@pytest.mark.parametrize("over,curated,code,reason", [
    (dict(close_px=None), [], "NULL_CHECK_V1", "null_fields=close_px"),
    (dict(high_px=2e6), [], "RANGE_CHECK_V1", "price_out_of_range field=high_px"),
    (dict(event_ts=dt.datetime(2026, 6, 18)), [], "STALE_CHECK_V1", "event_ts_stale"),
    (dict(), [(101, D(2026, 6, 26), "NSE", 100.0)], "DUPLICATE_CHECK_V1", "duplicate_curated_row"),
    (dict(instrument_id=None), [], "SYMBOL_RESOLVED_CHECK_V1", "instrument_id_unresolved"),
    (dict(close_px=160.0), [(101, D(2026, 6, 25), "NSE", 100.0)], "CIRCUIT_BREAKER_V1", "circuit_breaker_triggered"),
])
def test_each_rule_blocks(spark, over, curated, code, reason):
    out = gate(spark, record(), record(**over), curated=curated)
    bad = {(r.rule_code, r.failure_reason) for r in out["results"].where("status = 'FAIL'").collect()}
    assert (code, reason) in bad
    assert out["results"].count() == 12


def test_gate_outputs(spark):
    out = gate(spark, record(), record(instrument_id=102, close_px=160.0, high_px=2e6), curated=[(102, D(2026, 6, 25), "NSE", 100.0)])
    assert out["counts"].head()[:] == (2, 1, 1)
    assert (out["lineage"].head().record_count_in, out["lineage"].head().record_count_out) == (2, 1)
    assert [r.rule_code for r in out["quarantine"].collect()] == ["RANGE_CHECK_V1"]
    assert sorted(r.event_type for r in out["events"].collect()) == ["ERROR", "WARN"]
    assert [r.instrument_id for r in out["allowed"].collect()] == [101]


def test_user_rule(spark):
    mine = quality.Rule("volume_check", "LOW", F.col("close_px") > 100, F.lit("big"), F.col("close_px").cast("string"), F.lit("<=100"))
    df = spark.createDataFrame([(1, "A", D(2026, 1, 1), "S", 101.0)], "instrument_id long, symbol string, trade_date date, source_system string, close_px double")
    r = quality.evaluate_rules(quality.judge(df, [mine]), 1, "t", NOW).head()
    assert (r.rule_code, r.status, r.failure_reason) == ("VOLUME_CHECK_V1", "WARN", "big")
    assert quality.batch_counts(quality.judge(df, [mine])).head().row_count_out == 1


def test_trading_days_closed_form(spark):
    start = D(2026, 1, 1)
    df = spark.range(40).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    for n in range(0, 13):
        for r in df.select("d", dates.subtract_trading_days(F.col("d"), n).alias("x")).collect():
            want, left = r.d, n
            while left:
                want -= dt.timedelta(days=1)
                left -= want.weekday() < 5
            assert r.x == want, (r.d, n)


def test_scalar_columns(spark):
    one = spark.range(1)

    def val(c):
        return one.select(c.alias("v")).head().v

    lit = F.lit
    assert [val(numeric.format_metric(lit(x))) for x in (None, 1234.5, 6.755, 0.12345, -2.5)] == ["N/A", "1,234", "6.75", f"{0.12345:.2%}", "-2.50"]
    assert val(text.snake_case(lit("TotalRevenue (TTM)"))) == "total_revenue_ttm"
    assert val(text.keyword_score(lit("Profit, growth! growth (loss)"))) == 1
    assert val(text.truncate_ellipsis(lit("x" * 300))) == "x" * 253 + "..." and val(text.truncate_ellipsis(lit("x" * 256))) == "x" * 256
    assert str(val(dates.event_ts_default(lit(D(2026, 6, 26))))) == "2026-06-26 10:00:00"
    s = dt.datetime(2026, 1, 1)
    assert [val(dates.duration_text(lit(s), lit(s + dt.timedelta(seconds=k)), lit(s))) for k in (42, 185, 7620)] == ["42s", "3m 5s", "2h 7m"]
    assert [val(dates.retry_delay_schedule(lit(k))) for k in (1, 2, 7)] == [5.0, 10.0, 300.0]
    assert val(text.record_key(lit(None).cast("long"), lit(None).cast("string"), lit(D(2026, 1, 1)), lit("S"))) == "UNKNOWN:2026-01-01"


def test_compliance_order(spark):
    pol = spark.createDataFrame([("NSE", False, False, True), ("Open", True, True, False)], "source_name string, redistribution_allowed boolean, commercial_use boolean, attribution_required boolean")
    req = spark.createDataFrame([(1, " nse ", True, True, None, True, 1, None), (2, "NSE", True, True, None, False, 1, None), (3, "NSE", False, True, "", False, 1, None), (4, "NSE", False, True, "ok", False, 1, None), (4, "open", True, True, None, True, 1, None), (5, "zz", False, False, None, False, 1, None)],
                                "request_id int, source_name string, external_call boolean, derived_output boolean, attribution string, commercial_context boolean, user_id int, resource_id string")
    d = compliance.compliance_decisions(req, pol)
    assert {(r.request_id, r.decision) for r in d.collect()} == {(1, "commercial_use_blocked"), (2, "redistribution_blocked"), (3, "attribution_required"), (4, "allowed"), (5, "policy_not_registered")}
    assert {r.request_id for r in compliance.compliance_filter(req, d).collect()} == {4}
    assert compliance.compliance_audit(d, NOW).count() == 5


def test_sla(spark):
    exp = ops.expected_runs(spark, D(2026, 6, 26), D(2026, 6, 29))
    assert exp.count() == 4  # a Friday and a Monday
    runs = spark.createDataFrame([(1, "nse_eod_ingest", D(2026, 6, 26), dt.datetime(2026, 6, 26, 14, 30)), (2, "bse_eod_ingest", D(2026, 6, 26), dt.datetime(2026, 6, 26, 14, 31)), (3, "nse_eod_ingest", D(2026, 6, 29), None)],
                                 "pipeline_run_id long, pipeline_name string, trade_date date, confirmed_at timestamp")
    none = spark.createDataFrame([], "pipeline_run_id long, sla_type string")
    b, e = ops.sla_breaches(exp, runs, none, NOW)
    assert sorted((r.pipeline_run_id or 0) for r in b.collect()) == [0, 2, 3] and e.count() == 3


def test_schema_catalog():
    assert len(schemas.TABLES) == 37
    for name, t in schemas.TABLES.items():
        assert len(t.schema) == len(t.columns)
        for col, (target, ref) in t.foreign.items():
            assert col in t.columns and ref in schemas.TABLES[target].columns, name
        for check in t.checks:
            assert schemas.columns_of(check) <= set(t.columns), check


def test_stream_breaker_judges_late_rows_and_corrects_later_ones(spark, tmp_path):
    schema = "instrument_id long, trade_date date, close double, adj double, arrived long"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    px = lambda day, close, arrived=0, key=1: (key, D(2026, 1, day), float(close), float(close), arrived)
    batches = [
        [px(2, 10), px(3, 100), px(5, 49)],  # 100 fails against 10, 49 passes
        [px(4, 51), px(3, 2, key=2)],  # late: fails against 10, changes nothing
        [px(1, 30), px(2, 11)],  # a first day, and another version of the second
        [px(2, 12, 1), px(5, 70)],  # arrived later: now the reference, so 51 and 49 pass; 70 after 51 passes
        [px(20, 60)], [px(3, 1), px(12, 3)],  # days before the tenth are refused from now on
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/part={n}")
        ingest.stream_breaker(spark.readStream.schema(schema).parquet(f"{src}/*"), out, cp, keep_days=10).awaitTermination()
    got = {(r.instrument_id, r.trade_date.day, r.close): (r.breaker_ok, r.late) for r in ingest.breaker_verdicts(spark, out).collect()}
    want = {(1, 1, 30): True, (1, 2, 10): True, (1, 2, 11): True, (1, 2, 12): True, (1, 3, 100): False, (1, 4, 51): True, (1, 5, 49): True, (1, 5, 70): True, (2, 3, 2): True, (1, 20, 60): True, (1, 12, 3): False}
    assert got == {k: (ok, False) for k, ok in want.items()} | {(1, 3, 1): (None, True)}
    # the same rows at once
    rows = [r for batch in batches[:5] for r in batch]
    one = str(tmp_path / "one")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{one}/in/part=0")
    ingest.stream_breaker(spark.readStream.schema(schema).parquet(f"{one}/in/*"), f"{one}/out", f"{one}/cp").awaitTermination()
    assert {(r.instrument_id, r.trade_date.day, r.close): r.breaker_ok for r in ingest.breaker_verdicts(spark, f"{one}/out").collect()} == {k: ok for k, ok in want.items() if k != (1, 12, 3)}


def test_small_payloads_like_blocks(spark, monkeypatch):
    """Small payloads are split without an Arrow reader; what they give is what the reader gives."""
    texts = ["a,b\n1,2\n", "b,a\n1,\n\n,2", "a\n1\n", "c\n1\n", "a,b\n", "﻿a,b\n1,é\n", 'a,b\n"x,y",2\n', "a,b\r\n1,2\r\n", "a,b\n1\n1,2,3\n4,5\n", "", "a,b\n" + "1,2\n" * 30_000]
    payloads = []
    for i, text in enumerate(texts):
        for kind in (None, zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            buf = io.BytesIO()
            if kind is not None:
                with zipfile.ZipFile(buf, "w", kind) as z:
                    z.writestr("readme.txt", "x")
                    z.writestr("EQ.csv", text)
            payloads.append((f"{i} {kind}", bytearray(buf.getvalue() if kind is not None else text.encode())))
    read = lambda content: [pa_rows for block in bhavcopy._csv_batches(content, ["b", "a"]) for pa_rows in zip(*(c.to_pylist() for c in block))]
    want = sorted(((p, *r) for p, content in payloads for r in read(bytes(content))), key=str)
    df = spark.createDataFrame(payloads, "path string, content binary")
    assert sorted((tuple(r) for r in bhavcopy.unzip_csv(df, ["b", "a"]).collect()), key=str) == want and len(want) > 90_000
    monkeypatch.setattr(bhavcopy, "_csv_batches", None)
    assert bhavcopy._small_rows(bytes(payloads[2][1]), ["b", "a"]) == [["2"], ["1"]]  # no reader is opened


def test_damaged_small_archive_fails(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        z.writestr("EQ.csv", "a,b\n1,2\n")
    with pytest.raises(Exception):
        bhavcopy.unzip_csv(spark.createDataFrame([("p", bytearray(buf.getvalue().replace(b"1,2", b"1,3")))], "path string, content binary"), ["a"]).collect()
