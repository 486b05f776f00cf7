"""The connector's stream: every output, repeated batches, batches cut off between two writes."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from tickerlake import schemas
from tickerlake.sources import bhavcopy
from tickerlake.streaming import connector

AS_OF = dt.datetime(2026, 6, 27, 12)
CONTRACT = schemas.contract_schema(schemas.__file__.replace("schemas.py", "contracts/nse_eod.json"))
STRICT = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name != "delivery_qty") for f in CONTRACT])


def deliver(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([",".join([*bhavcopy.NSE_HEADERS, "DAY"]), *(",".join(r) for r in rows)]) + "\n")


def row(symbol, px="100", qty="5", deliv="1", day="2026-06-26", series="EQ"):
    return symbol, series, px, px, px, px, qty, deliv, day, day


def run(spark, base, strict=True):
    out = str(base / "out")
    connector.stream_connector(spark, str(base / "in"), out, str(base / "cp"), "DAY", STRICT if strict else CONTRACT, AS_OF, [*bhavcopy.NSE_HEADERS, "DAY"]).awaitTermination()
    return out


def everything(spark, out):
    return {name: sorted((tuple(r) for r in connector.committed(spark, out, name).collect()), key=str) for name in connector.OUTPUTS}


FIRST = [row("A"), row(" b "), row("C", px="x"), row("D", deliv=""), row("E", day="2026-06-25"), row("F", series="ZZ", day="2026-06-25")]


def test_outputs_of_three_deliveries(spark, tmp_path):
    deliver(tmp_path / "in", "1.csv", *FIRST)
    out = run(spark, tmp_path)
    deliver(tmp_path / "in", "2.csv", *FIRST[3::-1], row("E", px="7", day="2026-06-25"))  # the 26th as it was, in another order
    run(spark, tmp_path)
    deliver(tmp_path / "in", "3.csv", *FIRST[4:])  # the 25th as it was first
    run(spark, tmp_path)
    rows = {n: connector.committed(spark, out, n) for n in connector.OUTPUTS}
    assert sorted((r.batch, r.symbol) for r in rows["valid"].collect()) == [(0, "A"), (0, "B"), (0, "E"), (1, "A"), (1, "B"), (1, "E"), (2, "E")]
    assert sorted((r.batch, r.SYMBOL, r.OPEN, r.error) for r in rows["rejected"].collect()) == [
        (0, "C", "x", "OPEN must be numeric"), (0, "F", "100", "Unsupported NSE series code: ZZ"), (1, "C", "x", "OPEN must be numeric"), (2, "F", "100", "Unsupported NSE series code: ZZ")]
    assert sorted((r.batch, r.symbol, r.reason) for r in rows["refused"].collect()) == [(b, "D", "null_not_allowed field=delivery_qty") for b in (0, 1)]
    assert sorted((r.batch, r.target_record_key, r.impact_level) for r in rows["incidents"].collect()) == [(0, "D", "MEDIUM"), (1, "D", "MEDIUM")]
    versions = sorted((r.batch, str(r.trade_date), r.row_count, r.created, r.previous_checksum is None) for r in rows["versions"].collect())
    assert versions == [(0, "2026-06-25", 1, True, True), (0, "2026-06-26", 2, True, True), (1, "2026-06-25", 1, True, False), (2, "2026-06-25", 1, False, False)]
    assert sorted((r.batch, r.symbol) for r in rows["rows"].collect()) == [(0, "A"), (0, "B"), (0, "E"), (1, "E")]
    assert [r.pipeline_run_id for r in rows["runs"].orderBy("pipeline_run_id").collect()] == ["NSE_EOD|2026-06-25|0", "NSE_EOD|2026-06-25|1", "NSE_EOD|2026-06-25|2", "NSE_EOD|2026-06-26|0", "NSE_EOD|2026-06-26|1"]
    ends = {r.pipeline_run_id: r.metrics_payload for r in rows["events"].where("event_type = 'END'").collect()}
    assert '"updated": false' in ends["NSE_EOD|2026-06-26|1"].replace('":f', '": f') and len(ends) == 5
    last = rows["manifest"].where("trade_date = '2026-06-25'").orderBy("batch").collect()
    assert last[0].current_checksum == last[2].current_checksum == last[1].previous_checksum


@pytest.mark.parametrize("at", ["versions", "commits"])
def test_batch_cut_off_between_writes(spark, tmp_path, monkeypatch, at):
    whole, cut = tmp_path / "whole", tmp_path / "cut"
    for base in (whole, cut):
        base.mkdir()
        deliver(base / "in", "1.csv", *FIRST)
        run(spark, base)
        deliver(base / "in", "2.csv", row("A", px="3"), row("E", day="2026-06-25"))
    run(spark, whole)
    before, kept = everything(spark, f"{cut}/out"), connector.write

    def killed(rows, out, name, number):
        if name == at:
            raise OSError("killed")
        return kept(rows, out, name, number)

    monkeypatch.setattr(connector, "write", killed)
    with pytest.raises(Exception, match="killed"):
        run(spark, cut)
    assert everything(spark, f"{cut}/out") == before
    monkeypatch.setattr(connector, "write", kept)
    run(spark, cut)
    assert everything(spark, f"{cut}/out") == everything(spark, f"{whole}/out")


def test_other_headers_leave_no_marker(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text(",".join([*bhavcopy.NSE_HEADERS[::-1], "DAY"]) + "\n" + ",".join(row("A")) + "\n")
    with pytest.raises(Exception):
        run(spark, tmp_path)
    assert not (tmp_path / "out" / "commits").exists()
