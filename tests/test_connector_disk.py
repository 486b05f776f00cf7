"""What the connector's stream keeps on disk: its outputs once, packed; checked rows only until the outputs are parted."""

import datetime as dt
import hashlib
import pathlib
import uuid
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake import schemas, session
from tickerlake.operators import validate
from tickerlake.plans import on_files
from tickerlake.sources import bhavcopy
from tickerlake.streaming import connector

CONTRACT = schemas.contract_schema(schemas.__file__.replace("schemas.py", "contracts/nse_eod.json"))
STRICT = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name != "delivery_qty") for f in CONTRACT])
ROWS = 20_000


def size(*folders):
    return sum(f.stat().st_size for folder in folders for f in pathlib.Path(folder).rglob("*") if f.is_file())


@pytest.fixture
def work(tmp_path, monkeypatch):
    folder = lambda spark, label: f"{tmp_path}/work/{label}-{uuid.uuid4().hex}"
    monkeypatch.setattr(session, "work_dir", folder)
    monkeypatch.setattr(on_files, "work_dir", folder)
    return tmp_path / "work"


def test_checked_rows_go_with_their_batch(spark, tmp_path, work):
    rows = spark.range(ROWS).select(
        *[(F.concat(F.lit("S"), F.sha1(F.col("id").cast("string"))) if n == "SYMBOL" else F.lit("EQ") if n == "SERIES" else F.lit("2026-06-26") if n == "TIMESTAMP"
           else F.when(F.col("id") % 3 == 0, "x").otherwise(F.lit("7")) if n == "OPEN" else F.when(F.col("id") % 7 == 0, "").otherwise(F.lit("7")) if n == "DELIV_QTY" else F.lit("7")).alias(n)
          for n in bhavcopy.NSE_HEADERS], F.lit("2026-06-26").alias("DAY"))
    out = tmp_path / "out"
    for n in range(2):
        rows.where(f"{n} = 0 or SYMBOL > 'S8'").write.mode("append").option("header", True).csv(f"{tmp_path}/in")
        connector.stream_connector(spark, f"{tmp_path}/in", str(out), f"{tmp_path}/cp", "DAY", STRICT, dt.datetime(2026, 6, 27), rows.columns).awaitTermination()
    outputs = size(*[out / name for name in connector.OUTPUTS])
    found = Counter({name: connector.committed(spark, str(out), name).where("batch = 0").count() for name in ("valid", "rejected", "refused", "rows")})
    bad, blank = len(range(0, ROWS, 3)), len([i for i in range(0, ROWS, 7) if i % 3])
    assert found == {"valid": ROWS - bad - blank, "rejected": bad, "refused": blank, "rows": ROWS - bad - blank}
    assert outputs > 20 * ROWS and size(out, work) - outputs < outputs / 10


def test_query_packs_what_arrives(spark, work):
    on_files.stream_files(spark, "/root/testdata/sf0.001")
    (arrived,) = work.glob("nse-stream-*")
    lines = spark.read.option("header", True).csv(str(arrived)).count()
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert lines > rows and size(arrived) < 70 * lines


def test_struct_rows_like_maps(spark):
    rows = spark.createDataFrame(
        [(1, "A", Decimal("1.5"), dt.date(2026, 6, 26), "7"), (2, None, Decimal("0"), None, "x"), (3, "C", None, dt.date(2026, 6, 26), None)], "id long, a string, b decimal(24,6), c date, d string")
    amount = T.DecimalType(24, 6)
    fields = {"a": T.StringType(), "b": amount, "c": T.DateType(), "d": amount}
    for names in ("abcd", "abd", "dcba"):
        for optional in ("", "ad", "abcd"):
            contract = T.StructType([T.StructField(n, fields[n], n in optional) for n in names])
            for given in ("abcd", "abd"):
                struct = F.struct(*[F.col(n) for n in given])
                texts = F.map_from_arrays(F.array(*[F.lit(n) for n in given]), F.array(*[F.col(n).cast("string") for n in given]))
                one, other = (validate.validate_contract(rows.select("id", row.alias("row")), contract) for row in (struct, texts))
                assert one[0].orderBy("id").collect() == other[0].orderBy("id").collect() and one[0].dtypes == other[0].dtypes
                assert one[1].select("id", "reason").orderBy("id").collect() == other[1].select("id", "reason").orderBy("id").collect()


def test_digest_of_lines(spark):
    lines = [f"line {i % 40}" for i in range(100)]
    hashes = [hashlib.md5(line.encode()).hexdigest() for line in lines]
    want = hashlib.sha256(":".join(["100", *(str(sum(int(h[at : at + 15], 16) for h in hashes)) for at in (0, 16))]).encode()).hexdigest()
    df = spark.createDataFrame([(line,) for line in lines], "line string").repartition(3)
    assert df.agg(connector.content_digest(F.col("line"))).head()[0] == want
