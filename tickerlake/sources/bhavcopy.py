"""Daily exchange price files (CSV, plain or zipped)."""

from __future__ import annotations

import csv
import datetime as dt
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake.functions import numeric
from tickerlake.operators import validate

# --- fixed values -----------------------------------------------------------
NSE_HEADERS = ["SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "TOTTRDQTY", "DELIV_QTY", "TIMESTAMP"]
BSE_HEADERS = ["SC_CODE", "SC_NAME", "SC_GROUP", "OPEN", "HIGH", "LOW", "CLOSE", "NO_OF_SHRS", "DELIV_QTY", "DT_TM"]
# field of the row -> header, per exchange
FIELDS = {
    "NSE": {"symbol": "SYMBOL", "series": "SERIES", "volume": "TOTTRDQTY", "timestamp": "TIMESTAMP"},
    "BSE": {"symbol": "SC_NAME", "series": "SC_GROUP", "volume": "NO_OF_SHRS", "timestamp": "DT_TM"},
}
# ----------------------------------------------------------------------------

EMIT_ROWS = 50_000  # rows per emitted Arrow batch, about
BLOCK_BYTES = 8 << 20  # of CSV that are parsed at once; a longer row is an error


def _wanted(trade_date: dt.date | str) -> Column:
    return F.col(trade_date).cast("date") if isinstance(trade_date, str) else F.lit(trade_date)


def check_rows(df: DataFrame, exchange: str, trade_date: dt.date | str, lead: Column | None = None) -> DataFrame:
    """Typed columns plus ``error``: the first refusal of each row, in field order."""
    name = FIELDS[exchange]
    raw = {**{k: k.upper() for k in ("open", "high", "low", "close")}, "volume": name["volume"], "delivery_qty": "DELIV_QTY"}
    series = validate.require_text(F.col(name["series"]))
    read = F.struct(
        validate.require_text(F.col(name["symbol"])).alias("_symbol"), series.alias("_series"), validate.map_series(series, exchange).alias("_kind"),
        *[numeric.parse_decimal(F.col(c)).alias(f"_{k}") for k, c in raw.items()], validate.parse_trade_date(F.col(name["timestamp"])).alias("_timestamp"))
    # a generator of one row: fields are parsed once, as the optimizer copies no expression from behind it into the checks and filters
    parsed = df.select("*", F.inline(F.array(read)))
    value = {k: F.col(f"_{k}") for k in raw}
    px = {k: validate.non_negative(value[k]) for k in ("open", "high", "low", "close")}
    errors = [
        *([lead] if lead is not None else []),
        *[validate.number_error(value[k], k.upper()) for k in px],
        validate.ohlc_bounds_raw(px["open"], px["high"], px["low"], px["close"]),
        F.when(F.col("_symbol").isNull(), f"{name['symbol']} is required"),
        F.when(F.col("_series").isNull(), f"{name['series']} is required"),
        F.when(F.col("_kind").isNull(), F.concat(F.lit(f"Unsupported {exchange} series code: "), F.col("_series"))),
        validate.number_error(value["volume"], name["volume"]),
        F.when(~validate.is_blank(F.col("DELIV_QTY")), validate.number_error(value["delivery_qty"], "DELIV_QTY")),
        validate.day_error(F.col("_timestamp"), F.col(name["timestamp"]), _wanted(trade_date), name["timestamp"]),
    ]
    return parsed.withColumns({
        "symbol": F.col("_symbol"), "series": F.col("_kind"), **px, "volume": validate.non_negative(value["volume"]),
        "delivery_qty": validate.non_negative(value["delivery_qty"]), "timestamp": F.col("_timestamp"),
        "error": validate.first_error(*errors)}).drop("_symbol", "_series", "_kind", *[f"_{k}" for k in raw], "_timestamp")


ROW = ["symbol", "series", "open", "high", "low", "close", "volume", "delivery_qty", "timestamp"]


def _split(checked: DataFrame, mode: str, headers: list[str], keep: list[str]) -> DataFrame | tuple[DataFrame, DataFrame]:
    if mode == "failfast":
        return validate.fail_fast(checked).select(*keep, *ROW)
    if mode != "quarantine":
        raise ValueError("mode is failfast or quarantine")
    return checked.where("error is null").select(*keep, *ROW), checked.where("error is not null").select(*keep, *headers, "error")


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> files that begin with it.  One line a file comes back; empty files have none."""
    at = F.struct(F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    first = lines.where("at.s = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found: dict[str, list[str]] = {}
    for r in first.orderBy("file").toLocalIterator():
        found.setdefault(r.header, []).append(r.file)
    return found


def _read_csv(spark: SparkSession, path: str, needed: list[str], label: str) -> DataFrame:
    """All files of a folder as text columns, each file by its own header line; a file without a needed header fails.

    Spark takes one header for all files of a read, so files are read in groups of one header.
    """
    groups = []
    for header, files in sorted(_headers(spark, path).items()):
        names = [n.strip() for n in next(csv.reader([header.lstrip("\ufeff")]))]
        validate.require_columns(spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names)), needed, label)
        # all fields stay text: schema inference would read every file twice
        groups.append(spark.read.option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(files))
    if not groups:
        return spark.createDataFrame([], ", ".join(f"{h} string" for h in needed))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), groups)


def nse_rows(df: DataFrame, trade_date: dt.date | str, mode: str = "failfast", keep: list[str] | None = None):
    """Check rows that carry the NSE headers as text columns."""
    return _split(check_rows(df, "NSE", trade_date), mode, NSE_HEADERS, keep or [])


def scan_nse_bhavcopy(spark: SparkSession, path: str, trade_date: dt.date | str, mode: str = "failfast", keep: list[str] | None = None):
    """NSE file to nine typed columns.

    ``trade_date`` is the requested day, or the name of a column with it for
    back-fills over many files.  ``failfast`` fails the job on the first bad row;
    ``quarantine`` returns (valid, rejected with error).
    """
    return nse_rows(_read_csv(spark, path, NSE_HEADERS, "required NSE"), trade_date, mode, keep)


def bse_rows(df: DataFrame, trade_date: dt.date | str, isin_map: DataFrame, mode: str = "failfast", keep: list[str] | None = None):
    """Check rows with the BSE headers; each scrip code needs an ISIN mapping.

    ``isin_map``: alias_symbol (scrip code), isin_primary.
    """
    code = validate.require_text(F.col("SC_CODE"))
    known = isin_map.select(F.upper("alias_symbol").alias("_code")).distinct().withColumn("_mapped", F.lit(True))
    joined = df.withColumn("_code", code).join(known, "_code", "left")
    lead = F.when(F.col("_code").isNull(), "SC_CODE is required").when(
        F.col("_mapped").isNull(), F.concat(F.lit("Missing ISIN mapping for BSE scrip code "), F.col("_code")))
    return _split(check_rows(joined, "BSE", trade_date, lead), mode, BSE_HEADERS, keep or [])


def scan_bse_bhavcopy(spark: SparkSession, path: str, trade_date: dt.date | str, isin_map: DataFrame, mode: str = "failfast", zipped: bool = False, keep: list[str] | None = None):
    """BSE file to nine typed columns; ``zipped`` reads whole payloads, else plain CSV."""
    df = read_zipped_csv(spark, path, BSE_HEADERS + [k for k in keep or []]) if zipped else _read_csv(spark, path, BSE_HEADERS, "required BSE")
    validate.require_columns(df, BSE_HEADERS, "required BSE")
    return bse_rows(df, trade_date, isin_map, mode, keep)


SMALL = 64 << 10  # bytes of an unpacked CSV that is split in Python: opening an Arrow reader costs more than its rows


def _unpacked(content: bytes) -> bytes | None:
    """The first CSV member of a zip if it is small and plainly deflated or stored; None for any other."""
    member = next((m for m in zipfile.ZipFile(io.BytesIO(content)).infolist() if m.filename.lower().endswith(".csv")), None)
    if member is None or member.file_size > SMALL or member.flag_bits & 1 or member.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None
    start = member.header_offset
    name, extra = struct.unpack_from("<HH", content, start + 26)
    packed = content[start + 30 + name + extra :][: member.compress_size]
    try:
        data = packed if member.compress_type == zipfile.ZIP_STORED else zlib.decompress(packed, -15)
    except zlib.error:
        return None
    return data if len(data) == member.file_size and zlib.crc32(data) == member.CRC else None  # what is damaged fails where it is read whole


def _small_rows(content: bytes, columns: list[str]) -> list[list[str | None]] | None:
    """The wanted columns of a small CSV payload without quotes, whose rows are even; None for any other."""
    if len(content) > SMALL:
        return None
    if content[:2] == b"PK":
        content = _unpacked(content)
        if content is None:
            return None
    if b'"' in content or b"\r" in content:
        return None
    header, *lines = content.decode("utf-8-sig").split("\n")
    names = header.split(",")
    rows = [line.split(",") for line in lines if line]
    if not header or len(set(names)) < len(names) or any(len(row) != len(names) for row in rows):
        return None
    places = [names.index(c) if c in names else None for c in columns]
    return [[None if p is None else row[p] for row in rows] for p in places]


def _member(content: bytes) -> io.BufferedIOBase:
    data = io.BytesIO(content)
    if content[:2] != b"PK":
        return data
    z = zipfile.ZipFile(data)
    names = [n for n in z.namelist() if n.lower().endswith(".csv")]
    if not names:
        raise ValueError("archive does not contain a CSV payload")
    return z.open(names[0])  # unpacked as it is read


def _csv_batches(content: bytes, columns: list[str]) -> Iterator[list[pa.Array]]:
    """The wanted columns of a CSV payload, block by block; other columns are not built."""
    uneven: list[str] = []

    def put_aside(row: pacsv.InvalidRow) -> str:
        uneven.append(row.text)
        return "skip"

    stream = io.BufferedReader(_member(content))
    if not stream.peek(1):
        return
    reader = pacsv.open_csv(
        stream, read_options=pacsv.ReadOptions(block_size=BLOCK_BYTES), parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=put_aside),
        convert_options=pacsv.ConvertOptions(include_columns=columns, column_types={c: pa.string() for c in columns}, include_missing_columns=True, strings_can_be_null=False))
    for batch in reader:
        yield batch.columns
    if uneven:  # rows with too few or too many fields: missing ones are null, further ones have no name
        header = next(csv.reader(io.TextIOWrapper(_member(content), encoding="utf-8-sig", newline="")))
        named = [dict(zip(header, row)) for row in csv.reader(uneven)]
        yield [pa.array([row.get(c) for row in named], pa.string()) for c in columns]


def unzip_csv(payloads: DataFrame, columns: list[str]) -> DataFrame:
    """Payloads (path, content) to text rows with the given columns.

    A payload that begins with PK is a zip whose first CSV member counts; any other
    is CSV itself.  One payload is one exchange's file of a day, so it fits a task;
    payloads spread over tasks.  Columns a file lacks are null, an empty payload has no rows.
    """
    schema = pa.schema([(c, pa.string()) for c in ["path", *columns]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in schema]  # rows of small payloads, by column
        blocks: list[pa.RecordBatch] = []  # rows of others
        waiting = size = 0

        def emitted() -> pa.RecordBatch:
            plain = pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in held], schema=schema)
            out = pa.concat_batches([*blocks, plain])
            blocks.clear()
            for column in held:
                column.clear()
            return out

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                small = _small_rows(content, columns)
                if small is not None:
                    n = len(small[0])
                    held[0] += [path] * n
                    for column, values in zip(held[1:], small):
                        column += values
                    waiting, size = waiting + n, size + sum(map(len, filter(None, chain(*small))))
                else:
                    for found in _csv_batches(content, columns):
                        n = len(found[0])
                        block = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), n), *found], schema=schema)
                        blocks.append(block)
                        waiting, size = waiting + n, size + block.nbytes
                        if waiting >= EMIT_ROWS or size >= BLOCK_BYTES:
                            yield emitted()
                            waiting = size = 0
                if waiting >= EMIT_ROWS or size >= BLOCK_BYTES:
                    yield emitted()
                    waiting = size = 0
        if waiting:
            yield emitted()

    return payloads.select("path", "content").mapInArrow(rows, "path string, " + ", ".join(f"`{c}` string" for c in columns))


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Zip or CSV payload files to text rows with the given columns."""
    return unzip_csv(spark.read.format("binaryFile").load(path), columns)


def write_zipped_csv(rows: DataFrame, path: str, member: str = "EQ.CSV") -> None:
    """Text columns as zip files of one CSV member; each Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``) gives a file.

    Nulls are written as empty fields.  Spark's text writer ends a file with a line end: it is the archive's comment.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.comment = b"\n"
                with z.open(member, "w") as out:
                    pacsv.write_csv(batch, out, pacsv.WriteOptions(quoting_style="needed"))
            yield pa.RecordBatch.from_pydict({"value": pa.array([buffer.getvalue()[:-1]], pa.binary())})

    zips = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]).mapInArrow(pack, "value binary")
    zips.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
