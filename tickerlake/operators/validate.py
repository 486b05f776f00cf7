"""Row validation of exchange files and contract checks, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.functions import dates, numeric, text


def require_columns(df: DataFrame, names: list[str], what: str = "required") -> None:
    """Raise when a header is missing (sorted list in the message)."""
    gone = sorted(set(names) - set(df.columns))
    if gone:
        raise ValueError(f"Missing {what} fields: {gone}")


def require_text(c: Column) -> Column:
    """Trimmed upper-case text, null when blank."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def require_non_negative_decimal(c: Column) -> Column:
    """Decimal, null when it is no number or negative."""
    return non_negative(numeric.parse_decimal(c))


def non_negative(v: Column) -> Column:
    return F.when(v >= 0, v)


def optional_non_negative_decimal(c: Column) -> Column:
    """The same; a blank is a legal null (see ``decimal_error``)."""
    return F.when(~is_blank(c), require_non_negative_decimal(c))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def decimal_error(c: Column, field: str, optional: bool = False) -> Column:
    """Why a numeric field is refused, else null."""
    bad = number_error(numeric.parse_decimal(c), field)
    return F.when(~is_blank(c), bad) if optional else bad


def number_error(v: Column, field: str) -> Column:
    """The same for a field that is parsed already."""
    return F.when(v.isNull(), f"{field} must be numeric").when(v < 0, f"{field} must be non-negative")


def ohlc_bounds_raw(o: Column, h: Column, lo: Column, c: Column) -> Column:
    """Why the four prices do not fit together, else null."""
    return F.when(h < F.greatest(o, lo, c), "HIGH must be greater than or equal to OPEN, LOW, and CLOSE").when(
        lo > F.least(o, h, c), "LOW must be less than or equal to OPEN, HIGH, and CLOSE")


def map_series(c: Column, exchange: str) -> Column:
    return text.map_series(c, exchange)


def parse_trade_date(c: Column) -> Column:
    return dates.parse_trade_date(c)


def trade_date_error(c: Column, wanted: Column, field: str) -> Column:
    return day_error(dates.parse_trade_date(c), c, wanted, field)


def day_error(d: Column, c: Column, wanted: Column, field: str) -> Column:
    """The same for a day ``d`` that is parsed already."""
    return F.when(d.isNull(), F.concat(F.lit("Unsupported trade date format: "), F.coalesce(c, F.lit("")))).when(d != wanted, f"{field} does not match requested trade date")


def field_difference(expected: Column, actual: Column) -> Column:
    """struct(missing, extra): sorted set differences of two name arrays."""
    return F.struct(F.array_sort(F.array_except(expected, actual)).alias("missing"), F.array_sort(F.array_except(actual, expected)).alias("extra"))


def _listed(names: Column) -> Column:
    return F.when(F.size(names) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']")))


_ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _typed(v: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DecimalType):
        return numeric.parse_decimal(v, t.precision, t.scale)
    if isinstance(t, T.DateType):
        return F.when(v.rlike(_ISO_DAY), v.try_cast("date"))
    return v


def _type_name(t: T.DataType) -> str:
    return {"decimal": "decimal", "date": "date"}.get(t.typeName(), "string")


def judge_contract(df: DataFrame, contract: T.StructType, row: str = "row") -> DataFrame:
    """The rows with ``reason`` (null where the contract is kept) and ``_typed``, a struct of the contract's fields.

    ``row`` is a map of field name to text, or a struct: its fields that have the contract's type already are taken as
    they are, others by their text.  Fields must be exactly those of the contract; then the first failing field in
    contract order gives the reason.
    """
    kind = df.schema[row].dataType
    given = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else None
    expected, actual = F.array(*[F.lit(f.name) for f in contract.fields]), F.map_keys(row) if given is None else F.array(*[F.lit(n) for n in given])
    diff = field_difference(expected, actual)
    drift = F.when(
        (F.size(F.array_except(expected, actual)) > 0) | (F.size(F.array_except(actual, expected)) > 0),
        F.concat(F.lit("schema_drift missing="), _listed(diff.missing), F.lit(" extra="), _listed(diff.extra)))
    value = {f.name: F.col(row)[f.name] if given is None or f.name in given else F.lit(None).cast("string") for f in contract.fields}
    taken = {f.name: value[f.name] if given and given.get(f.name) == f.dataType else _typed(value[f.name].cast("string"), f.dataType) for f in contract.fields}
    # a generator of one row: what is taken from the row is typed once, as the optimizer copies nothing from behind it into the checks
    read = df.select("*", F.inline(F.array(F.struct(
        drift.alias("_drift"), *[x for i, f in enumerate(contract.fields) for x in (value[f.name].isNull().alias(f"_none{i}"), taken[f.name].alias(f"_typed{i}"))]))))
    checks = [F.col("_drift")]
    for i, f in enumerate(contract.fields):
        if not f.nullable:
            checks.append(F.when(F.col(f"_none{i}"), f"null_not_allowed field={f.name}"))
        if not isinstance(f.dataType, T.StringType):
            checks.append(F.when(~F.col(f"_none{i}") & F.col(f"_typed{i}").isNull(), f"type_mismatch field={f.name} expected={_type_name(f.dataType)}"))
    typed = F.struct(*[F.col(f"_typed{i}").alias(f.name) for i, f in enumerate(contract.fields)])
    return read.select(*[c for c in df.columns if c != "reason"], F.coalesce(*checks).alias("reason"), typed.alias("_typed"))


def validate_contract(df: DataFrame, contract: T.StructType, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """(typed valid rows, rejected rows with ``reason``) as ``judge_contract`` parts them."""
    judged = judge_contract(df, contract, row)
    valid = judged.where("reason is null").select(*[c for c in df.columns if c != row], "_typed.*")
    return valid, judged.where("reason is not null").drop("_typed")


def normalize_history_frame(df: DataFrame) -> DataFrame:
    """History in any capitalization to date, open, high, low, close, volume.

    ``adj close`` stands in for a missing close or fills its nulls; ``datetime`` or
    ``index`` stand in for date; missing columns are null; rows without a date go.
    """
    df = df.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns])
    has = set(df.columns)
    close = [F.col(f"`{c}`").cast("string").try_cast("double") for c in ("close", "adj close") if c in has]
    day = next((c for c in ("date", "datetime", "index") if c in has), None)
    num = {c: F.col(c).cast("string").try_cast("double") if c in has else F.lit(None).cast("double") for c in ("open", "high", "low", "volume")}
    keep = [c for c in ("instrument_id",) if c in has]
    out = df.select(
        *keep, (F.col(day).cast("string").try_cast("timestamp") if day else F.lit(None).cast("timestamp")).alias("date"),
        num["open"].alias("open"), num["high"].alias("high"), num["low"].alias("low"),
        (F.coalesce(*close) if close else F.lit(None).cast("double")).alias("close"), num["volume"].alias("volume"))
    return out.where("date is not null").orderBy(*keep, "date")


def first_error(*errors: Column) -> Column:
    return F.coalesce(*errors)


def fail_fast(df: DataFrame, error: str = "error") -> DataFrame:
    """Fail the job on the first refused row, as a whole-file reader does."""
    return df.where(F.when(F.col(error).isNull(), True).otherwise(F.raise_error(F.col(error)).cast("boolean"))).drop(error)
