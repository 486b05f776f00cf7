"""Date and time columns: trade dates, IST deadlines, weekday arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"
# --- fixed values -----------------------------------------------------------
TRADE_DATE_FORMATS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
]
IST = "Asia/Kolkata"
# ----------------------------------------------------------------------------


def parse_trade_date(c: Column) -> Column:
    """First matching of the four exchange date layouts, else null."""
    text = F.trim(c)
    # month names match in any case
    parts = F.split(text, "-")
    named = F.concat_ws("-", F.get(parts, F.lit(0)), F.initcap(F.get(parts, F.lit(1))), F.get(parts, F.lit(2)))
    tries = [
        F.when(text.rlike(shape), F.try_to_timestamp(named if "MMM" in fmt else text, F.lit(fmt))).cast("date")
        for fmt, shape in TRADE_DATE_FORMATS
    ]
    return F.coalesce(*tries)


def open_end(c: Column) -> Column:
    """Validity end with null meaning for ever."""
    return F.coalesce(c, F.lit(OPEN_END).cast("date"))


def open_start(c: Column) -> Column:
    return F.coalesce(c, F.lit("0001-01-01").cast("date"))


def event_ts_default(day: Column) -> Column:
    """Market close, 15:30 IST of the trade date, as a UTC instant."""
    return F.to_utc_timestamp(F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" 15:30:00"))).cast("timestamp"), IST)


def ist_deadline(day: Column, hhmm: Column) -> Column:
    """``hh:mm`` IST of a date as a UTC instant."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(" "), hhmm, F.lit(":00"))), IST)


def subtract_trading_days(day: Column, n: int) -> Column:
    """``n`` weekdays back (no holiday calendar), closed form.

    A weekend day is first moved back to Friday, counting as one step when n > 0;
    from a weekday, n steps are n // 5 weeks plus a rest that skips one weekend
    when it passes Monday.
    """
    if n == 0:
        return day
    wd = F.weekday(day)
    shift = F.when(wd == 5, 1).when(wd == 6, 2).otherwise(0)
    left = F.when(wd >= 5, F.lit(n - 1)).otherwise(F.lit(n))
    base_wd = F.least(wd, F.lit(4))
    rest = F.pmod(left, F.lit(5))
    weeks = (left - rest) / 5
    extra = F.when(rest > base_wd, 2).otherwise(0)
    return F.date_sub(day, (shift + weeks * 7 + rest + extra).cast("int"))


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def period_to_start_date(period: Column, end: Column) -> Column:
    """``Ny`` = 365 N days, ``Nmo`` = 30 N, ``Nd`` = N, anything else 365."""
    text = F.lower(period)
    n = F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.lit(1))
    days = F.when(text.endswith("y"), n * 365).when(text.endswith("mo"), n * 30).when(text.endswith("d"), n).otherwise(365)
    return F.date_sub(end, days)


def duration_text(start: Column, end: Column, as_of: Column) -> Column:
    """``42s``, ``3m 5s`` or ``2h 7m``; an open run lasts until ``as_of``."""
    secs = F.floor(
        (F.unix_micros(F.coalesce(end, as_of)) - F.unix_micros(start)) / F.lit(1_000_000)
    ).cast("long")
    mins = F.floor(secs / 60).cast("long")
    hours = F.floor(mins / 60).cast("long")
    return (
        F.when(start.isNull(), "duration unavailable")
        .when(secs < 60, F.concat(secs.cast("string"), F.lit("s")))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit("m "), (secs - mins * 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), (mins - hours * 60).cast("string"), F.lit("m")))
    )


def date_window_guard(start: dt.date | None, end: dt.date | None) -> None:
    """A reversed window is a caller error."""
    if start is not None and end is not None and start > end:
        raise ValueError("from_date must be on or before to_date")


def retry_delay_schedule(attempt: Column, initial: float = 5.0, cap: float = 300.0) -> Column:
    """Seconds to wait after a failed attempt: doubling, capped."""
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(cap))
