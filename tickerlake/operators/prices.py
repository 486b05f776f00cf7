"""Corporate-action adjustment, price history and raw-to-curated normalization."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tickerlake import session
from tickerlake.functions import dates, numeric
from tickerlake.operators import breaker, identity, merge, timejoin

# --- fixed values -----------------------------------------------------------
RATIO_ACTIONS = ["SPLIT", "BONUS", "RIGHTS"]
ACTION_TYPES = ["SPLIT", "BONUS", "RIGHTS", "DIVIDEND", "MERGER", "DEMERGER", "DELISTING"]
HOME_CURRENCY = "INR"
OUTLIER = ("ADJUSTED_CLOSE_CIRCUIT_BREAKER", "adjusted_close_outlier")  # rule code and reason of the circuit breaker
# ----------------------------------------------------------------------------


def asof_dividend_close(actions: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``prior_close``: the latest close strictly before the ex-date."""
    closes = prices.select("instrument_id", F.col("trade_date").alias("ex_date"), "close_px")
    return timejoin.asof_join(actions, closes, ["instrument_id"], "ex_date", F.col("close_px"), True, "prior_close")


def _factor(prior_close: Column) -> Column:
    """What one action multiplies earlier closes by."""
    kind = F.upper(F.trim("action_type"))
    ratio = numeric.safe_ratio(F.col("action_ratio_den").cast("double"), F.col("action_ratio_num").cast("double"))
    prior = prior_close.cast("double")
    paid = numeric.safe_ratio(prior - F.col("action_value").cast("double"), prior)
    return (
        F.when(kind.isin(RATIO_ACTIONS), F.coalesce(ratio, F.lit(1.0)))
        .when((kind == "DIVIDEND") & (prior > 0) & (paid > 0), paid)
        .otherwise(F.lit(1.0))
    )


def action_factor(actions: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``factor`` to each action."""
    return asof_dividend_close(actions, prices).withColumn("factor", _factor(F.col("prior_close")))


def factor_product(factors: DataFrame) -> DataFrame:
    """(instrument_id, factor): product of an instrument's action factors."""
    return factors.groupBy("instrument_id").agg(F.product("factor").alias("factor"))


def actions_after_date(prices: DataFrame, actions: DataFrame, window_start: dt.date | None = None) -> DataFrame:
    """Add ``later_actions``: how many actions lie strictly after the trade date."""
    acts = actions if window_start is None else actions.where(F.col("ex_date") >= F.lit(window_start))
    per_day = acts.groupBy("instrument_id", F.col("ex_date").alias("trade_date")).agg(F.count(F.lit(1)).alias("_x"))
    return _later(prices, per_day, F.sum("_x"), "later_actions", F.lit(0).cast("long"))


def cumulative_adjustment(prices: DataFrame, factors: DataFrame, window_start: dt.date | None = None) -> DataFrame:
    """Add ``adj_factor``: product of the factors of all later actions.

    An action on the trade date itself does not apply.  Actions are multiplied up
    per day first, then a running product goes back in time over their days.
    """
    acts = factors if window_start is None else factors.where(F.col("ex_date") >= F.lit(window_start))
    per_day = acts.groupBy("instrument_id", F.col("ex_date").alias("trade_date")).agg(F.product("factor").alias("_x"))
    return _later(prices, per_day, F.product("_x"), "adj_factor", F.lit(1.0))


def _later(prices: DataFrame, per_day: DataFrame, total: Column, out: str, empty: Column) -> DataFrame:
    """Add the total of ``per_day`` over all later days, the same between two of them: prices meet these stretches."""
    back = W.partitionBy("instrument_id").orderBy(F.desc("trade_date"))
    stretches = per_day.where("trade_date is not null").select(
        "instrument_id", F.lead("trade_date").over(back).alias("_since"), F.col("trade_date").alias("_until"), total.over(back.rowsBetween(W.unboundedPreceding, 0)).alias(out))
    known = F.col("instrument_id").isNotNull() & F.col("trade_date").isNotNull()
    return timejoin.at_segment(prices, stretches, ["instrument_id"], "trade_date").withColumn(out, F.when(known, F.coalesce(out, empty)))


def _scaled(px: Column, factor: Column) -> Column:
    """px * factor at six places, half even, in decimal arithmetic.

    The factor keeps fourteen places below 1e5, nine below 1e10, four beyond; a result that decimal(18,6) cannot
    hold is null.
    """
    tries = [F.bround(px * F.round(factor, places).try_cast(f"decimal(19,{places})"), 6).try_cast("decimal(18,6)") for places in (14, 9, 4)]
    return F.coalesce(*tries)


def adjusted_close(prices: DataFrame, actions: DataFrame, window_start: dt.date | None = None, parts: int | None = None) -> DataFrame:
    """Add ``adj_factor`` and ``adj_close_px``: close times the later action factors.

    ``prices`` is a bar table (one row per instrument and day), so prices and
    actions can share one shuffle by instrument: a pass forward in time finds the
    dividend's prior close, a pass backward multiplies the factors.  Equal actions
    of a day are counted first and raised to their number.  Instruments are dealt to ``parts`` tasks, which holds a
    task's sorts to a share of the rows; without it Spark's settings say how many.
    """
    acts = actions if window_start is None else actions.where(F.col("ex_date") >= F.lit(window_start))
    terms = ["action_type", "action_value", "action_ratio_num", "action_ratio_den"]
    acts = acts.groupBy("instrument_id", F.col("ex_date").alias("trade_date"), *terms).agg(F.count(F.lit(1)).alias("_n")).withColumn("_price", F.lit(0))
    both = prices.withColumn("_price", F.lit(1)).unionByName(acts, allowMissingColumns=True)
    if parts:
        both = both.repartition(parts, "instrument_id")  # a number that is not coalesced; the windows need no other shuffle
    # an action comes before the price of its own day going up, after it going down
    up = W.partitionBy("instrument_id").orderBy("trade_date", "_price").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("instrument_id").orderBy(F.desc("trade_date"), F.desc("_price")).rowsBetween(W.unboundedPreceding, 0)
    factor = F.when(F.col("_price") == 1, F.lit(1.0)).otherwise(F.pow(_factor(F.col("prior_close")), F.col("_n")))
    return (
        both.withColumn("prior_close", F.last("close_px", ignorenulls=True).over(up))
        .withColumn("adj_factor", F.product(factor).over(down))
        .where("_price = 1").drop("_price", "_n", "prior_close", *terms)
        .withColumn("adj_close_px", _scaled(F.col("close_px"), F.col("adj_factor")))
    )


def adjusted_close_requests(requests: DataFrame, prices: DataFrame, actions: DataFrame, instruments: DataFrame, parts: int | None = None) -> DataFrame:
    """Answer (instrument_id, as_of_date) requests; ``error`` tells why there is no value."""
    adj = adjusted_close(prices, actions, parts=parts).select("instrument_id", F.col("trade_date").alias("as_of_date"), "adj_close_px", F.lit(True).alias("_priced"))
    known = instruments.select("instrument_id", "delisting_date", F.lit(True).alias("_known"))
    error = (
        F.when(F.col("_known").isNull(), "INSTRUMENT_NOT_FOUND")
        .when(F.col("as_of_date") > F.col("delisting_date"), "DELISTED")
        .when(F.col("_priced").isNull(), "NO_PRICE_ROW")
        .when(F.col("adj_close_px").isNull(), "ADJUSTED_CLOSE_OUT_OF_RANGE")
    )
    return (
        requests.join(adj, ["instrument_id", "as_of_date"], "left")
        .join(known, "instrument_id", "left")
        .withColumn("error", error)
        .withColumn("adj_close_px", F.when(F.col("error").isNull(), F.col("adj_close_px")))
        .drop("_known", "_priced", "delisting_date")
    )


def price_history_window(
    prices: DataFrame,
    instruments: DataFrame,
    from_date: dt.date | None,
    to_date: dt.date | None,
    as_of: dt.date,
) -> DataFrame:
    """Rows inside the requested window cut to the listing life of the instrument.

    The end is the earliest of ``to_date``, ``as_of`` and the delisting date.
    """
    dates.date_window_guard(from_date, to_date)
    end = min(d for d in (to_date, as_of) if d is not None)
    life = instruments.select("instrument_id", "listing_date", "delisting_date")
    # constant bounds first: they reach the scan
    rows = prices.where(F.col("trade_date") <= F.lit(end))
    if from_date is not None:
        rows = rows.where(F.col("trade_date") >= F.lit(from_date))
    return rows.join(life, "instrument_id").where(
        (F.col("trade_date") >= dates.open_start(F.col("listing_date")))
        & (F.col("trade_date") <= dates.open_end(F.col("delisting_date")))
    ).drop("listing_date", "delisting_date")


def adjusted_prices(prices: DataFrame, adjusted: bool = True) -> DataFrame:
    """Scale open, high and low by adj_close / close; close becomes adj_close."""
    close, stored = F.col("close_px"), F.col("adj_close_px")
    if not adjusted:
        return prices.withColumn("adjusted_close_px", stored)
    adj = F.coalesce(stored, F.when(close != 0, close))
    factor = F.when(adj.isNull() | (close == 0), F.lit(1.0)).otherwise(
        numeric.safe_ratio(adj.cast("double"), close.cast("double"))
    )
    return prices.withColumns(
        {
            "open_px": _scaled(F.col("open_px"), factor),
            "high_px": _scaled(F.col("high_px"), factor),
            "low_px": _scaled(F.col("low_px"), factor),
            "close_px": F.coalesce(adj, close),
            "adjusted_close_px": adj,
        }
    )


def price_frame_close(prices: DataFrame) -> DataFrame:
    """Analyst frame: date, open, high, low, close, volume; adjusted close when present."""
    return prices.select(
        "instrument_id",
        F.col("trade_date").alias("date"),
        F.col("open_px").alias("open"),
        F.col("high_px").alias("high"),
        F.col("low_px").alias("low"),
        F.coalesce("adjusted_close_px", "close_px").alias("close"),
        "volume",
    )


def fx_convert(rows: DataFrame, fx: DataFrame, money: list[str]) -> DataFrame:
    """Convert money columns to the home currency; ``fx_missing`` where no rate exists.

    ``rows`` has currency_code and trade_date; ``fx`` has currency_code,
    trade_date and rate (home units per foreign unit), one row per pair.
    """
    ccy = F.upper(F.trim("currency_code"))
    rated = rows.withColumn("currency_code", ccy).join(
        fx.select(F.upper(F.trim("currency_code")).alias("currency_code"), "trade_date", "rate"),
        ["currency_code", "trade_date"],
        "left",
    )
    home = F.col("currency_code") == HOME_CURRENCY
    out = rated.withColumn("fx_missing", ~home & F.col("rate").isNull())
    # a generator of one row: amounts are converted once, as the optimizer copies nothing from behind it into checks and filters
    converted = [F.when(home, numeric.half_even(F.col(m), 6, 24)).otherwise(numeric.half_even(F.col(m) * F.col("rate").cast("decimal(18,6)"), 6, 24)).alias(m) for m in money]
    kept = [c for c in out.columns if c not in [*money, "rate"]]
    return out.select(*kept, F.inline(F.array(F.struct(*converted)))).select(*[c for c in out.columns if c != "rate"])


def asof_prior_close(left: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``prior_close``: the latest stored close strictly before the trade date."""
    return timejoin.asof_join(
        left, prices.select("instrument_id", "trade_date", "close_px").withColumnRenamed("close_px", "_c"),
        ["instrument_id"], "trade_date", F.col("_c"), True, "prior_close",
    )


def sequential_breaker(rows: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """Add ``breaker_ok``: adjusted close within [0.2, 5] of the last accepted close.

    A rejected row is never stored, so it is not the reference for the next day; only instruments where a row may
    fail are walked (``breaker.walked``).  Equal (day, close, adjusted close) versions are merged before the walk.
    At equal arrival times the lowest record id counts as first.  ``rows``:
    instrument_id, trade_date, close_px, adj_close_px, ingested_ts, source_record_id.
    """
    return _with_verdicts(rows, _verdicts(rows, curated))


def _verdicts(rows: DataFrame, curated: DataFrame | None) -> DataFrame:
    """(instrument_id, trade_date, close, adj, breaker_ok) of the versions that were walked."""
    cand = rows.where("instrument_id is not null and trade_date is not null and adj_close_px is not null")
    cand = cand.groupBy(
        "instrument_id", "trade_date",
        F.col("close_px").cast("double").alias("close"), F.col("adj_close_px").cast("double").alias("adj"),
    ).agg(
        F.max(F.unix_micros("ingested_ts")).alias("arrived"),
        F.min(F.unix_micros("ingested_ts")).alias("first_seen"),
        F.min("source_record_id").alias("first_id"),
    ).withColumn("is_stored", F.lit(False))
    if curated is not None:
        cand = cand.unionByName(
            curated.select(
                "instrument_id", "trade_date", F.col("close_px").cast("double").alias("close"),
                F.col("close_px").cast("double").alias("adj"),
                F.unix_micros("ingested_at").alias("arrived"), F.unix_micros("ingested_at").alias("first_seen"),
                F.lit("").alias("first_id"), F.lit(True).alias("is_stored"),
            )
        )
    cand = session.stage(cand, "breaker")  # read twice
    return breaker.walked(cand.join(_unsettled(cand), "instrument_id", "left_semi"))


def _with_verdicts(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """Add ``breaker_ok``: the verdict of a row's version; versions that were not walked pass."""
    keyed = rows.withColumn("close", F.col("close_px").cast("double")).withColumn("adj", F.col("adj_close_px").cast("double"))
    judged = F.col("instrument_id").isNotNull() & F.col("trade_date").isNotNull() & F.col("adj").isNotNull()
    ok = F.when(judged, F.coalesce("breaker_ok", F.lit(True)))
    return keyed.join(verdict, ["instrument_id", "trade_date", "close", "adj"], "left").withColumn("breaker_ok", ok).drop("close", "adj")


def _unsettled(cand: DataFrame) -> DataFrame:
    """Instruments that need the walk: on some day a version would fail against some version of the day before.

    Where every version passes against every version of its previous day, no row can be rejected whichever of
    them is stored, so that a window over days settles the instrument without Python.
    """
    own = F.when(~F.col("is_stored"), F.col("adj"))
    per_day = cand.groupBy("instrument_id", "trade_date").agg(
        F.min("close").alias("low"), F.max("close").alias("high"), F.min(own).alias("least"), F.max(own).alias("most"))
    w = W.partitionBy("instrument_id").orderBy("trade_date")
    low, high = F.lag("low").over(w), F.lag("high").over(w)
    calm = low.isNull() | F.col("least").isNull() | ((low > 0) & (F.col("least") / high >= breaker.LOW) & (F.col("most") / low <= breaker.HIGH))
    return per_day.select("instrument_id", calm.alias("calm")).where(~F.coalesce("calm", F.lit(False))).select("instrument_id").distinct()


def normalize_ohlcv_checks(rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Add ``reason``: the first failing check, null when the row passes all.

    Expects event_ts, instrument_id, fx_missing, open, high, low, close, volume
    (decimals), bad_number (some text was no number) and, when present, breaker_ok.
    """
    o, h, lo, c = (F.col(x) for x in ("open_px", "high_px", "low_px", "close_px"))
    checks = [
        (F.col("trade_date").isNull(), "INVALID_OHLCV_PAYLOAD", "bad_trade_date"),
        (F.col("event_ts") > F.lit(as_of) + F.expr("interval 1 hour"), "FUTURE_EVENT_TS", "future_event_ts"),
        (F.col("instrument_id").isNull(), "UNRESOLVED_SYMBOL", "unresolved_symbol"),
        (F.col("bad_number"), "INVALID_OHLCV_PAYLOAD", "bad_number"),
        (F.col("fx_missing"), "MISSING_FX_RATE", "missing_fx_rate"),
        (c <= 0, "INVALID_OHLCV_PAYLOAD", "close_must_be_positive"),
        ((h < lo) | (h < o) | (h < c), "INVALID_OHLCV_PAYLOAD", "high_bound_violation"),
        ((lo > o) | (lo > c), "INVALID_OHLCV_PAYLOAD", "low_bound_violation"),
    ]
    if "breaker_ok" in rows.columns:
        checks.append((~F.col("breaker_ok"), *OUTLIER))
    first = F.coalesce(*[F.when(cond, F.struct(F.lit(code).alias("rule_code"), F.lit(why).alias("reason"))) for cond, code, why in checks])
    # a generator of one row: the checks run once for both columns and every filter on them
    return rows.select("*", F.inline(F.array(first)))


def typed_feed(raw: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns of raw text rows with trade_date, event_ts, open_px to close_px, volume, turnover and bad_number.

    Fields come out of a generator of one row, so that each is parsed once.
    """
    day = F.when(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("timestamp").try_cast("date"))
    numbers = ["open", "high", "low", "close", "volume", "turnover"]
    fields = F.struct(day.alias("trade_date"), *[numeric.parse_decimal(F.col(n)).alias(f"_{n}") for n in numbers])
    parsed = raw.select("*", F.inline(F.array(fields)))
    filled = (F.coalesce(F.col("turnover"), F.lit("")) != "") & F.col("_turnover").isNull()
    bad = reduce(lambda a, x: a | x, [F.col(f"_{n}").isNull() for n in numbers[:5]], filled)
    return parsed.select(
        *kept, "trade_date", *[F.col(f"_{n}").alias(f"{n}_px") for n in numbers[:4]], F.col("_volume").alias("volume"), F.col("_turnover").alias("turnover"),
        bad.alias("bad_number"), dates.event_ts_default(F.col("trade_date")).alias("event_ts"))


def normalize_ohlcv(
    raw: DataFrame,
    instruments: DataFrame,
    exchanges: DataFrame,
    aliases: DataFrame,
    fx: DataFrame,
    actions: DataFrame,
    curated: DataFrame,
    as_of: dt.datetime,
    window_start: dt.date | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Raw text rows to (accepted rows, rejected rows with rule_code and reason).

    Resolves symbols point in time, converts currency, applies the ordered checks,
    adjusts the close and runs the breaker, for all rows in one job.  Checked rows and verdicts are written once each;
    both results join them anew.
    """
    typed = typed_feed(raw.withColumns({"source_system": F.upper(F.trim("source_system")), "raw_date": F.col("timestamp")}),
                       ["symbol", "exchange", "source_system", "currency_code", "ingested_ts", "source_record_id", "raw_date"])
    found = identity.resolve_symbol_as_of(typed.withColumn("as_of", F.col("trade_date")), instruments, exchanges, aliases).drop("as_of", "state")
    money = fx_convert(found, fx, ["open_px", "high_px", "low_px", "close_px", "turnover"])
    checked = cumulative_adjustment(normalize_ohlcv_checks(money, as_of), action_factor(actions, curated), window_start)
    cols = ["instrument_id", "trade_date", "open_px", "high_px", "low_px", "close_px", "adj_close_px", "volume",
            "turnover", "source_system", "source_record_id", "event_ts", "ingested_ts"]
    bad = ["symbol", "raw_date", "source_record_id", "rule_code", "reason"]
    adjusted = F.when(F.col("reason").isNull(), _scaled(F.col("close_px"), F.col("adj_factor")))
    # all branches start from here
    first = session.stage(checked.withColumn("adj_close_px", adjusted).select(*dict.fromkeys([*cols, *bad])), "normalize-checked")
    good = first.where("reason is null")
    verdict = session.stage(_verdicts(good, curated), "normalize-verdicts")
    # of the checks only the breaker's is left for them
    judged = _with_verdicts(good, verdict)
    accepted = judged.where("breaker_ok or breaker_ok is null").select(*cols, F.col("ingested_ts").alias("valid_from"))
    failed = {"rule_code": F.lit(OUTLIER[0]), "reason": F.lit(OUTLIER[1])}
    rejected = first.where("reason is not null").select(*bad).unionByName(judged.where("not breaker_ok").withColumns(failed).select(*bad))
    return accepted, rejected


def normalization_incidents(rejected: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Rejected rows as FAIL results and MEDIUM incidents."""
    key = F.concat_ws(":", F.coalesce("symbol", F.lit("UNKNOWN")), F.coalesce("raw_date", F.lit("UNKNOWN")))
    results = rejected.select(
        "rule_code", F.lit("market_ohlcv_1d").alias("target_table"), key.alias("target_record_key"),
        F.lit("FAIL").alias("status"), F.col("reason").alias("failure_reason"), F.lit(as_of).alias("evaluated_at"),
    )
    incidents = rejected.select(
        key.alias("target_record_key"), "rule_code", F.lit("OPEN").alias("incident_status"), F.lit("MEDIUM").alias("impact_level"),
        F.lit("DATA_ENGINEERING").alias("assigned_to"), F.lit(as_of).alias("opened_at"), F.col("reason").alias("resolution_notes"),
    )
    return results, incidents


def ingest_corporate_actions(raw: DataFrame, instruments: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Normalize type and source; split into (accepted, rejected with error)."""
    known = instruments.select("instrument_id", F.lit(True).alias("_known"))
    rows = (
        raw.withColumn("action_type", F.upper(F.trim("action_type")))
        .withColumn("source_system", F.upper(F.trim("source_system")))
        .join(known, "instrument_id", "left")
        .withColumn(
            "error",
            F.when(~F.col("action_type").isin(ACTION_TYPES), "UNSUPPORTED_ACTION_TYPE").when(F.col("_known").isNull(), "INSTRUMENT_NOT_FOUND"),
        ).drop("_known")
    )
    return (
        rows.where("error is null").drop("error").withColumn("ingested_at", F.lit(as_of)),
        rows.where("error is not null"),
    )


STORED = ["instrument_id", "trade_date", "open_px", "high_px", "low_px", "close_px", "adj_close_px", "volume", "turnover", "source_system", "source_record_id", "ingested_at"]


def curate_ohlcv(
    raw: DataFrame, instruments: DataFrame, exchanges: DataFrame, aliases: DataFrame, fx: DataFrame, actions: DataFrame, curated: DataFrame,
    as_of: dt.datetime, window_start: dt.date | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Raw rows to curated ones as one run: (curated after, DQ results, incidents, superseded rows).

    Accepted rows are merged into ``curated`` (columns of STORED; missing ones count as null), a strictly newer
    arrival replacing the stored row of its day; rejected rows become FAIL results with incidents, replaced ones
    WARN results.  Dividends are priced from ``curated`` as it was before the run.
    """
    accepted, rejected = normalize_ohlcv(raw, instruments, exchanges, aliases, fx, actions, curated, as_of, window_start)
    incoming = accepted.withColumnRenamed("ingested_ts", "ingested_at").select(*STORED)
    kinds = {f.name: f.dataType for f in incoming.schema}
    current = curated.select(*[(F.col(c) if c in curated.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in STORED])
    merged, superseded = merge.merge_ohlcv(current, incoming, as_of)
    results, incidents = normalization_incidents(rejected, as_of)
    return merged, results, incidents, superseded
