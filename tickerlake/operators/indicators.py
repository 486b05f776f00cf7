"""Price indicators and CAPM.

Ordered windows here run over one instrument's bars.  A bar table has one row per
instrument and day, so such a window is bounded by the calendar, whatever number
of raw trades stood behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from tickerlake.functions import numeric
from tickerlake.operators import recursion

TRADING_DAYS = 252


def pct_change(c: Column, w: WindowSpec) -> Column:
    """c_t / c_(t-1) - 1."""
    return numeric.safe_ratio(c, F.lag(c).over(w)) - 1


def _full(c: Column, n: int, w: WindowSpec) -> tuple[WindowSpec, Column]:
    frame = w.rowsBetween(-(n - 1), 0)
    return frame, F.count(c).over(frame) == n


def sma(c: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the last n rows, null until n are there."""
    frame, full = _full(c, n, w)
    return F.when(full, F.avg(c).over(frame))


def rsi(df: DataFrame, close: str, keys: list[str], order: str, n: int = 14) -> DataFrame:
    """Add ``rsi`` from simple means of gains and losses; null when losses are 0."""
    w = W.partitionBy(*keys).orderBy(order)
    delta = F.col(close) - F.lag(close).over(w)
    df = df.withColumn("_d", delta)
    frame, full = _full(F.col("_d"), n, w)
    gain = F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(frame)
    loss = F.avg(-F.least(F.col("_d"), F.lit(0.0))).over(frame)
    rs = numeric.safe_ratio(gain, F.nullif(loss, F.lit(0.0)))
    # greatest/least skip nulls, so the first row must not count as a zero move
    return df.withColumn("rsi", F.when(full, 100 - 100 / (1 + rs))).drop("_d")


def bollinger(c: Column, w: WindowSpec, n: int = 20) -> tuple[Column, Column]:
    """Mean of n rows plus and minus two sample deviations."""
    frame, full = _full(c, n, w)
    mean, dev = F.avg(c).over(frame), F.stddev_samp(c).over(frame)
    return F.when(full, mean + 2 * dev), F.when(full, mean - 2 * dev)


def ema(df: DataFrame, keys: list[str], order: str, c: str, spans: dict[str, int]) -> DataFrame:
    """Add one recursive mean per entry of ``spans`` (alpha 2/(span+1), seeded by the first value).

    A null value keeps the mean as it is and lets its weight fade, as often as nulls follow each other; nulls before
    the first value give null.  Rows of a key stand in ``order``, equal ones in any order.
    """
    return recursion.sliced(df, keys, order, c, recursion.Means(spans))


def macd(df: DataFrame, keys: list[str], order: str, c: str) -> DataFrame:
    """Add ``macd`` = EMA12 - EMA26 and ``signal`` = EMA9 of it."""
    return recursion.sliced(df, keys, order, c, recursion.Macd())


def annualized_drift(prices: DataFrame, keys: list[str], order: str, close: str) -> DataFrame:
    """Mean period return times 252, per key."""
    w = W.partitionBy(*keys).orderBy(order)
    return prices.withColumn("_r", pct_change(F.col(close), w)).groupBy(*keys).agg((F.avg("_r") * TRADING_DAYS).alias("drift"))


def volume_footprint(prices: DataFrame, keys: list[str], order: str, volume: str, n: int = 20) -> DataFrame:
    """Mean volume of the last n rows over the mean of all (at least 1)."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    recent = F.when(F.row_number().over(w) <= n, F.col(volume))
    return prices.withColumn("_v", recent).groupBy(*keys).agg(
        (F.avg("_v") / F.greatest(F.avg(volume), F.lit(1.0))).alias("footprint")
    )


def period_change(prices: DataFrame, keys: list[str], order: str, close: str) -> DataFrame:
    """Last close over first close minus one; null when the first is zero."""
    return prices.groupBy(*keys).agg(
        (numeric.safe_ratio(F.max_by(close, order), F.min_by(close, order)) - 1).alias("change")
    )


def combine_series(long: DataFrame, label: str, labels: list[str], date: str = "date", close: str = "close") -> DataFrame:
    """Full outer alignment of many series: one column per label, one row per date."""
    return long.groupBy(date).pivot(label, labels).agg(F.max(close))


def asset_market_join(asset: DataFrame, market: DataFrame) -> DataFrame:
    """Align two price series by date: columns asset and market."""
    return asset.withColumnRenamed("close", "asset").join(market.select("date", F.col("close").alias("market")), "date")


def _aligned_returns(asset: DataFrame, market: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("date")
    both = asset_market_join(asset, market)
    return both.select(
        *keys, "date", pct_change(F.col("asset"), w).alias("ra"), pct_change(F.col("market"), w).alias("rm")
    ).where("ra is not null and rm is not null")


def _beta() -> Column:
    return F.try_divide(F.covar_samp("ra", "rm"), F.nullif(F.var_samp("rm"), F.lit(0.0)))


def covariance_beta(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Sample covariance over sample variance of columns ra and rm."""
    return returns.groupBy(*keys).agg(_beta().alias("beta"))


def capm(asset: DataFrame, market: DataFrame, keys: list[str], rf: float, em: float) -> DataFrame:
    """beta, alpha and expected return; without a beta its terms drop out."""
    r = _aligned_returns(asset, market, keys)
    stats = r.groupBy(*keys).agg(_beta().alias("beta"), F.avg("ra").alias("ma"), F.avg("rm").alias("mm"))
    daily = rf / TRADING_DAYS
    pull = F.coalesce(F.col("beta") * (F.col("mm") - daily), F.lit(0.0))
    return stats.select(
        *keys, "beta",
        ((F.col("ma") - daily - pull) * TRADING_DAYS).alias("alpha"),
        (rf + F.coalesce(F.col("beta") * (em - rf), F.lit(0.0))).alias("expected_return"),
    )


def tail_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows of a series, in order."""
    return df.orderBy(*[F.desc(o) for o in order]).limit(n).orderBy(*order)


def tail_each(df: DataFrame, n: int, keys: list[str], order: str) -> DataFrame:
    """The last n rows of every key's series."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_at", rank).where(F.col("_at") <= n).drop("_at")


def head_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)
