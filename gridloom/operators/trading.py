"""Moving-average signals and their back-test, by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars(trades: DataFrame, symbol: str, ts: str, price: str, order: str, unit: str = "day") -> DataFrame:
    """symbol, ts, open, high, low, close, volume of each day, or other unit; ties in time by `order`."""
    at = F.struct(F.col(ts), F.col(order))
    stamp = F.date_trunc(unit, F.col(ts).cast("timestamp")).cast("timestamp_ntz")
    return trades.groupBy(F.col(symbol).alias("symbol"), stamp.alias("ts")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume")
    )


def _by_time() -> Window:
    return Window.partitionBy("symbol").orderBy("ts")


def sma_signal(df: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """sma_fast, sma_slow (NULL until their windows are full) and signal: 1 while the fast mean is above the slow one."""
    mean = lambda n: F.when(F.count("close").over(_by_time().rowsBetween(1 - n, 0)) >= n, F.avg("close").over(_by_time().rowsBetween(1 - n, 0)))
    df = df.withColumns({"sma_fast": mean(fast), "sma_slow": mean(slow)})
    return df.withColumn("signal", F.when(F.col("sma_fast") > F.col("sma_slow"), 1).otherwise(0))


def backtest(prices: DataFrame, signals: DataFrame, fee_bps: float = 1.0) -> DataFrame:
    """ret, net and curve: the compounded return of holding while the signal was 1 on the bar before, less fees on each change.

    A bar without a signal counts as 0; the first bar's net and curve are NULL.
    """
    df = prices.join(signals.select("symbol", "ts", "signal"), ["symbol", "ts"], "left").withColumn("signal", F.coalesce("signal", F.lit(0)))
    w = _by_time()
    ret = F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))
    turn = F.abs(F.col("signal") - F.lag("signal").over(w))
    df = df.withColumns({"ret": ret, "net": F.lag("signal").over(w) * ret - turn * fee_bps / 10_000})
    return df.withColumn("curve", F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def signal_edges(df: DataFrame, warm_up: int = 50) -> DataFrame:
    """Rows where the signal changes: side buy or sell; symbols with fewer bars than the warm-up have none."""
    before = F.lag("signal").over(_by_time())
    side = F.when((before == 0) & (F.col("signal") == 1), "buy").when((before == 1) & (F.col("signal") == 0), "sell")
    enough = F.count("*").over(Window.partitionBy("symbol")) >= warm_up
    return df.withColumns({"side": side, "_e": enough}).where(F.col("side").isNotNull() & F.col("_e")).drop("_e")


def position_size(equity: Column, price: Column, fraction: float = 0.1) -> Column:
    """Whole shares for a fraction of the equity; 0 where the price is 0 or missing."""
    return F.greatest(F.coalesce(F.floor(F.try_divide(equity * fraction, price)), F.lit(0)), F.lit(0))


def stop_loss(price: Column, share: float = 0.03) -> Column:
    """Rounded half up in decimal arithmetic."""
    return F.round((price * (1 - share)).cast("decimal(18,6)"), 2).cast("double")


def with_status(orders: DataFrame, column: str, status: str) -> DataFrame:
    """Orders of a status but for case; `all` asks for every one."""
    return orders if status.lower() == "all" else orders.where(F.upper(column) == status.upper())
