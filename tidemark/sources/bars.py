"""Bars from facts: one partial and one final aggregation by symbol and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bars(facts: DataFrame, symbol: Column, time: Column, price: Column, volume: Column, order: Column, period: str = "day") -> DataFrame:
    """(symbol, day, open, high, low, close, volume, trades): first and last follow ``order``, which must be unique within a
    symbol and period; ``period`` is a unit of date_trunc."""
    rows = facts.select(symbol.alias("symbol"), F.date_trunc(period, time).alias("day"), price.cast("double").alias("p"), volume.cast("double").alias("v"), order.alias("o"))
    return rows.groupBy("symbol", "day").agg(
        F.min_by("p", "o").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"),
        F.sum("v").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )


def vwap(facts: DataFrame, symbol: Column, time: Column, amount: Column, quantity: Column, period: str = "day") -> DataFrame:
    """(symbol, day, close, volume): amount over quantity, which needs no order."""
    rows = facts.select(symbol.alias("symbol"), F.date_trunc(period, time).alias("day"), amount.alias("a"), quantity.alias("q"))
    return rows.groupBy("symbol", "day").agg((F.sum("a") / F.sum("q")).alias("close"), F.sum("q").alias("volume")).where("volume > 0")


def resample(daily: DataFrame, period: str = "week") -> DataFrame:
    """Longer bars from shorter ones."""
    held = daily.withColumn("__from", F.col("day")).withColumn("day", F.date_trunc(period, "day"))
    return held.groupBy("symbol", "day").agg(
        F.min_by("open", "__from").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "__from").alias("close"),
        F.sum("volume").alias("volume"),
    )


# The driver's tables as markets.


def order_bars(orders: DataFrame, period: str = "day") -> DataFrame:
    return bars(orders, F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1.0), F.col("o_orderkey"), period)


def event_bars(events: DataFrame, period: str = "hour") -> DataFrame:
    return bars(events, F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1.0), F.col("event_id"), period)


def lineitem_vwap(lineitem: DataFrame, period: str = "day") -> DataFrame:
    return vwap(lineitem, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), period)


def lineitem_trades(lineitem: DataFrame) -> DataFrame:
    """(l_orderkey, symbol, side, quantity, price) of every line."""
    return lineitem.select(
        "l_orderkey",
        F.col("l_partkey").cast("string").alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
