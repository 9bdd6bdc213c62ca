"""Registered queries of the engine's own operators, and the same in DuckDB SQL.

The driver's tables play a market: order statuses, return flags and event types are symbols, and lines are trades. Results
that add floating point numbers are rounded on both sides, as the order of addition is free.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.schema import REBALANCES, VENDOR_FREQUENCY, Frequency
from ..operators import analytics, costs, quality, universe
from ..sources import bars as bar_sources
from ..sources import normalise, store
from ..streaming.bars import run_to_end

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGS = ["A", "N", "R"]
STATUSES = ["F", "O", "P"]


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: str | Column, digits: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, digits) + F.lit(0.0)
    return out.alias(name) if name else out


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder at the end, if the session still runs then."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, until the session ends."""
    held, context = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if not base and not context._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, where)
    return where


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("day"))


# Bars

ORDER_BARS = """SELECT o_orderstatus AS symbol, o_orderdate::DATE AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume, count(*) AS trades FROM orders GROUP BY ALL"""
VWAP = """SELECT l_returnflag AS symbol, l_shipdate::DATE AS day, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
    FROM lineitem GROUP BY ALL"""
ALIGNED = f"""v AS ({VWAP}), k AS (SELECT day FROM v WHERE symbol IN ('A', 'N', 'R') GROUP BY day HAVING count(*) = 3),
    c AS (SELECT symbol, day, close FROM v JOIN k USING (day) WHERE symbol IN ('A', 'N', 'R')),
    ret AS (SELECT * FROM (SELECT symbol, day, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS ret FROM c) WHERE ret IS NOT NULL)"""


def closes(spark: SparkSession, d: str) -> DataFrame:
    return dated(analytics.aligned(bar_sources.lineitem_vwap(read(spark, d, "lineitem")), FLAGS))


def returns(spark: SparkSession, d: str) -> DataFrame:
    return analytics.log_returns(closes(spark, d))


@query(ORDER_BARS)
def bars_daily_orders(spark, d):
    return dated(bar_sources.order_bars(read(spark, d, "orders")))


@query(f"SELECT symbol, day, round(close, 6) AS close, round(volume, 2) AS volume FROM ({VWAP})")
def bars_daily_lineitem_vwap(spark, d):
    return dated(bar_sources.lineitem_vwap(read(spark, d, "lineitem"))).select("symbol", "day", r("close"), r("volume", 2))


@query("""SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, arg_min(value, event_id) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, event_id) AS close, count(*) AS trades FROM events GROUP BY ALL""")
def bars_hourly_events(spark, d):
    found = bar_sources.event_bars(read(spark, d, "events"))
    return found.select("symbol", F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("hour"), "open", "high", "low", "close", "trades")


@query(f"""SELECT symbol, date_trunc('week', day)::DATE AS day, arg_min(open, day) AS open, max(high) AS high, min(low) AS low, arg_max(close, day) AS close,
    sum(volume) AS volume FROM ({ORDER_BARS}) GROUP BY ALL""")
def bars_resample_weekly(spark, d):
    return dated(bar_sources.resample(bar_sources.order_bars(read(spark, d, "orders")), "week"))


@query(f"SELECT symbol, count(*) AS row_count, min(day) AS start, max(day) AS \"end\" FROM ({ORDER_BARS}) GROUP BY symbol")
def bars_metadata(spark, d):
    return store.provenance(dated(bar_sources.order_bars(read(spark, d, "orders"))))


@query("""SELECT o_custkey, o_orderdate::DATE AS day, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) = 1""")
def dedupe_keep_first(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    return normalise.keep_first(rows, ["o_custkey", "day"], "o_orderkey")


@query("""WITH t AS (SELECT o_orderstatus AS symbol, epoch_ms(o_orderdate)::BIGINT AS ms, o_totalprice AS close, o_orderkey FROM orders)
    SELECT symbol, ms, close FROM t WHERE ms <= epoch_ms(TIMESTAMP '1996-06-30 00:00:00')
    QUALIFY row_number() OVER (PARTITION BY symbol, ms ORDER BY o_orderkey) = 1""")
def range_clip_inclusive(spark, d):
    price = F.col("o_totalprice")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    raw = read(spark, d, "orders").select(
        F.col("o_orderstatus").alias("symbol"), ms.cast("long").alias("ms"), *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("arrival"),
    )
    found = normalise.from_ccxt(raw, "1996-06-30 00:00:00+00:00")
    return found.select("symbol", F.unix_millis("timestamp").alias("ms"), "close")


# Quality

BROKEN = f"""SELECT symbol, day, open, CASE WHEN dayofyear(day) % 11 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN dayofyear(day) % 13 = 0 THEN close + 1 ELSE low END AS low,
    CASE WHEN dayofyear(day) % 17 = 0 THEN NULL WHEN dayofyear(day) % 19 = 0 THEN 'nan'::DOUBLE ELSE close END AS close,
    CASE WHEN dayofyear(day) % 23 = 0 THEN -volume ELSE volume END AS volume FROM ({ORDER_BARS})"""
GAP = "(open IS NULL OR isnan(open) OR high IS NULL OR isnan(high) OR low IS NULL OR isnan(low) OR close IS NULL OR isnan(close) OR volume IS NULL OR isnan(volume))"
CLOSE = "(close IS NOT NULL AND NOT isnan(close))"
KNOWN = "(low IS NOT NULL AND NOT isnan(low))"


def broken(spark: SparkSession, d: str) -> DataFrame:
    bars = dated(bar_sources.order_bars(read(spark, d, "orders"))).drop("trades")
    n, bad = F.dayofyear("day"), F.col("close")
    changed = {
        "high": F.when(n % 11 == 0, F.col("low") - 1).otherwise(F.col("high")),
        "low": F.when(n % 13 == 0, bad + 1).otherwise(F.col("low")),
        "close": F.when(n % 17 == 0, None).when(n % 19 == 0, F.lit(float("nan"))).otherwise(bad),
        "volume": F.when(n % 23 == 0, -F.col("volume")).otherwise(F.col("volume")),
    }
    return bars.withColumns(changed).withColumn("timestamp", F.col("day").cast("timestamp"))


@query(f"""WITH b AS ({BROKEN}) SELECT symbol, count(*) AS rows, 0::BIGINT AS not_monotonic, 0::BIGINT AS duplicate_timestamps, count_if({GAP})::BIGINT AS missing_values,
    count_if(high < low AND {KNOWN})::BIGINT AS high_below_low, count_if(high < open OR (high < close AND {CLOSE}))::BIGINT AS high_below_body,
    count_if((low > open AND {KNOWN}) OR (low > close AND {CLOSE} AND {KNOWN}))::BIGINT AS low_above_body, count_if(volume < 0)::BIGINT AS negative_volume FROM b GROUP BY symbol""")
def dq_violations_by_symbol(spark, d):
    return quality.violations(broken(spark, d), ("symbol",))


@query(f"WITH b AS ({BROKEN}) SELECT symbol, day FROM b WHERE {CLOSE} AND {KNOWN} AND (high < close OR low > close)")
def dq_nan_safe(spark, d):
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    return broken(spark, d).where(scalars.known((h < c) | (lo > c), h, lo, c)).select("symbol", "day")


@query("""SELECT o_orderstatus AS symbol, sum(n) AS rows, sum(n - 1) AS duplicate_timestamps FROM
    (SELECT o_orderstatus, o_orderdate, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""".replace("sum(n)", "sum(n)::BIGINT").replace("sum(n - 1)", "sum(n - 1)::BIGINT"))
def dq_duplicate_ts(spark, d):
    p = F.col("o_totalprice")
    rows = read(spark, d, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("timestamp"), *[p.alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    return quality.violations(rows, ("symbol",)).select("symbol", "rows", "duplicate_timestamps")


@query("""SELECT o_orderstatus AS symbol, count_if(back)::BIGINT AS not_monotonic FROM (SELECT o_orderstatus, coalesce(lag(o_orderdate) OVER
    (PARTITION BY o_orderstatus ORDER BY o_orderkey) > o_orderdate, false) AS back FROM orders) GROUP BY 1""")
def dq_arrival_order(spark, d):
    p = F.col("o_totalprice")
    rows = read(spark, d, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("timestamp"), *[p.alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"), "o_orderkey")
    return quality.violations(rows, ("symbol",), sequence="o_orderkey").select("symbol", "not_monotonic")


# Scalars


@query("SELECT p_partkey, translate(concat(p_name, '/', p_brand, ':', p_type), '/:\\', '---') AS safe FROM part")
def safe_symbol(spark, d):
    raw = F.concat("p_name", F.lit("/"), "p_brand", F.lit(":"), "p_type")
    return read(spark, d, "part").select("p_partkey", scalars.safe_symbol(raw).alias("safe"))


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || '.sh' ELSE lpad(((o_orderkey * 7919) % 1000000)::VARCHAR, 6, '0') END AS code FROM orders)
    SELECT o_orderkey, CASE WHEN contains(code, '.') THEN upper(code) WHEN code[1:2] IN ('60', '68', '90') THEN code || '.SH' WHEN code[1:2] IN ('00', '30', '20') THEN code || '.SZ'
    WHEN code[1:2] IN ('43', '83', '87', '88') THEN code || '.BJ' END AS listed FROM c""")
def infer_exchange(spark, d):
    k = F.col("o_orderkey")
    code = F.when(k % 5 == 0, F.concat(F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit(".sh"))).otherwise(F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"))
    return read(spark, d, "orders").select("o_orderkey", scalars.infer_exchange(code, strict=False).alias("listed"))


def _values(pairs) -> str:
    return ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in pairs)


@query(f"SELECT * FROM (VALUES {_values((f.value, VENDOR_FREQUENCY['yfinance'].get(f.value)) for f in Frequency)}) AS t(frequency, vendor)")
def frequency_map(spark, d):
    rows = spark.createDataFrame([(f.value,) for f in Frequency], "frequency string")
    return rows.select("frequency", scalars.vendor_frequency(F.col("frequency"), "yfinance").alias("vendor"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN ts END::DATE, DATE '2024-06-15') AS day FROM events")
def coerce_date(spark, d):
    at = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return read(spark, d, "events").select("event_id", scalars.coerce_date(at, F.lit("2024-06-15").cast("date")).alias("day"))


# Costs

TRADES = """t AS (SELECT l_orderkey, l_partkey::VARCHAR AS symbol, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_quantity AS q,
    l_extendedprice / l_quantity AS p, (l_extendedprice / l_quantity) * l_quantity AS n FROM lineitem)"""
BPS = "10000::DOUBLE"


def trades(spark: SparkSession, d: str) -> DataFrame:
    return bar_sources.lineitem_trades(read(spark, d, "lineitem"))


def _cost_sql(**parts: str) -> str:
    given = [f"({parts.get(c, '0::DOUBLE')})" for c in costs.COMPONENTS]
    columns = ", ".join(f"round({sql}, 8) AS {name}" for name, sql in zip(costs.COMPONENTS, given, strict=True) if name in parts)
    total = " + ".join(given)
    return f"WITH {TRADES} SELECT l_orderkey, symbol, side, q AS quantity, {columns}, round({total}, 8) AS total, round(({total}) / n * {BPS}, 8) AS bps FROM t"


def _costed(spark: SparkSession, d: str, model: costs.CostModel, *parts: str) -> DataFrame:
    rows = model.estimate(trades(spark, d))
    return rows.select("l_orderkey", "symbol", "side", "quantity", *[r(p, 8) for p in (*parts, "total", "bps")])


COST_QUERIES = {
    "cost_a_share": (costs.AShare(), {"commission": f"greatest(n * 2.5::DOUBLE / {BPS}, 5.0::DOUBLE)", "stamp_duty": f"CASE WHEN side = 'sell' THEN n * 10.0::DOUBLE / {BPS} ELSE 0 END", "transfer_fee": f"n * 0.2::DOUBLE / {BPS}"}),
    "cost_a_share_slippage": (costs.AShare(slippage=costs.FixedBps(3.0)), {"commission": f"greatest(n * 2.5::DOUBLE / {BPS}, 5.0::DOUBLE)", "stamp_duty": f"CASE WHEN side = 'sell' THEN n * 10.0::DOUBLE / {BPS} ELSE 0 END", "transfer_fee": f"n * 0.2::DOUBLE / {BPS}", "slippage": f"n * 3.0::DOUBLE / {BPS}"}),
    "cost_us_bps": (costs.USStock(commission_bps=5.0), {"commission": f"greatest(n * 5.0::DOUBLE / {BPS}, 0::DOUBLE)", "other": f"CASE WHEN side = 'sell' THEN n * 0.278::DOUBLE / {BPS} + q * 0.000166::DOUBLE ELSE 0 END"}),
    "cost_us_per_share": (costs.USStock(mode="per_share", min_commission=0.1), {"commission": "greatest(least(q * 0.005::DOUBLE, n * 0.01::DOUBLE), 0.1::DOUBLE)", "other": f"CASE WHEN side = 'sell' THEN n * 0.278::DOUBLE / {BPS} + q * 0.000166::DOUBLE ELSE 0 END"}),
    "cost_crypto_spot_taker": (costs.CryptoSpot(), {"commission": f"n * 10.0::DOUBLE / {BPS}"}),
    "cost_crypto_spot_maker": (costs.CryptoSpot(maker_bps=8.0, is_maker=True), {"commission": f"n * 8.0::DOUBLE / {BPS}"}),
    "cost_crypto_perp_funding": (costs.CryptoPerp(funding_rate=-1e-4, hold_intervals=3), {"commission": f"n * 5.0::DOUBLE / {BPS}", "funding": "(0.0001::DOUBLE * 3) * n"}),
    "cost_futures_contract": (costs.Futures(), {"commission": "q * 5.0::DOUBLE * 1.0::DOUBLE"}),
    "cost_futures_bps": (costs.Futures(mode="bps", close_today_multiplier=6.0), {"commission": f"n * 0.3::DOUBLE / {BPS} * 6.0::DOUBLE"}),
}


def _register_costs() -> None:
    for name, (model, parts) in COST_QUERIES.items():

        def run(spark, d, model=model, parts=parts):
            return _costed(spark, d, model, *parts)

        QUERIES[name], ORACLE_SQL[name] = run, _cost_sql(**parts)


_register_costs()


@query(f"WITH {TRADES} SELECT l_orderkey, symbol, round(n * 5.0::DOUBLE / {BPS}, 8) AS slippage FROM t")
def slip_fixed(spark, d):
    return trades(spark, d).select("l_orderkey", "symbol", r(costs.FixedBps().expr(), 8).alias("slippage"))


@query(f"WITH {TRADES} SELECT l_orderkey, symbol, round(n * (20.0::DOUBLE / 2) / {BPS}, 8) AS slippage FROM t")
def slip_half_spread(spark, d):
    return trades(spark, d).select("l_orderkey", "symbol", r(costs.HalfSpread(20.0).expr(), 8).alias("slippage"))


@query(f"""WITH {TRADES}, a AS (SELECT symbol, sum(q) AS adv FROM t GROUP BY symbol HAVING count(*) > 1)
    SELECT l_orderkey, t.symbol, q AS quantity, round(CASE WHEN adv IS NULL THEN 0 ELSE n * 10.0::DOUBLE * sqrt(q / adv) / {BPS} END, 6) AS slippage FROM t LEFT JOIN a ON t.symbol = a.symbol""")
def slip_sqrt_impact(spark, d):
    rows = trades(spark, d)
    adv = rows.groupBy("symbol").agg(F.sum("quantity").alias("adv"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return rows.join(adv, "symbol", "left").select("l_orderkey", "symbol", "quantity", r(costs.SquareRootImpact(adv="adv").expr(), 6).alias("slippage"))


@query(f"WITH {TRADES} SELECT side, count(*) AS trades, round(sum(greatest(n * 2.5::DOUBLE / {BPS}, 5.0::DOUBLE)) / sum(n) * {BPS}, 8) AS bps FROM t GROUP BY side")
def cost_bps_of_notional(spark, d):
    rows = costs.AShare().estimate(trades(spark, d))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("trades"), r(costs.bps_of(F.sum("commission"), F.sum("notional")), 8).alias("bps"))


@query(f"""WITH {TRADES}, m(model, note) AS (VALUES ('a_share', 'no slippage model (zero slippage assumed)'), ('crypto', 'taker fill at 10.00 bps'), ('futures', 'close-today multiplier 6.0x applied'),
    ('perp', 'taker fill, 3 funding intervals'), ('plain', '')) SELECT model, note, count(*) AS trades FROM t, m GROUP BY ALL""")
def cost_notes(spark, d):
    models = {"a_share": costs.AShare(), "crypto": costs.CryptoSpot(), "futures": costs.Futures(close_today_multiplier=6.0), "perp": costs.CryptoPerp(hold_intervals=3), "plain": costs.Futures()}
    out = None
    for name, model in models.items():
        one = model.estimate(trades(spark, d)).groupBy(F.lit(name).alias("model"), F.array_join("notes", "; ").alias("note")).agg(F.count(F.lit(1)).alias("trades"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH x AS (SELECT r_name AS region, n_name AS nation, l_extendedprice AS n, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT region, nation, count(*) AS trades, round(sum(greatest(n * 2.5::DOUBLE / {BPS}, 5.0::DOUBLE) + CASE WHEN l_linestatus = 'O' THEN 0 ELSE n * 10.0::DOUBLE / {BPS} END + n * 0.2::DOUBLE / {BPS}), 2) AS cost
    FROM x GROUP BY ROLLUP (region, nation)""")
def cost_attribution_rollup(spark, d):
    places = (
        read(spark, d, "customer").select("c_custkey", "c_nationkey")
        .join(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, d, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    )
    # Costs are added up by order before the joins, which then move one row an order.
    lines = costs.AShare().estimate(trades(spark, d)).groupBy("l_orderkey").agg(F.sum("total").alias("cost"), F.count(F.lit(1)).alias("k"))
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    held = lines.join(orders, "l_orderkey").groupBy("o_custkey").agg(F.sum("cost").alias("cost"), F.sum("k").alias("k"))
    return held.join(places, "o_custkey").rollup("region", "nation").agg(F.sum("k").alias("trades"), F.round(F.sum("cost"), 2).alias("cost"))


MODELS = {
    "a_share": costs.AShare(),
    "a_share_slippage": costs.AShare(slippage=costs.FixedBps(5.0)),
    "crypto_perp": costs.CryptoPerp(),
    "crypto_spot": costs.CryptoSpot(),
    "futures_bps": costs.Futures(mode="bps"),
    "us_zero": costs.USStock(sec_fee_bps=0.0, taf_per_share=0.0),
}
#: Golden values: the round trip of each model above on 1000 at 100.
ROUND_TRIPS = {"a_share": 15.4, "a_share_slippage": 25.4, "crypto_perp": 10.0, "crypto_spot": 20.0, "futures_bps": 0.6, "us_zero": 0.0}
TRIPS_SQL = "trips(model, bps) AS (VALUES " + ", ".join(f"('{m}', {b}::DOUBLE)" for m, b in ROUND_TRIPS.items()) + ")"


@query(f"WITH {TRIPS_SQL} SELECT model, round(bps, 6) AS round_trip_bps FROM trips")
def round_trip_bps(spark, d):
    return costs.round_trip(spark, MODELS).select("model", r("round_trip_bps"))


@query(f"""WITH {TRIPS_SQL}, t AS (SELECT l_suppkey, round(sum(l_extendedprice) / 1e6, 4) AS turnover FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, model, turnover AS annual_turnover, round(turnover * bps / 2, 8) AS annual_cost_bps FROM t, trips WHERE model = 'a_share'""")
def annual_cost(spark, d):
    trips = costs.round_trip(spark, {"a_share": MODELS["a_share"]})
    turnover = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice") / 1e6, 4).alias("annual_turnover"))
    both = turnover.withColumn("model", F.lit("a_share")).join(F.broadcast(trips), "model")  # one row
    return costs.annualise(both).select("l_suppkey", "model", "annual_turnover", r("annual_cost_bps", 8))


@query(f"""WITH {TRIPS_SQL}, f(frequency, n) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in REBALANCES.items())})
    SELECT model, frequency, n AS rebalances_per_year, round(0.2::DOUBLE * n, 6) AS annual_turnover, round(0.2::DOUBLE * n * bps / 2, 6) AS annual_cost_bps,
    round(0.2::DOUBLE * n * bps / 2 / 10000, 8) AS annual_cost_fraction, round(0.2::DOUBLE * bps / 2, 6) AS cost_per_rebalance_bps FROM trips, f""")
def annual_cost_by_frequency(spark, d):
    trips = costs.round_trip(spark, MODELS).withColumn("at", F.array(*[F.lit(f) for f in REBALANCES]))
    asked = trips.select("model", "round_trip_bps", F.explode("at").alias("frequency"), F.lit(0.2).alias("turnover_per_rebalance"))
    found = costs.annualise_by_frequency(asked)
    return found.select("model", "frequency", "rebalances_per_year", r("annual_turnover"), r("annual_cost_bps"), r("annual_cost_fraction", 8), r("cost_per_rebalance_bps"))


# Universes

MONTHLY = """h AS (SELECT m AS effective_date, list_sort(list(s)) AS members FROM (SELECT date_trunc('month', l_shipdate)::DATE AS m, l_suppkey::VARCHAR AS s, sum(l_extendedprice) AS v
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY m ORDER BY v DESC, s) <= 5 GROUP BY m)""".replace(
    "FROM (SELECT date_trunc", "FROM (SELECT m, s FROM (SELECT date_trunc").replace("<= 5 GROUP BY m)", "<= 5) GROUP BY m)")


def history(spark: SparkSession, d: str) -> DataFrame:
    """The five suppliers of most volume in each month from 1994 on."""
    lines = read(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1994-01-01").cast("timestamp_ntz"))
    volume = lines.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("m"), F.col("l_suppkey").cast("string").alias("s")).agg(F.sum("l_extendedprice").alias("v"))
    top = volume.withColumn("k", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("v"), "s"))).where("k <= 5")
    return top.groupBy(F.col("m").alias("effective_date")).agg(F.array_sort(F.collect_list("s")).alias("members"))


@query(f"""WITH {MONTHLY}, a AS (SELECT DISTINCT l_shipdate::DATE AS as_of FROM lineitem)
    SELECT as_of, array_to_string(coalesce(members, ['FALLBACK']), ',') AS members, coalesce('history@' || effective_date::VARCHAR, 'default') AS source FROM a ASOF LEFT JOIN h ON as_of >= effective_date""")
def universe_static_asof(spark, d):
    dates = read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("as_of")).distinct()
    return universe.as_of(dates, history(spark, d), ["FALLBACK"]).select("as_of", F.array_join("members", ",").alias("members"), "source")


TICKERS = "t AS (SELECT concat('P', p_partkey, '/', p_type) AS symbol, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def tickers(spark: SparkSession, d: str) -> DataFrame:
    by_part = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_extendedprice").alias("quote_volume"))
    names = read(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), "p_partkey", F.lit("/"), "p_type").alias("symbol"))
    return by_part.join(names, "p_partkey").select("symbol", "quote_volume")


@query(f"WITH {TICKERS} SELECT symbol FROM t WHERE ends_with(symbol, '/' || (SELECT min(p_type) FROM part)) AND v >= 0 ORDER BY v DESC, symbol LIMIT 10")
def universe_topn_quote(spark, d):
    quote = read(spark, d, "part").agg(F.min("p_type")).first()[0]
    return universe.top_n(tickers(spark, d), 10, quote)


@query(f"""WITH {TICKERS}, q AS (SELECT min(p_type) AS q FROM part) SELECT symbol FROM (SELECT symbol FROM t, q WHERE ends_with(symbol, '/' || q) AND v >= 0 ORDER BY v DESC, symbol LIMIT 3)
    UNION SELECT 'NEW/' || q FROM q""")
def universe_topn_anchors(spark, d):
    quote = read(spark, d, "part").agg(F.min("p_type")).first()[0]
    return universe.top_n(tickers(spark, d), 3, quote, (f"NEW/{quote}", f"NEW/{quote}", "FOO/OTHER"))


@query(f"""SELECT DATE '2024-01-02' AS as_of, unnest({sorted(universe.CRYPTO_SEED[:5])!r}) AS symbol, 'crypto_topn' AS builder, 'seed' AS source
    UNION ALL SELECT DATE '2024-01-02', unnest({sorted(universe.CSI300_SEED)!r}), 'csi300', 'seed' UNION ALL SELECT DATE '2024-01-02', unnest({sorted(universe.SP500_SEED)!r}), 'sp500', 'seed'""")
def universe_seed_fallback(spark, d):
    import datetime as dt

    day = dt.date(2024, 1, 2)
    builders = [universe.CryptoTopN(spark, n=5), universe.csi300(spark), universe.sp500(spark)]
    out = None
    for b in builders:
        one = b.snapshot(day).select("as_of", F.explode("members").alias("symbol"), F.col("metadata")["builder"].alias("builder"), F.col("metadata")["source"].alias("source"))
        out = one if out is None else out.unionByName(one)
    return out


BIG = "(SELECT s_suppkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey ORDER BY sum(l_extendedprice) DESC, s_suppkey LIMIT 5)"


def chosen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), "l_orderkey", "l_linenumber", "l_extendedprice")
    top = lines.groupBy("symbol").agg(F.sum("l_extendedprice").alias("v")).orderBy(F.desc("v"), "symbol").limit(5)
    return lines, top.agg(F.collect_list("symbol").alias("members")).withColumn("as_of", F.lit("2024-01-02").cast("date"))


@query(f"SELECT l_suppkey AS symbol, count(*) AS rows, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_suppkey IN {BIG} GROUP BY l_suppkey")
def universe_semi_join_bars(spark, d):
    lines, snapshot = chosen(spark, d)
    return universe.members_of(lines, snapshot).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query(f"SELECT l_suppkey AS symbol, count(*) AS rows, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_suppkey NOT IN {BIG} GROUP BY l_suppkey")
def universe_anti_join_bars(spark, d):
    lines, snapshot = chosen(spark, d)
    return universe.outside(lines, snapshot).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query(f"""WITH {MONTHLY}, p AS (SELECT effective_date, members, coalesce(lag(members) OVER (ORDER BY effective_date), []) AS before FROM h)
    SELECT effective_date, array_to_string(list_sort(list_filter(members, lambda x: NOT list_contains(before, x))), ',') AS joined,
    array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(members, x))), ',') AS left_out FROM p""")
def universe_churn(spark, d):
    found = universe.churn(history(spark, d))
    return found.select("effective_date", F.array_join("joined", ",").alias("joined"), F.array_join("left", ",").alias("left_out"))


@query("SELECT day FROM (SELECT o_orderdate::DATE AS day FROM orders INTERSECT SELECT l_shipdate::DATE FROM lineitem)")
def index_intersection(spark, d):
    a = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    return a.intersect(read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")))


# Analytics


@query(f"WITH {ALIGNED} SELECT day, round(max(close) FILTER (symbol = 'A'), 6) AS \"A\", round(max(close) FILTER (symbol = 'N'), 6) AS \"N\", round(max(close) FILTER (symbol = 'R'), 6) AS \"R\" FROM c GROUP BY day")
def align_inner(spark, d):
    wide = dated(analytics.align(bar_sources.lineitem_vwap(read(spark, d, "lineitem")), FLAGS))
    return wide.select("day", *[r(s) for s in FLAGS])


@query(f"WITH {ALIGNED} SELECT symbol, day, round(ret, 8) AS ret FROM ret")
def log_returns(spark, d):
    return returns(spark, d).select("symbol", "day", r("ret", 8))


@query(f"""WITH {ALIGNED} SELECT symbol, count(*) AS n, round(avg(ret), 8) + 0.0 AS mean, round(stddev_samp(ret), 8) AS std, round(min(ret), 8) AS min, round(max(ret), 8) AS max,
    round(avg(ret) * 252, 6) + 0.0 AS annual_return, round(stddev_samp(ret) * sqrt(252), 6) AS annual_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) + 0.0 AS sharpe FROM ret GROUP BY symbol""")
def desc_stats(spark, d):
    m = analytics.moments(returns(spark, d))
    return m.select("symbol", "n", *[r(c, 8) for c in ("mean", "std", "min", "max")], *[r(c) for c in ("annual_return", "annual_vol", "sharpe")])


@query(f"WITH {ALIGNED} SELECT symbol, round(skewness(ret), 5) + 0.0 AS skew, round(kurtosis(ret), 5) + 0.0 AS kurtosis FROM ret GROUP BY symbol")
def skew_kurt_adjusted(spark, d):
    return analytics.moments(returns(spark, d)).select("symbol", r("skew", 5), r("kurtosis", 5))


@query(f"""WITH {ALIGNED} SELECT symbol, day, round(CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt(252) END, 6) AS vol FROM ret
    WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_vol_20(spark, d):
    return analytics.rolling_vol(returns(spark, d)).select("symbol", "day", r("vol"))


@query(f"WITH {ALIGNED} SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(corr(x.ret, y.ret), 6) + 0.0 AS corr FROM ret x JOIN ret y ON x.day = y.day AND x.symbol < y.symbol GROUP BY ALL")
def corr_matrix(spark, d):
    return analytics.correlations(returns(spark, d)).select("a", "b", "n", r("corr"))


@query(f"""WITH {ALIGNED} SELECT x.symbol AS a, y.symbol AS b, x.day, round(CASE WHEN count(*) OVER w >= 60 THEN corr(x.ret, y.ret) OVER w END, 6) + 0.0 AS corr FROM ret x JOIN ret y ON x.day = y.day AND x.symbol < y.symbol
    WINDOW w AS (PARTITION BY x.symbol, y.symbol ORDER BY x.day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def rolling_corr_60(spark, d):
    return analytics.rolling_correlations(returns(spark, d)).select("a", "b", "day", r("corr"))


@query(f"""WITH {ALIGNED}, p AS (SELECT symbol, day, product(1 + ret) OVER w / first_value(1 + ret) OVER w AS curve FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT symbol, day, round(curve, 6) + 0.0 AS curve FROM p""")
def cumprod_as_written(spark, d):
    return analytics.cumulative(returns(spark, d)).select("symbol", "day", r("curve"))


@query(f"""WITH {ALIGNED} SELECT symbol, day, round(exp(sum(ret) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS growth FROM ret""")
def cum_return_exact(spark, d):
    return analytics.cumulative(returns(spark, d)).select("symbol", "day", r("growth"))


@query("""WITH e AS (SELECT event_type AS symbol, value AS ret FROM events), s AS (SELECT symbol, min(ret) AS low, max(ret) AS high FROM e GROUP BY symbol)
    SELECT symbol, least(floor((ret - low) / (high - low) * 80), 79)::INTEGER AS bin, count(*) AS n FROM e JOIN s USING (symbol) GROUP BY ALL""")
def histogram_80(spark, d):
    return analytics.histogram(read(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("value").alias("ret")))


def _horner(x: str, *terms: float) -> str:
    out = repr(terms[0])
    for t in terms[1:]:
        out = f"({out} * {x} + {t!r})"
    return out


# The published coefficients of the normal quantile's rational approximation.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = lambda p: f"({_horner(f'sqrt(-2 * ln({p}))', *_C)} / {_horner(f'sqrt(-2 * ln({p}))', *_D)})"
QUANTILES = f"""{ALIGNED}, o AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ret),
    m AS (SELECT *, CASE WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM o),
    q AS (SELECT symbol, i, ret, CASE WHEN p < 0.02425 THEN {_TAIL("p")} WHEN p > 0.97575 THEN -{_TAIL("(1 - p)")}
        ELSE (p - 0.5) * {_horner("((p - 0.5) * (p - 0.5))", *_A)} / {_horner("((p - 0.5) * (p - 0.5))", *_B)} END AS z FROM m)"""


@query(f"WITH {QUANTILES} SELECT symbol, i::INTEGER AS rank, round(z, 8) + 0.0 AS theoretical, round(ret, 8) + 0.0 AS sample FROM q")
def qq_normal(spark, d):
    return analytics.normal_quantiles(returns(spark, d)).select("symbol", "rank", r("theoretical", 8), r("sample", 8))


@query(f"WITH {QUANTILES} SELECT symbol, round(regr_slope(ret, z), 6) + 0.0 AS slope, round(regr_intercept(ret, z), 6) + 0.0 AS intercept, round(corr(z, ret), 6) + 0.0 AS r FROM q GROUP BY symbol")
def qq_fit(spark, d):
    return analytics.normal_fit(returns(spark, d)).select("symbol", r("slope"), r("intercept"), r("r"))


@query(f"""WITH {ALIGNED}, s AS (SELECT symbol, min(ret) AS low, max(ret) AS high, count(*) AS n, stddev_samp(ret) * pow(count(*), -0.2::DOUBLE) AS h FROM ret GROUP BY symbol),
    g AS (SELECT symbol, k, low + (high - low) * k / 49 AS x, n, h FROM s, range(50) AS t(k))
    SELECT symbol, round(x, 8) + 0.0 AS x, round(sum(exp(-((x - ret) / h) * ((x - ret) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM g JOIN ret USING (symbol) GROUP BY symbol, k, x""")
def kde(spark, d):
    return analytics.density(returns(spark, d)).select("symbol", r("x", 8), r("density"))


# Extensions

FRAME = "(PARTITION BY symbol ORDER BY day ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"WITH {ALIGNED} SELECT symbol, day, round(CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w END, 6) AS sma FROM c WINDOW w AS {FRAME.format(19)}")
def sma(spark, d):
    return analytics.sma(closes(spark, d)).select("symbol", "day", r("sma"))


@query(f"""WITH {ALIGNED} SELECT symbol, day, round(CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w END, 6) AS mid, round(CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w + 2 * stddev_pop(close) OVER w END, 4) AS upper,
    round(CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w - 2 * stddev_pop(close) OVER w END, 4) AS lower FROM c WINDOW w AS {FRAME.format(19)}""")
def bollinger(spark, d):
    return analytics.bollinger(closes(spark, d)).select("symbol", "day", r("mid"), r("upper", 4), r("lower", 4))


@query(f"""WITH b AS ({ORDER_BARS}), t AS (SELECT symbol, day, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY day)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY day))) AS tr FROM b)
    SELECT symbol, day, round(CASE WHEN count(tr) OVER w >= 14 THEN avg(tr) OVER w END, 4) AS atr FROM t WINDOW w AS {FRAME.format(13)}""")
def atr(spark, d):
    return analytics.atr(dated(bar_sources.order_bars(read(spark, d, "orders")))).select("symbol", "day", r("atr", 4))


@query(f"""WITH {ALIGNED}, m AS (SELECT * FROM (SELECT symbol, day, close - lag(close) OVER (PARTITION BY symbol ORDER BY day) AS d FROM c) WHERE d IS NOT NULL),
    g AS (SELECT symbol, day, count(*) OVER w AS k, avg(greatest(d, 0)) OVER w AS up, avg(greatest(-d, 0)) OVER w AS down FROM m WINDOW w AS {FRAME.format(13)})
    SELECT symbol, day, round(CASE WHEN k >= 14 THEN 100 * up / nullif(up + down, 0) END, 4) AS rsi FROM g""")
def rsi(spark, d):
    return analytics.rsi(closes(spark, d)).select("symbol", "day", r("rsi", 4))


@query(f"""WITH RECURSIVE {ALIGNED}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k FROM c),
    e AS (SELECT symbol, day, k, close::DOUBLE AS fast, close::DOUBLE AS slow, 0.0::DOUBLE AS signal FROM n WHERE k = 1
        UNION ALL SELECT n.symbol, n.day, n.k, close * 2 / 13 + fast * 11 / 13, close * 2 / 27 + slow * 25 / 27,
            0.2 * (close * 2 / 13 + fast * 11 / 13 - close * 2 / 27 - slow * 25 / 27) + 0.8 * signal FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)
    SELECT symbol, day, round(fast - slow, 6) + 0.0 AS macd, round(signal, 6) + 0.0 AS signal FROM e""")
def macd(spark, d):
    return analytics.macd(closes(spark, d)).select("symbol", "day", r("macd"), r("signal"))


@query(f"""WITH {ALIGNED}, l AS (SELECT symbol, day, sum(ret) OVER (PARTITION BY symbol ORDER BY day) AS level FROM ret), p AS (SELECT symbol, level, greatest(max(level) OVER (PARTITION BY symbol ORDER BY day), 0) AS peak FROM l)
    SELECT symbol, round(min(exp(level - peak) - 1), 6) AS max_drawdown FROM p GROUP BY symbol""")
def max_drawdown(spark, d):
    return analytics.drawdown(returns(spark, d)).select("symbol", r("max_drawdown"))


@query(f"""WITH {ALIGNED}, l AS (SELECT symbol, day, sum(ret) OVER (PARTITION BY symbol ORDER BY day) AS level FROM ret), p AS (SELECT symbol, level, greatest(max(level) OVER (PARTITION BY symbol ORDER BY day), 0) AS peak FROM l),
    m AS (SELECT symbol, min(exp(level - peak) - 1) AS dd FROM p GROUP BY symbol)
    SELECT symbol, round(avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252), 6) + 0.0 AS sortino, round(avg(ret) * 252 / abs(any_value(dd)), 6) + 0.0 AS calmar, round(avg((ret > 0)::INTEGER), 6) AS hit_rate FROM ret JOIN m USING (symbol) GROUP BY symbol""")
def performance(spark, d):
    return analytics.performance(returns(spark, d)).select("symbol", r("sortino"), r("calmar"), r("hit_rate"))


@query("""WITH e AS (SELECT event_type AS symbol, value AS ret FROM events), q AS (SELECT symbol, quantile_cont(ret, 0.05) AS var FROM e GROUP BY symbol)
    SELECT symbol, round(any_value(var), 6) + 0.0 AS var, round(avg(ret), 6) + 0.0 AS cvar FROM e JOIN q USING (symbol) WHERE ret <= var GROUP BY symbol""")
def hist_var_cvar(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("value").alias("ret"))
    return analytics.value_at_risk(rows).select("symbol", r("var"), r("cvar"))


@query(f"""WITH {ALIGNED}, m AS (SELECT symbol, day, lag(close, 5) OVER (PARTITION BY symbol ORDER BY day) / lag(close, 60) OVER (PARTITION BY symbol ORDER BY day) - 1 AS momentum FROM c)
    SELECT symbol, day, round(momentum, 6) + 0.0 AS momentum, rank() OVER (PARTITION BY day ORDER BY momentum DESC)::INTEGER AS rank FROM m WHERE momentum IS NOT NULL""")
def momentum_rank(spark, d):
    m = analytics.momentum(closes(spark, d))
    return m.select("symbol", "day", r("momentum"), F.rank().over(Window.partitionBy("day").orderBy(F.desc("momentum"))).alias("rank"))


SUPPLY = "f AS (SELECT l_suppkey::VARCHAR AS symbol, date_trunc('month', l_shipdate)::DATE AS day, round(sum(l_extendedprice), 2) AS momentum FROM lineitem GROUP BY ALL)"


def supply(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("momentum"))


@query(f"""WITH {SUPPLY} SELECT symbol, day, (ntile(5) OVER (PARTITION BY day ORDER BY momentum, symbol))::INTEGER AS bucket,
    round((momentum - avg(momentum) OVER (PARTITION BY day)) / nullif(stddev_samp(momentum) OVER (PARTITION BY day), 0), 5) + 0.0 AS zscore FROM f""")
def ntile_quintiles(spark, d):
    return analytics.quintiles(supply(spark, d)).select("symbol", "day", "bucket", r("zscore", 5))


@query(f"""WITH {SUPPLY}, g AS (SELECT symbol, day, momentum AS factor, lead(momentum) OVER (PARTITION BY symbol ORDER BY day) AS fwd FROM f),
    k AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY factor) + (count(*) OVER (PARTITION BY day, factor) - 1) / 2 AS x, rank() OVER (PARTITION BY day ORDER BY fwd) + (count(*) OVER (PARTITION BY day, fwd) - 1) / 2 AS y FROM g WHERE fwd IS NOT NULL)
    SELECT day, count(*) AS n, round(CASE WHEN stddev_samp(x) > 0 AND stddev_samp(y) > 0 THEN corr(x, y) END, 6) + 0.0 AS ic FROM k GROUP BY day""")
def rank_ic(spark, d):
    ahead = supply(spark, d).withColumn("fwd", F.lead("momentum").over(Window.partitionBy("symbol").orderBy("day"))).withColumnRenamed("momentum", "factor")
    return analytics.information_coefficient(ahead).select("day", "n", r("ic"))


@query(f"""WITH {MONTHLY}, w AS (SELECT effective_date AS day, unnest(members) AS symbol, 1.0 / len(members) AS weight FROM h), k AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM w)),
    x AS (SELECT symbol, k, weight FROM w JOIN k USING (day)), e AS (SELECT symbol, k FROM x UNION SELECT symbol, k + 1 FROM x)
    SELECT k.day, round(sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))), 6) AS turnover FROM e JOIN k ON e.k = k.k LEFT JOIN x a ON a.symbol = e.symbol AND a.k = e.k LEFT JOIN x b ON b.symbol = e.symbol AND b.k = e.k - 1 GROUP BY k.day""")
def turnover(spark, d):
    weights = history(spark, d).select(F.col("effective_date").alias("day"), F.explode("members").alias("symbol"), (1.0 / F.size("members")).alias("weight"))
    return analytics.turnover(weights).select("day", r("turnover"))


@query(f"""WITH {ALIGNED}, p AS ({ORDER_BARS}), s AS (SELECT symbol, min(day) AS f FROM p GROUP BY symbol), k2 AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem),
    g AS (SELECT symbol, day FROM s, k2 WHERE day >= f UNION SELECT symbol, day FROM p)
    SELECT g.symbol, g.day, last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.day) AS close FROM g LEFT JOIN p ON g.symbol = p.symbol AND g.day = p.day""")
def forward_fill(spark, d):
    calendar = read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return analytics.forward_fill(calendar, dated(bar_sources.order_bars(read(spark, d, "orders"))))


@query(f"WITH {ALIGNED}, f AS (SELECT symbol, day, lead(close, 20) OVER (PARTITION BY symbol ORDER BY day) / close - 1 AS fwd FROM c) SELECT symbol, day, round(fwd, 6) + 0.0 AS fwd FROM f WHERE fwd IS NOT NULL")
def forward_return_20(spark, d):
    return analytics.forward_returns(closes(spark, d)).select("symbol", "day", r("fwd"))


@query(f"""WITH b AS ({ORDER_BARS}), x AS (SELECT symbol, day, close, CASE WHEN count(*) OVER w >= 20 THEN max(close) OVER w END AS upper, CASE WHEN count(*) OVER w >= 20 THEN min(close) OVER w END AS lower
    FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT symbol, day, upper, lower, CASE WHEN close > upper THEN 1 WHEN close < lower THEN -1 ELSE 0 END::INTEGER AS breakout FROM x""")
def channel_breakout(spark, d):
    return analytics.channels(dated(bar_sources.order_bars(read(spark, d, "orders"))))


@query(f"""WITH {SUPPLY}, q AS (SELECT day, quantile_cont(momentum, 0.01) AS l, quantile_cont(momentum, 0.99) AS h FROM f GROUP BY day), x AS (SELECT symbol, f.day, greatest(least(momentum, h), l) AS clipped FROM f JOIN q ON f.day = q.day)
    SELECT symbol, day, round(clipped, 4) AS clipped, round((clipped - avg(clipped) OVER (PARTITION BY day)) / nullif(stddev_samp(clipped) OVER (PARTITION BY day), 0), 5) + 0.0 AS zscore FROM x""")
def winsorised_zscore(spark, d):
    return analytics.winsorised(supply(spark, d), "momentum").select("symbol", "day", r("clipped", 4), r("zscore", 5))


@query(f"""WITH {ALIGNED}, vols AS (SELECT symbol, day, CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol FROM ret WINDOW w AS {FRAME.format(19)})
    SELECT symbol, day, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY day), 6) AS weight FROM vols WHERE vol > 0""")
def inverse_vol_weights(spark, d):
    return analytics.inverse_vol_weights(returns(spark, d)).select("symbol", "day", r("weight"))


@query(f"""WITH {ALIGNED} SELECT symbol, day, round(ret - 0.2 * 7.7 / 10000, 8) + 0.0 AS net FROM ret""")
def net_return(spark, d):
    gross = returns(spark, d).withColumnRenamed("ret", "gross").withColumn("turnover", F.lit(0.2))
    return analytics.net_returns(gross, 7.7).select("symbol", "day", r("net", 8))


@query("""WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS trades
    FROM events GROUP BY ALL) SELECT symbol, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, open, high, low, close, trades FROM b WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def streaming_bars(spark, d):
    where = scratch(spark, "streamed")
    found = run_to_end(spark, f"{d}/events.parquet", f"{where}/bars", f"{where}/state")
    return found.select("symbol", F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("hour"), "open", "high", "low", "close", "trades")


@query(f"""WITH {ALIGNED} SELECT symbol, count(*) AS n, round(avg(ret), 8) + 0.0 AS mean, round(stddev_samp(ret), 8) AS std, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) + 0.0 AS sharpe FROM ret GROUP BY symbol""")
def flagship(spark, d):
    """Daily VWAP bars of three symbols, aligned, to log returns, to moments and Sharpe ratio."""
    return analytics.moments(returns(spark, d)).select("symbol", "n", r("mean", 8), r("std", 8), r("sharpe"))
