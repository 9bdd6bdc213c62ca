"""Every registered core query against the same in DuckDB, over whole tables."""

import datetime as dt
import math
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import inverse_normal
from tidemark.operators import analytics
from tidemark.plans import catalogue, ingestion, research  # noqa: F401  (the last two add to the catalogue)
from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
SIZE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SIZE}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (dt.datetime, pd.Timestamp)):
        return str(v.date())
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SIZE)
    rows = [tuple(map(cell, r)) for r in got.select(*sorted(got.columns)).collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    want = oracle.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert sorted(names) == sorted(got.columns)
    assert sorted(rows) == sorted(tuple(cell(r[k]) for k in order) for r in want.fetchall())


def log_returns(oracle):
    """Returns of the three aligned symbols by symbol, from SQL alone."""
    rows = oracle.execute(f"WITH {catalogue.ALIGNED} SELECT symbol, day, ret FROM ret ORDER BY symbol, day").fetchall()
    out = {}
    for symbol, _, ret in rows:
        out.setdefault(symbol, []).append(ret)
    return out


def quantile_plot(returns):
    n = len(returns)
    last = 0.5 ** (1 / n)
    medians = [1 - last if k == 1 else last if k == n else (k - 0.3175) / (n + 0.365) for k in range(1, n + 1)]
    return [NormalDist().inv_cdf(m) for m in medians], sorted(returns)


def test_quantile_plot_by_brute_force(spark, oracle):
    got = {}
    for r in QUERIES["qq_normal"](spark, SIZE).collect():
        got.setdefault(r.symbol, []).append((r.rank, r.theoretical, r["sample"]))
    want = log_returns(oracle)
    assert set(got) == set(want)
    fits = {r.symbol: r for r in QUERIES["qq_fit"](spark, SIZE).collect()}
    for symbol, returns in want.items():
        x, y = quantile_plot(returns)
        rows = sorted(got[symbol])
        assert [r[0] for r in rows] == list(range(1, len(x) + 1))
        assert [r[1] for r in rows] == pytest.approx(x, abs=1e-5) and [r[2] for r in rows] == pytest.approx(y, abs=1e-5)
        slope, intercept = np.polyfit(x, y, 1)
        assert (fits[symbol].slope, fits[symbol].intercept, fits[symbol].r) == (pytest.approx(slope, abs=1e-5), pytest.approx(intercept, abs=1e-5), pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-5))


def test_macd_by_brute_force(spark):
    closes = {}
    for r in catalogue.closes(spark, SIZE).orderBy("symbol", "day").collect():
        closes.setdefault(r.symbol, []).append((r.day, r.close))
    got = {(r.symbol, r.day): (r.macd, r.signal) for r in QUERIES["macd"](spark, SIZE).collect()}
    assert len(got) == sum(map(len, closes.values()))
    for symbol, rows in closes.items():
        fast = slow = line = None
        for day, close in rows:
            fast = close if fast is None else close * 2 / 13 + fast * 11 / 13
            slow = close if slow is None else close * 2 / 27 + slow * 25 / 27
            line = fast - slow if line is None else (fast - slow) * 2 / 10 + line * 8 / 10
            assert got[symbol, day] == (pytest.approx(fast - slow, abs=1e-4), pytest.approx(line, abs=1e-4))


def test_inverse_normal(spark):
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inverse_normal(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-8)


def test_macd_and_constant_prices(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(40)]
    prices = [100 + (k * 7919 % 13) for k in range(40)]
    closes = spark.createDataFrame([("A", d, float(p)) for d, p in zip(days, prices, strict=True)] + [("B", d, 5.0) for d in days], "symbol string, day date, close double")
    got = {r.day: (r.macd, r.signal) for r in analytics.macd(closes).where("symbol = 'A'").collect()}
    s = pd.Series(prices, dtype=float)
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    signal = macd.ewm(span=9, adjust=False).mean()
    assert all(got[d] == (pytest.approx(macd[k]), pytest.approx(signal[k])) for k, d in enumerate(days))
    returns = analytics.log_returns(closes)
    flat = analytics.moments(returns).where("symbol = 'B'").first()
    assert flat.sharpe is None and flat.skew is None and analytics.correlations(returns).first().corr is None
    assert analytics.rsi(closes).where("symbol = 'B'").agg({"rsi": "max"}).first()[0] is None
