import datetime as dt

import pytest

from tidemark.functions.errors import UniverseDataUnavailableError
from tidemark.functions.scalars import as_date
from tidemark.operators import universe as u

HISTORY = {dt.date(2024, 1, 1): ("AAPL", "NVDA"), dt.date(2020, 1, 1): ("MSFT", "AAPL", "AAPL"), dt.date(2022, 1, 1): ("AAPL", "MSFT", "NVDA")}
TICKERS = {"BTC/USDT": 5e9, "ETH/USDT": 2e9, "SOL/USDT": 8e8, "XRP/USDT": 6e8, "BNB/USDT": 5e8, "DOGE/USDT": 4e8, "ADA/USDT": 3e8, "FOO/BTC": 999999999.0}


@pytest.mark.parametrize(
    ("day", "members"),
    [("2019-06-01", {"FALLBACK"}), ("2020-01-01", {"AAPL", "MSFT"}), ("2021-06-01", {"AAPL", "MSFT"}), ("2024-06-01", {"AAPL", "NVDA"})],
)
def test_static(spark, day, members):
    built = u.StaticUniverse(spark, members_list=("FALLBACK",), history=HISTORY)
    assert built.members(dt.date.fromisoformat(day)) == members


def test_snapshots(spark):
    row = u.StaticUniverse(spark, members_list=("MSFT", "AAPL", "MSFT", "NVDA")).snapshot(dt.datetime(2024, 6, 15, 12, 30)).first()
    assert row.members == ["AAPL", "MSFT", "NVDA"] and row.as_of == dt.date(2024, 6, 15) and row.metadata == {"builder": "static", "source": "default"}
    assert as_date(None) == dt.datetime.now(dt.UTC).date()


def test_seeded(spark):
    assert len(u.csi300(spark).members()) == 30 and len(u.sp500(spark).members()) == 40
    got = u.csi300(spark, lambda day: ["B", "A", "B"]).snapshot().first()
    assert got.members == ["A", "B"] and got.metadata["source"] == "fetcher"
    assert u.sp500(spark, lambda day: []).snapshot().first().metadata["source"] == "seed"
    assert "error" in u.sp500(spark, lambda day: 1 / 0).snapshot().first().metadata["reason"]
    for bad in (lambda day: [], lambda day: 1 / 0):
        with pytest.raises(UniverseDataUnavailableError):
            u.csi300(spark, bad, use_seed_on_error=False).snapshot()
    frame = spark.createDataFrame([("Z",), ("Y",)], "symbol string")
    assert u.csi300(spark, lambda day: frame).members() == {"Y", "Z"}


def test_crypto(spark):
    def top(**how):
        return u.CryptoTopN(spark, source=lambda day: TICKERS, **how).members()

    assert top(n=3) == {"BTC/USDT", "ETH/USDT", "SOL/USDT"}
    assert top(n=1) == {"BTC/USDT", "ETH/USDT"}
    assert top(n=1, anchors=("FOO/BTC", "NEW/USDT")) == {"BTC/USDT", "NEW/USDT"}
    assert u.CryptoTopN(spark, n=2).members() == {"BTC/USDT", "ETH/USDT"} and len(u.CryptoTopN(spark).members()) == 20
    with pytest.raises(ValueError):
        u.CryptoTopN(spark, n=0)
    with pytest.raises(UniverseDataUnavailableError):
        u.CryptoTopN(spark, source=lambda day: {}, use_seed_on_error=False).snapshot()
    odd = spark.createDataFrame([("A/USDT", float("nan")), ("B/USDT", None), ("C/USDT", -1.0), ("D/USDT", 0.0), ("E/USDT", 0.0)], "symbol string, quote_volume double")
    assert {r.symbol for r in u.top_n(odd, 1).collect()} == {"D/USDT"}


def test_joins(spark):
    bars = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "symbol string, v int")
    snapshot = u.StaticUniverse(spark, members_list=("A", "C")).snapshot()
    assert {r.symbol for r in u.members_of(bars, snapshot).collect()} == {"A", "C"}
    assert {r.symbol for r in u.outside(bars, snapshot).collect()} == {"B"}
