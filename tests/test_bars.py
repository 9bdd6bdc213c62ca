import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions.errors import AuthenticationError, DataProviderError
from tidemark.functions.schema import Frequency, Market
from tidemark.operators.quality import validate, violations
from tidemark.sources import normalise
from tidemark.sources.ingest import BarSource, Ingest, Series, TableSource
from tidemark.sources.providers import CCXTSource, TushareSource, YahooSource
from tidemark.sources.store import BarStore

UTC = dt.UTC
COLUMNS = ["timestamp", "open", "high", "low", "close", "volume"]
SCHEMA = "timestamp timestamp, open double, high double, low double, close double, volume double"
ROWS = [
    (dt.datetime(2024, 1, 1, tzinfo=UTC), 100.0, 102.0, 99.0, 101.0, 1000.0),
    (dt.datetime(2024, 1, 2, tzinfo=UTC), 101.0, 103.0, 100.0, 102.0, 1500.0),
    (dt.datetime(2024, 1, 3, tzinfo=UTC), 102.0, 104.0, 101.0, 103.0, 1200.0),
]
START, END = dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 1, 31, tzinfo=UTC)


def bars(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def changed(**values):
    row = dict(zip(COLUMNS, ROWS[0], strict=True)) | values
    return [tuple(row[c] for c in COLUMNS), ROWS[1]]


def test_valid(spark):
    validate(bars(spark))


@pytest.mark.parametrize(
    ("values", "message"),
    [
        ({"high": 50.0}, "high < low"), ({"close": 999.0}, "high < open or high < close"), ({"low": 500.0, "high": 600.0}, "low > open or low > close"),
        ({"volume": -1.0}, "negative volume"), ({"close": float("nan")}, "NaN"), ({"close": None}, "NaN"), ({"timestamp": ROWS[1][0]}, "duplicates"), ({"timestamp": None}, "monotonically"),
    ],
)
def test_rules(spark, values, message):
    with pytest.raises(ValueError, match=message):
        validate(bars(spark, changed(**values)))


def test_schema_rules(spark):
    with pytest.raises(ValueError, match="empty"):
        validate(bars(spark, []))
    with pytest.raises(ValueError, match="empty"):  # emptiness comes before the columns
        validate(spark.createDataFrame([], "other int"))
    with pytest.raises(ValueError, match="missing columns.*volume"):
        validate(bars(spark).drop("volume"))
    with pytest.raises(TypeError, match="datetime64"):
        validate(bars(spark).withColumn("timestamp", F.col("timestamp").cast("string")))
    with pytest.raises(TypeError, match="must be numeric"):
        validate(bars(spark).withColumn("close", F.col("close").cast("string")))
    validate(bars(spark, changed(close=float("nan"))), allow_nan=True)
    reversed_ = spark.createDataFrame([(*r, k) for k, r in enumerate(ROWS[::-1])], SCHEMA + ", seq int")
    validate(reversed_.drop("seq"))
    with pytest.raises(ValueError, match="monotonically"):
        validate(reversed_, sequence="seq")
    assert violations(reversed_, sequence="seq").first()["not_monotonic"] == 2


def test_store(spark, tmp_path):
    store = BarStore(spark, str(tmp_path))
    assert store.safe("BTC/USDT") == "BTC-USDT" and store.safe("AAPL:NASDAQ") == "AAPL-NASDAQ" and store.safe("AAPL") == "AAPL"
    assert not store.exists("test", "ABC", "1d")
    with pytest.raises(FileNotFoundError):
        store.read("test", "ABC", "1d")
    store.write(bars(spark), "test", "ABC", "1d", {"note": "x", "row_count": "many"})
    store.write(bars(spark, ROWS[:2]), "test", "ABC", "1M")
    assert store.exists("test", "ABC", "1d") and not store.exists("test", "ABC", "1m")
    assert [tuple(r) for r in store.read("test", "ABC", "1d").withColumn("timestamp", F.unix_seconds("timestamp")).sort("timestamp").collect()] == [(int(r[0].timestamp()), *r[1:]) for r in ROWS]
    held = store.read_metadata("test", "ABC", "1d")
    assert held["provider"] == "test" and held["symbol"] == "ABC" and held["frequency"] == "1d" and held["schema_version"] == "1"
    assert held["row_count"] == "many" and held["note"] == "x" and held["start"].startswith("2024-01-01") and held["end"].startswith("2024-01-03")
    assert store.read_metadata("test", "ABC", "1M")["row_count"] == "2"
    store.write(bars(spark, ROWS[:1]), "test", "ABC", "1d")
    assert store.read("test", "ABC", "1d").count() == 1 and store.read_all().count() == 3 and store.metadata().count() == 2
    with pytest.raises(ValueError, match="high < low"):
        store.write(bars(spark, changed(high=50.0)), "test", "ABC", "1d")


def test_symbols_with_one_safe_name(spark, tmp_path):
    store = BarStore(spark, str(tmp_path))
    store.write(bars(spark), "test", "A/B", "1d")
    assert not store.exists("test", "A-B", "1d") and not store.exists("test", "A:B", "1d")
    store.write(bars(spark, ROWS[:1]), "test", "A-B", "1d")
    store.write(bars(spark, ROWS[:2]), "test", "ES=F", "1d")
    assert [store.read("test", x, "1d").count() for x in ("A/B", "A-B", "ES=F")] == [3, 1, 2]
    assert [store.read_metadata("test", x, "1d")["symbol"] for x in ("A/B", "A-B", "ES=F")] == ["A/B", "A-B", "ES=F"]
    names = ["A/B", "A-B", "ES=F", "BTC/USDT", "x y", "é"]
    columns = spark.createDataFrame([(x,) for x in names], "s string").select("s", store.folder_column(F.col("s")).alias("f")).collect()
    assert all(r.f == store.folder(r.s) for r in columns) and len({r.f for r in columns}) == len(names)


def test_store_takes_a_batch(spark, tmp_path):
    store = BarStore(spark, str(tmp_path))
    every = bars(spark).crossJoin(spark.createDataFrame([("A", "1d"), ("A", "1M"), ("B/C", "1d")], "symbol string, frequency string"))
    store.write_many(every, "test")
    assert store.read("test", "B/C", "1d").count() == 3 and store.read_metadata("test", "A", "1M")["frequency"] == "1M"
    store.write_many(every.where("symbol = 'A' and frequency = '1d' and open = 100"), "test")
    assert store.read("test", "A", "1d").count() == 1 and store.read("test", "A", "1M").count() == 3
    with pytest.raises(ValueError, match="duplicates"):
        store.write_many(every.union(every.where("symbol = 'B/C'")), "test")


class Fake(BarSource):
    name = "fake"
    markets = frozenset({Market.US})
    frequencies = frozenset({Frequency.DAILY})

    def __init__(self, spark, failing=(), invalid=(), late=()):
        self.spark, self.failing, self.invalid, self.late, self.asked = spark, failing, invalid, late, []

    def bars(self, series):
        self.asked.append(series.symbol)
        if series.symbol in self.failing:
            raise DataProviderError("no")
        rows = changed(high=50.0) if series.symbol in self.invalid else ROWS
        rows = rows[::-1] if series.symbol in self.late else rows
        return self.spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", arrival long")


def wanted(*symbols, end=END):
    return [Series(s, START, end) for s in symbols]


def test_ingest(spark, tmp_path):
    source = Fake(spark, failing=("BBB",))
    ingest = Ingest(source, BarStore(spark, str(tmp_path)))
    assert ingest.series(wanted("AAA")[0]).count() == 3
    first = dt.datetime(2024, 1, 1, tzinfo=UTC)
    assert ingest.series(wanted("AAA", end=first)[0]).count() == 3 and source.asked == ["AAA"]
    assert ingest.series(wanted("AAA", end=dt.datetime(2024, 1, 2, tzinfo=UTC))[0], clip=True).count() == 2
    ingest.series(wanted("AAA")[0], force=True)
    assert source.asked == ["AAA", "AAA"]
    out = ingest.load(wanted("AAA", "BBB", "CCC")).collect()
    assert [(r.symbol, r.fetched, r.error_kind, r.error) for r in out] == [("AAA", False, None, None), ("BBB", False, "DataProviderError", "no"), ("CCC", True, None, None)]
    held = ingest.stored(wanted("AAA", "BBB", "CCC"))
    assert held.count() == 6 and "arrival" not in held.columns
    with pytest.raises(DataProviderError):
        ingest.series(wanted("BBB")[0])
    stopped = Ingest(Fake(spark, failing=("AAA",)), BarStore(spark, str(tmp_path / "b"))).load(wanted("AAA", "BBB"), stop_on_error=True)
    assert [r.symbol for r in stopped.collect()] == ["AAA"]
    with pytest.raises(ValueError, match="high < low"):
        Ingest(Fake(spark, invalid=("AAA",)), BarStore(spark, str(tmp_path / "c"))).load(wanted("AAA"))
    with pytest.raises(ValueError, match="monotonically"):
        Ingest(Fake(spark, late=("AAA",)), BarStore(spark, str(tmp_path / "d"))).load(wanted("BBB", "AAA"))


def test_capabilities_and_tables(spark, tmp_path):
    source = Fake(spark)
    assert source.offers(Series("A", START, END)) and source.offers(Series("A", START, END, market=Market.US))
    assert not source.offers(Series("A", START, END, Frequency.HOUR_1)) and not source.offers(Series("A", START, END, market=Market.CN))
    table = TableSource(bars(spark).withColumn("symbol", F.lit("A")))
    assert table.bars(Series("A", START, dt.datetime(2024, 1, 2, tzinfo=UTC))).count() == 2
    assert table.bars(Series("A", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))).count() == 2
    with pytest.raises(DataProviderError):
        table.bars(Series("B", START, END))
    out = Ingest(table, BarStore(spark, str(tmp_path))).load(wanted("A", "B")).collect()
    assert [(r.symbol, r.fetched, r.error) for r in out] == [("A", True, None), ("B", False, "no bars of B")]


@pytest.fixture
def zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def seconds(df):
    return [r[0] for r in df.select(F.unix_seconds("timestamp")).sort("timestamp").collect()]


def test_times_are_in_utc_in_any_session_zone(spark, zone, tmp_path):
    day = int(START.timestamp())
    hours = spark.createDataFrame([((day + 3600 * k) * 1000, *[1.0] * 4, 7.0, k) for k in range(24)], "ms long, open double, high double, low double, close double, volume double, arrival long")
    east = dt.timezone(dt.timedelta(hours=8))
    for end, n in ((dt.datetime(2024, 1, 1, 10, tzinfo=east), 3), ("2024-01-01T10:00:00+08:00", 3), (dt.datetime(2024, 1, 1, 10), 11), ("2024-01-01 10:00:00", 11), (dt.date(2024, 1, 1), 1)):
        assert seconds(normalise.from_ccxt(hours, end)) == [day + 3600 * k for k in range(n)]
    prices = ", 1.0D as Open, 2.0D as High, 0.5D as Low, 1.5D as Close, 10.0D as Volume"
    for column in ("timestamp_ntz'2024-01-01 00:00:00' as Date", "date'2024-01-01' as Date", "'2024-01-01' as Date", "timestamp'2024-01-01 00:00:00Z' as Datetime", "timestamp_ntz'2024-01-01 00:00:00' as Datetime"):
        assert seconds(normalise.from_yahoo(spark.sql(f"SELECT {column}{prices}"))) == [day]
    raw = spark.sql("SELECT '20240101' as trade_date, 1.0D as open, 2.0D as high, 0.5D as low, 1.5D as close, 10.0D as vol, 3.0D as amount")
    assert seconds(normalise.from_tushare(raw)) == [day]
    store = BarStore(spark, str(tmp_path))
    store.write(bars(spark), "test", "ABC", "1d")
    held = store.read_metadata("test", "ABC", "1d")
    assert held["start"] == "2024-01-01T00:00:00+00:00" and held["end"] == "2024-01-03T00:00:00+00:00"


def test_yahoo(spark):
    raw = pd.DataFrame({"Open": [1.0, None], "High": [2.0, 2.0], "Low": [0.5, 1.0], "Close": [1.5, 1.5], "Adj Close": [1.4, 1.4], "Volume": [10.0, 10.0], "Odd": [1, 2]}, index=pd.DatetimeIndex(["2024-01-01", "2024-01-02"], name="Date"))
    got = YahooSource(spark, lambda symbol, **how: raw).bars(Series("A", START, END))
    assert got.columns == [*COLUMNS, "adjusted_close", "Odd", "arrival"] and got.count() == 1
    with pytest.raises(DataProviderError, match="unsupported"):
        YahooSource(spark).bars(Series("A", START, END, Frequency.HOUR_4))
    with pytest.raises(DataProviderError, match="nothing"):
        YahooSource(spark, lambda symbol, **how: raw[:0]).bars(Series("A", START, END))


def test_ccxt_pages(spark):
    start = int(START.timestamp() * 1000)
    candles = [[start + k * 86_400_000, 1, 2, 0.5, 1.5, k] for k in range(5)]
    asked = []

    def page(symbol, timeframe, since, limit):
        asked.append(since)
        return [c for c in candles if c[0] >= since][:limit]

    got = CCXTSource(spark, page=2, candles=page).bars(Series("BTC/USDT", START, dt.datetime(2024, 1, 4, tzinfo=UTC)))
    assert [r.volume for r in got.collect()] == [0, 1, 2, 3] and len(asked) == 2
    twice = spark.createDataFrame([(start, *[1.0] * 4, 7.0, 1), (start, *[1.0] * 4, 8.0, 0)], "ms long, open double, high double, low double, close double, volume double, arrival long")
    assert [r.volume for r in normalise.from_ccxt(twice, END).collect()] == [8.0]
    with pytest.raises(DataProviderError):
        CCXTSource(spark, candles=lambda *a, **k: []).bars(Series("X", START, END))


def test_tushare(spark, monkeypatch):
    raw = pd.DataFrame({"trade_date": ["20240102", "20240101"], "open": [1.0, 1.0], "high": [2.0, 2.0], "low": [0.5, 0.5], "close": [1.0, 1.0], "vol": [5.0, 6.0], "amount": [7.0, 8.0], "ts_code": ["a", "a"]})
    asked = {}
    got = TushareSource(spark, lambda **how: asked.update(how) or raw).bars(Series("600519", START, END))
    assert got.columns == [*COLUMNS, "amount"] and [r.volume for r in got.collect()] == [6.0, 5.0]
    assert asked == {"ts_code": "600519.SH", "start_date": "20240101", "end_date": "20240131"}
    assert [TushareSource.code(s) for s in ("000001", "300750", "430001", "600519.sh")] == ["000001.SZ", "300750.SZ", "430001.BJ", "600519.SH"]
    with pytest.raises(ValueError):
        TushareSource.code("999999")
    monkeypatch.delenv("TUSHARE_TOKEN", raising=False)
    with pytest.raises(AuthenticationError):
        TushareSource(spark)


def test_command_line(spark, tmp_path, capsys):
    spark.conf.set("tidemark.data.root", str(tmp_path))
    cli.main(["download", "--symbol", "AAA", "--start", "2024-01-01", "--end", "2024-01-31"], spark, Fake(spark))
    assert "3 rows for AAA [fake, 1d]" in capsys.readouterr().out and (tmp_path / "raw/bars").exists()
    spark.conf.unset("tidemark.data.root")
