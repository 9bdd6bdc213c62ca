import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs
from tidemark.plans.catalogue import MODELS, ROUND_TRIPS

SCHEMA = "symbol string, side string, quantity double, price double"


def one(spark, model, quantity, price, side="buy"):
    rows = spark.createDataFrame([("X", side, float(quantity), float(price))], SCHEMA)
    return model.estimate(rows).first()


def slip(spark, model, quantity, price):
    rows = spark.createDataFrame([("X", "buy", float(quantity), float(price))], SCHEMA)
    return rows.select(model.expr().alias("s")).first()["s"]


def test_slippage(spark):
    assert slip(spark, costs.FixedBps(5), 100, 100) == pytest.approx(5.0)
    assert slip(spark, costs.HalfSpread(20), 100, 100) == pytest.approx(10.0)
    impact = costs.SquareRootImpact(10, adv=10_000.0)
    assert slip(spark, impact, 400, 100) / slip(spark, impact, 100, 100) == pytest.approx(8.0)
    assert slip(spark, costs.SquareRootImpact(), 100, 100) == 0.0


def test_models(spark):
    cn = costs.AShare()
    assert one(spark, cn, 10, 100).commission == 5.0
    sell = one(spark, cn, 100, 1800, "sell")
    assert sell.stamp_duty == pytest.approx(180_000 * 10 / 1e4) and one(spark, cn, 100, 1800).stamp_duty == 0
    assert one(spark, costs.AShare(slippage=costs.FixedBps(3)), 100, 100).slippage == pytest.approx(3.0)
    assert one(spark, costs.USStock(commission_bps=5), 100, 200).commission == pytest.approx(10.0)
    assert one(spark, costs.USStock(mode="per_share"), 10_000, 0.01).commission == pytest.approx(1.0)
    us = one(spark, costs.USStock(), 100, 200, "sell")
    assert us.other == pytest.approx(20_000 * 0.278 / 1e4 + 100 * 0.000166) and one(spark, costs.USStock(), 100, 200).other == 0
    assert one(spark, costs.CryptoSpot(), 1, 60_000).commission == pytest.approx(60.0)
    perp = one(spark, costs.CryptoPerp(funding_rate=1e-4, hold_intervals=3), 1, 60_000)
    assert perp.funding == pytest.approx(18.0)
    assert one(spark, costs.CryptoPerp(funding_rate=-1e-4, hold_intervals=3), 1, 60_000).funding == pytest.approx(18.0)
    assert one(spark, costs.Futures(), 3, 3800).commission == pytest.approx(15.0)
    assert one(spark, costs.Futures(mode="bps"), 1, 10_000).commission == pytest.approx(0.3)
    today = one(spark, costs.Futures(close_today_multiplier=6.0), 2, 3500)
    assert today.commission == pytest.approx(6 * one(spark, costs.Futures(), 2, 3500).commission)
    assert today.notes == ["close-today multiplier 6.0x applied"] and perp.notes == ["taker fill, 3 funding intervals"]
    assert one(spark, cn, 10, 100).notes == [costs.NO_SLIPPAGE] and one(spark, costs.Futures(), 1, 1).notes == []


def test_breakdown_totals_and_bps(spark):
    row = spark.createDataFrame([tuple(float(k) for k in range(1, 8))], ", ".join(f"{c} double" for c in costs.COMPONENTS))
    assert row.select(costs.total().alias("t")).first().t == 28.0
    got = row.select(costs.bps_of(F.lit(10.0), F.lit(10_000.0)).alias("b"), costs.bps_of(F.lit(1.0), F.lit(0.0)).alias("n")).first()
    assert got.b == 10.0 and got.n is None


@pytest.mark.parametrize(
    "make",
    [
        lambda: costs.FixedBps(-1), lambda: costs.HalfSpread(-1), lambda: costs.SquareRootImpact(-1), lambda: costs.SquareRootImpact(adv=0.0),
        lambda: costs.AShare(commission_bps=-1), lambda: costs.USStock(mode="x"), lambda: costs.USStock(min_commission=-1),
        lambda: costs.CryptoSpot(maker_bps=-1), lambda: costs.CryptoPerp(hold_intervals=-1), lambda: costs.Futures(mode="x"),
        lambda: costs.Futures(close_today_multiplier=-1),
    ],
)
def test_parameters_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_trade_domain(spark):
    rows = spark.createDataFrame([("A", "buy", 1.0, 5.0), ("B", "buy", 0.0, 5.0), ("C", "buy", 1.0, -5.0), ("D", "buy", float("nan"), 5.0)], SCHEMA)
    assert {r.symbol: r.ok for r in rows.select("symbol", costs.valid_trade().alias("ok")).collect()} == {"A": True, "B": False, "C": False, "D": True}
    with pytest.raises(Exception, match="must be > 0"):
        costs.check_trades(rows).collect()


def test_round_trips(spark):
    got = {r.model: r.round_trip_bps for r in costs.round_trip(spark, MODELS).collect()}
    assert got == {k: pytest.approx(v) for k, v in ROUND_TRIPS.items()}


def test_annual_costs(spark):
    crypto = costs.AnnualCostCalculator(spark, costs.CryptoSpot())
    monthly = crypto.annual_cost_by_frequency(0.2, "monthly")
    assert monthly["annual_turnover"] == pytest.approx(2.4) and monthly["rebalances_per_year"] == 12
    assert monthly["annual_cost_bps"] == pytest.approx(24.0) and monthly["annual_cost_fraction"] == pytest.approx(0.0024)
    assert crypto.annual_cost_by_frequency(1.0, "daily")["annual_cost_bps"] == pytest.approx(2520.0)
    assert crypto.annual_cost(4.0)["annual_cost_bps"] == pytest.approx(2 * crypto.annual_cost(2.0)["annual_cost_bps"])
    assert crypto.annual_cost(2.0, round_trip=True)["annual_cost_bps"] == pytest.approx(crypto.annual_cost(4.0)["annual_cost_bps"])
    weekly = costs.AnnualCostCalculator(spark, costs.AShare()).annual_cost_by_frequency(0.1, "weekly")
    assert weekly["annual_turnover"] == pytest.approx(5.2) and weekly["rebalances_per_year"] == 52
    for bad in (lambda: crypto.annual_cost(-1), lambda: crypto.annual_cost_by_frequency(0.1, "hourly"), lambda: costs.AnnualCostCalculator(spark, costs.CryptoSpot(), reference_price=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="unknown frequency"):
        costs.annualise_by_frequency(spark.createDataFrame([("hourly", 0.1, 10.0)], "frequency string, turnover_per_rebalance double, round_trip_bps double")).collect()


class Rebate(costs.CostModel):
    def parts(self):
        return {"commission": F.lit(-1.0), "impact": F.lit(float("nan"))}


def test_negative_components_are_errors(spark):
    with pytest.raises(Exception, match="commission must be >= 0"):
        one(spark, Rebate(), 1, 1)

    class Fine(Rebate):
        def parts(self):
            return {"commission": F.lit(0.0), "impact": F.lit(None).cast("double")}

    assert one(spark, Fine(), 1, 1).commission == 0
