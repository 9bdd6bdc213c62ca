"""Trading costs as column expressions: a model turns the columns of a trade into the columns of its cost.

Trades are rows (symbol, side, quantity, price). A model's parameters become literals, so that an estimate is one projection.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import REBALANCES

BPS = 10_000.0
#: The components of a cost, in the order in which they are added up.
COMPONENTS = ("commission", "stamp_duty", "transfer_fee", "slippage", "impact", "funding", "other")
NO_SLIPPAGE = "no slippage model (zero slippage assumed)"
log = logging.getLogger("tidemark")


def notional() -> Column:
    return F.col("price") * F.col("quantity")


def valid_trade() -> Column:
    """Quantity and price above 0, as NOT (x <= 0), so that a NaN passes."""
    nan_safe = lambda c: F.isnan(c) | ~(c <= 0)
    return nan_safe(F.col("quantity").cast("double")) & nan_safe(F.col("price").cast("double"))


def check_trades(trades: DataFrame) -> DataFrame:
    """The trades, with an error raised on the first that isn't valid."""
    bad = F.raise_error(F.concat(F.lit("quantity and price must be > 0: "), F.col("symbol")))
    return trades.withColumn("quantity", F.when(valid_trade(), F.col("quantity")).otherwise(bad.cast("double")))


def total(parts: dict[str, Column] | None = None) -> Column:
    """The sum of the components, in order."""
    out = None
    for name in COMPONENTS:
        c = F.col(name) if parts is None else parts[name]
        out = c if out is None else out + c
    return out


def at_least_0(name: str, component: Column) -> Column:
    """The component, with an error raised where it is negative; null and NaN pass."""
    return F.when(component < 0, F.raise_error(F.concat(F.lit(f"{name} must be >= 0, got "), component.cast("string"))).cast("double")).otherwise(component)


def bps_of(cost: Column, of: Column) -> Column:
    """Cost in basis points of a notional above 0; null otherwise."""
    return F.when(of > 0, cost / of * BPS)


def _at_least_0(model: object, *names: str) -> None:
    for name in names:
        value = getattr(model, name)
        if value < 0:
            raise ValueError(f"{type(model).__name__}.{name} must be >= 0, got {value}")


class Slippage(Protocol):
    def expr(self) -> Column: ...


@dataclass(frozen=True)
class FixedBps:
    bps: float = 5.0

    def __post_init__(self):
        _at_least_0(self, "bps")

    def expr(self) -> Column:
        return notional() * self.bps / BPS


@dataclass(frozen=True)
class HalfSpread:
    spread_bps: float = 10.0

    def __post_init__(self):
        _at_least_0(self, "spread_bps")

    def expr(self) -> Column:
        return notional() * (self.spread_bps / 2.0) / BPS


@dataclass(frozen=True)
class SquareRootImpact:
    """notional * coefficient * sqrt(quantity / adv); adv is a number or a column's name, and null means no impact.

    The result is booked as slippage.
    """

    coefficient_bps: float = 10.0
    adv: float | str | None = None

    def __post_init__(self):
        _at_least_0(self, "coefficient_bps")
        if isinstance(self.adv, (int, float)) and self.adv <= 0:
            raise ValueError(f"SquareRootImpact.adv must be > 0, got {self.adv}")

    def expr(self) -> Column:
        if self.adv is None:
            return F.lit(0.0)
        adv = F.col(self.adv) if isinstance(self.adv, str) else F.lit(float(self.adv))
        safe = F.when(adv <= 0, F.raise_error(F.lit("adv must be > 0")).cast("double")).otherwise(adv)
        return F.when(adv.isNull(), F.lit(0.0)).otherwise(notional() * self.coefficient_bps * F.sqrt(F.col("quantity") / safe) / BPS)


class CostModel:
    """A model gives the components that aren't 0, and notes (null for none)."""

    slippage: Slippage | None = None

    def parts(self) -> dict[str, Column]:
        raise NotImplementedError

    def notes(self) -> list[Column]:
        return []

    def breakdown(self) -> dict[str, Column]:
        """All components; a negative one is an error."""
        given = self.parts() | ({"slippage": self.slippage.expr()} if self.slippage is not None else {})
        return {c: at_least_0(c, given[c]) if c in given else F.lit(0.0) for c in COMPONENTS}

    def estimate(self, trades: DataFrame) -> DataFrame:
        """The trades with their components, total, notional, bps and notes."""
        costed = trades.withColumns(self.breakdown()).withColumn("notional", notional())
        costed = costed.withColumn("total", total()).withColumn("bps", bps_of(F.col("total"), F.col("notional")))
        return costed.withColumn("notes", F.array_compact(F.array(*self.notes())) if self.notes() else F.array().cast("array<string>"))

    def _slippage_note(self) -> Column:
        return F.lit(NO_SLIPPAGE if self.slippage is None else None).cast("string")


def _selling(value: Column) -> Column:
    return F.when(F.col("side") == "sell", value).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class AShare(CostModel):
    commission_bps: float = 2.5
    min_commission: float = 5.0
    stamp_duty_bps: float = 10.0
    transfer_fee_bps: float = 0.2
    slippage: Slippage | None = None

    def __post_init__(self):
        _at_least_0(self, "commission_bps", "min_commission", "stamp_duty_bps", "transfer_fee_bps")

    def parts(self) -> dict[str, Column]:
        return {
            "commission": F.greatest(notional() * self.commission_bps / BPS, F.lit(self.min_commission)),
            "stamp_duty": _selling(notional() * self.stamp_duty_bps / BPS),
            "transfer_fee": notional() * self.transfer_fee_bps / BPS,
        }

    def notes(self) -> list[Column]:
        return [self._slippage_note()]


@dataclass(frozen=True)
class USStock(CostModel):
    mode: str = "bps"
    commission_bps: float = 0.0
    commission_per_share: float = 0.005
    max_commission_pct: float = 0.01
    min_commission: float = 0.0
    sec_fee_bps: float = 0.278
    taf_per_share: float = 0.000166
    slippage: Slippage | None = None

    def __post_init__(self):
        if self.mode not in ("bps", "per_share"):
            raise ValueError(f"USStock.mode must be bps or per_share, got {self.mode}")
        _at_least_0(self, "commission_bps", "commission_per_share", "max_commission_pct", "min_commission", "sec_fee_bps", "taf_per_share")

    def parts(self) -> dict[str, Column]:
        if self.mode == "bps":
            base = notional() * self.commission_bps / BPS
        else:
            base = F.least(F.col("quantity") * self.commission_per_share, notional() * self.max_commission_pct)
        return {
            "commission": F.greatest(base, F.lit(self.min_commission)),
            "other": _selling(notional() * self.sec_fee_bps / BPS + F.col("quantity") * self.taf_per_share),
        }

    def notes(self) -> list[Column]:
        return [self._slippage_note()]


@dataclass(frozen=True)
class CryptoSpot(CostModel):
    maker_bps: float = 10.0
    taker_bps: float = 10.0
    is_maker: bool = False
    slippage: Slippage | None = None

    def __post_init__(self):
        _at_least_0(self, "maker_bps", "taker_bps")

    def fee_bps(self) -> float:
        return self.maker_bps if self.is_maker else self.taker_bps

    def fill(self) -> str:
        return "maker" if self.is_maker else "taker"

    def parts(self) -> dict[str, Column]:
        return {"commission": notional() * self.fee_bps() / BPS}

    def notes(self) -> list[Column]:
        return [F.lit(f"{self.fill()} fill at {self.fee_bps():.2f} bps")]


@dataclass(frozen=True)
class CryptoPerp(CryptoSpot):
    """Spot-like fees, and the magnitude of funding over the intervals held."""

    maker_bps: float = 2.0
    taker_bps: float = 5.0
    funding_rate: float = 0.0
    hold_intervals: int = 0

    def __post_init__(self):
        _at_least_0(self, "maker_bps", "taker_bps", "hold_intervals")

    def parts(self) -> dict[str, Column]:
        return super().parts() | {"funding": F.lit(abs(self.funding_rate) * self.hold_intervals) * notional()}

    def notes(self) -> list[Column]:
        return [F.lit(f"{self.fill()} fill, {self.hold_intervals} funding intervals")]


@dataclass(frozen=True)
class Futures(CostModel):
    mode: str = "per_contract"
    commission_per_contract: float = 5.0
    commission_bps: float = 0.3
    close_today_multiplier: float = 1.0
    slippage: Slippage | None = None

    def __post_init__(self):
        if self.mode not in ("per_contract", "bps"):
            raise ValueError(f"Futures.mode must be per_contract or bps, got {self.mode}")
        _at_least_0(self, "commission_per_contract", "commission_bps", "close_today_multiplier")

    def parts(self) -> dict[str, Column]:
        base = F.col("quantity") * self.commission_per_contract if self.mode == "per_contract" else notional() * self.commission_bps / BPS
        return {"commission": base * self.close_today_multiplier}

    def notes(self) -> list[Column]:
        note = f"close-today multiplier {self.close_today_multiplier}x applied" if self.close_today_multiplier != 1.0 else None
        return [F.lit(note).cast("string")]


def reference_trades(spark: SparkSession, price: float = 100.0, quantity: float = 1000.0) -> DataFrame:
    """A buy and a sell of the reference size."""
    if price <= 0 or quantity <= 0:
        raise ValueError("reference price and quantity must be > 0")
    return spark.createDataFrame(
        [("REF", side, float(quantity), float(price)) for side in ("buy", "sell")], "symbol string, side string, quantity double, price double"
    )


def round_trip(spark: SparkSession, models: dict[str, CostModel], price: float = 100.0, quantity: float = 1000.0) -> DataFrame:
    """(model, round_trip_bps): the bps of the buy and of the sell, by model."""
    trades = reference_trades(spark, price, quantity)
    out = None
    for name, model in models.items():
        one = model.estimate(trades).agg(F.sum("bps").alias("round_trip_bps")).select(F.lit(name).alias("model"), "round_trip_bps")
        out = one if out is None else out.unionByName(one)
    return out


def rebalance_frequencies(spark: SparkSession) -> DataFrame:
    """(frequency, rebalances): a few fixed rows."""
    return spark.createDataFrame(list(REBALANCES.items()), "frequency string, rebalances double")


def annualise(turnover: DataFrame, two_way: bool = True) -> DataFrame:
    """Annual cost from (annual_turnover, round_trip_bps): half a round trip for each unit of two-way turnover, or a whole one
    for each unit of round trips. Negative turnover is an error."""
    t = F.when(F.col("annual_turnover") < 0, F.raise_error(F.lit("turnover must be >= 0")).cast("double")).otherwise(F.col("annual_turnover"))
    bps = t * F.col("round_trip_bps") / 2.0 if two_way else t * F.col("round_trip_bps")
    return turnover.withColumn("annual_cost_bps", bps).withColumn("annual_cost_fraction", F.col("annual_cost_bps") / BPS)


def annualise_by_frequency(per_rebalance: DataFrame, two_way: bool = True) -> DataFrame:
    """Annual cost from (frequency, turnover_per_rebalance, round_trip_bps); an unknown frequency is an error."""
    lookup = F.create_map(*[F.lit(x) for pair in REBALANCES.items() for x in pair])
    rebalances = F.coalesce(F.try_element_at(lookup, F.col("frequency")), F.raise_error(F.concat(F.lit("unknown frequency "), F.col("frequency"))).cast("double"))
    yearly = per_rebalance.withColumn("rebalances_per_year", rebalances).withColumn(
        "annual_turnover", F.col("turnover_per_rebalance") * F.col("rebalances_per_year")
    )
    once = F.col("turnover_per_rebalance") * F.col("round_trip_bps")
    return annualise(yearly, two_way).withColumn("cost_per_rebalance_bps", once / 2.0 if two_way else once)


class AnnualCostCalculator:
    """Scalars for one model, from one job over the two reference trades."""

    def __init__(self, spark: SparkSession, model: CostModel, reference_price: float = 100.0, reference_quantity: float = 1000.0):
        self.spark, self.model = spark, model
        self.price, self.quantity = reference_price, reference_quantity
        reference_trades(spark, reference_price, reference_quantity)

    def round_trip_bps(self) -> float:
        found = float(round_trip(self.spark, {"model": self.model}, self.price, self.quantity).first()["round_trip_bps"])
        if found == 0:
            log.warning("round trip costs nothing: %s", self.model)
        return found

    def annual_cost(self, annual_turnover: float, round_trip: bool = False) -> dict[str, float | None]:
        if annual_turnover < 0:
            raise ValueError(f"annual_turnover must be >= 0, got {annual_turnover}")
        bps = annual_turnover * self.round_trip_bps() / (1.0 if round_trip else 2.0)
        return {
            "annual_turnover": annual_turnover,
            "rebalances_per_year": None,
            "cost_per_rebalance_bps": None,
            "annual_cost_bps": bps,
            "annual_cost_fraction": bps / BPS,
        }

    def annual_cost_by_frequency(self, turnover_per_rebalance: float, frequency: str, round_trip: bool = False) -> dict[str, float | None]:
        if turnover_per_rebalance < 0:
            raise ValueError(f"turnover_per_rebalance must be >= 0, got {turnover_per_rebalance}")
        if frequency not in REBALANCES:
            raise ValueError(f"unknown frequency {frequency}")
        n = REBALANCES[frequency]
        cost = self.annual_cost(turnover_per_rebalance * n, round_trip)
        return cost | {"rebalances_per_year": n, "cost_per_rebalance_bps": cost["annual_cost_bps"] / n}
