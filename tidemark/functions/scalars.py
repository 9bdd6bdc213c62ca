"""Scalar expressions: symbols, exchanges, frequencies, dates, and NaN-safe comparison."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import VENDOR_FREQUENCY

#: Exchange suffix by the first two digits of a code.
EXCHANGES = {".SH": ("60", "68", "90"), ".SZ": ("00", "30", "20"), ".BJ": ("43", "83", "87", "88")}


def safe_symbol(symbol: Column) -> Column:
    """A symbol as part of a path; lossy, so the raw symbol is kept as data."""
    return F.translate(symbol, "/:\\", "---")


def infer_exchange(symbol: Column, strict: bool = True) -> Column:
    """A-share codes with their exchange: as given (upper case) if they have one, else by prefix; unknown codes raise, or
    give null where ``strict`` is off."""
    unknown = F.raise_error(F.concat(F.lit("cannot infer the exchange of "), symbol)).cast("string") if strict else F.lit(None)
    out = F.when(F.contains(symbol, F.lit(".")), F.upper(symbol))
    for suffix, prefixes in EXCHANGES.items():
        out = out.when(F.substring(symbol, 1, 2).isin(*prefixes), F.concat(symbol, F.lit(suffix)))
    return out.when(symbol.isNull(), None).otherwise(unknown)


def vendor_frequency(frequency: Column, vendor: str) -> Column:
    """The vendor's name of a frequency; null if it has none."""
    out = F.lit(None).cast("string")
    for ours, theirs in VENDOR_FREQUENCY[vendor].items():
        out = F.when(frequency == ours, theirs).otherwise(out)
    return out


def coerce_date(value: Column, today: Column | None = None) -> Column:
    """The date part without a change of zone; today (UTC) for null."""
    return F.coalesce(F.to_date(value), F.current_date() if today is None else today)


def as_date(value: dt.date | dt.datetime | None) -> dt.date:
    if value is None:
        return dt.datetime.now(dt.UTC).date()
    return value.date() if isinstance(value, dt.datetime) else value


def missing(value: Column) -> Column:
    """Null or NaN."""
    return value.isNull() | F.isnan(value.cast("double"))


def known(predicate: Column, *operands: Column) -> Column:
    """A comparison that is false as soon as an operand is null or NaN."""
    unknown = F.lit(False)
    for o in operands:
        unknown = unknown | missing(o)
    return F.when(unknown, False).otherwise(predicate)


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, null for b = 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile as an expression: Acklam's rational approximation (relative error below 1.2e-9)."""
    # Coefficients of the published approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(x: Column, *terms: float) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + F.lit(t)
        return out

    def tail(q: Column) -> Column:
        return poly(q, *c) / poly(q, *d, 1.0)

    low, centre = 0.02425, p - 0.5
    middle = centre * poly(centre * centre, *a) / poly(centre * centre, *b, 1.0)
    return (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < low, tail(F.sqrt(-2 * F.log(p))))
        .when(p > 1 - low, -tail(F.sqrt(-2 * F.log(1 - p))))
        .otherwise(middle)
    )
