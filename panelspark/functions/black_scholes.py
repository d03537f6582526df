"""Black-Scholes prices and implied volatilities, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LOW, HIGH, MOST_STEPS = 1e-4, 5.0, 100
# Cody's rational approximations (1969) of erf near 0 and of erfc in the middle and far out, lowest term last but one.
NEAR_TOP = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
NEAR_BOTTOM = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
MIDDLE_TOP = (
    5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
    1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8,
)
MIDDLE_BOTTOM = (
    1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
    4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
)
FAR_TOP = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
FAR_BOTTOM = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x: np.ndarray, top: tuple[float, ...], bottom: tuple[float, ...]) -> np.ndarray:
    """The quotient of two polynomials: ``top`` ends with its highest coefficient, ``bottom`` has 1 there."""
    a, b = top[-1] * x, x.copy()
    for c, d in zip(top[:-2], bottom[:-1], strict=True):
        a, b = (a + c) * x, (b + d) * x
    return (a + top[-2]) / (b + bottom[-1])


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function to about 15 digits, for whole arrays."""
    x = np.asarray(x, float)
    y = np.abs(x)
    out = np.where(np.isnan(x), np.nan, 0.0)
    near, far = y <= 0.46875, (y > 4) & (y < 27)
    middle = (y > 0.46875) & (y <= 4)
    out[near] = 1 - x[near] * _ratio(y[near] ** 2, NEAR_TOP, NEAR_BOTTOM)
    # exp(-y^2) in two steps, so that rounding of the square does no harm
    cut = np.trunc(np.where(far | middle, y, 0) * 16) / 16
    bell = np.exp(-cut * cut) * np.exp(-(y - cut) * (y + cut), where=far | middle, out=np.zeros_like(y))
    out[middle] = bell[middle] * _ratio(y[middle], MIDDLE_TOP, MIDDLE_BOTTOM)
    z = 1 / y[far] ** 2
    out[far] = bell[far] * (1 / math.sqrt(math.pi) - z * _ratio(z, FAR_TOP, FAR_BOTTOM)) / y[far]
    back = (x < 0) & ~near
    out[back] = 2 - out[back]
    return out


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, float) / math.sqrt(2))


def price(spot, strike, t, vol, call, rate: float = 0.0) -> np.ndarray:
    """The price; without time or volatility left it is the intrinsic value."""
    with np.errstate(divide="ignore", invalid="ignore"):
        s = vol * np.sqrt(t)
        d1 = (np.log(spot / strike) + rate * t) / s + s / 2
        due = strike * np.exp(-rate * t)
        a, b = normal_cdf(d1), normal_cdf(d1 - s)
        value = np.where(call, spot * a - due * b, due * (1 - b) - spot * (1 - a))
    intrinsic = np.where(call, np.maximum(spot - strike, 0), np.maximum(strike - spot, 0))
    return np.where((np.asarray(t) > 0) & (np.asarray(vol) > 0), value, intrinsic)


def slope(spot, strike, t, vol) -> np.ndarray:
    """How the price grows with the volatility (rate 0)."""
    s = vol * np.sqrt(t)
    d1 = np.log(spot / strike) / s + s / 2
    return spot * np.sqrt(t) * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)


def solve(p, s, k, y, c) -> np.ndarray:
    """The volatility of each price by Newton's steps inside a bracket, halved where a step leaves it; NaN where [LOW, HIGH] doesn't hold it."""
    out = np.full(len(p), np.nan)
    low, high = np.full(len(p), LOW), np.full(len(p), HIGH)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at = np.flatnonzero((price(s, k, y, low, c) <= p) & (price(s, k, y, high, c) >= p))
        vol = np.clip(np.sqrt(2 * np.abs(np.log(s / k)) / y), 0.05, 2.0)  # where the slope is steepest
        for _ in range(MOST_STEPS):
            if not len(at):
                break
            v, miss = vol[at], price(s[at], k[at], y[at], vol[at], c[at]) - p[at]
            low[at], high[at] = np.where(miss < 0, v, low[at]), np.where(miss < 0, high[at], v)
            step = v - miss / slope(s[at], k[at], y[at], v)
            new = np.where((step > low[at]) & (step < high[at]), step, (low[at] + high[at]) / 2)
            done = (miss == 0) | (np.abs(new - v) <= 1e-15 * v) | (high[at] - low[at] <= 2e-16 * high[at])
            vol[at] = np.where(miss == 0, v, new)
            out[at[done]] = vol[at[done]]
            at = at[~done]
        out[at] = vol[at]
    return out


@F.pandas_udf(DoubleType())
def _implied(premium: pd.Series, spot: pd.Series, strike: pd.Series, t: pd.Series, call: pd.Series) -> pd.Series:
    p, s, k, y, c = (x.to_numpy(float) for x in (premium, spot, strike, t, call))
    c, out = c > 0.5, np.full(len(p), np.nan)
    with np.errstate(invalid="ignore"):
        ok = (p > 0) & (s > 0) & (k > 0) & (y > 0) & (p >= np.where(c, np.maximum(s - k, 0), np.maximum(k - s, 0)))
    out[ok] = solve(p[ok], s[ok], k[ok], y[ok], c[ok])
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def _price(spot: pd.Series, strike: pd.Series, t: pd.Series, vol: pd.Series, call: pd.Series) -> pd.Series:
    s, k, y, v, c = (x.to_numpy(float) for x in (spot, strike, t, vol, call))
    out = price(s, k, y, v, c > 0.5)
    return pd.Series(out).where(~np.isnan(out), None)


def implied_volatility(premium: Column, spot: Column, strike: Column, t: Column, is_call: Column) -> Column:
    """The volatility at which the price is the premium; null where none in [1e-4, 5] is."""
    return _implied(*[c.cast("double") for c in (premium, spot, strike, t, is_call)])


def option_price(spot: Column, strike: Column, t: Column, volatility: Column, is_call: Column) -> Column:
    """The Black-Scholes price at rate 0."""
    return _price(*[c.cast("double") for c in (spot, strike, t, volatility, is_call)])
