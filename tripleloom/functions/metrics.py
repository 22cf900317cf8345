"""Scalar metrics as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards a quotient against zero.
TINY = 1e-10
#: What an unknown cost counts as where a number is needed.
CENSORED = 1e18


def squash(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def q_error(true: Column, predicted: Column) -> Column:
    return F.greatest(true / (predicted + TINY), predicted / (true + TINY))


def q_error_log(log_true: Column, log_predicted: Column) -> Column:
    return F.exp(F.abs(log_true - log_predicted))


def quantile_huber(error: Column, tau: float, delta: float = 1.0) -> Column:
    """Huber loss of true - predicted, times 2 tau where too low and 2 (1 - tau) where too high."""
    size = F.abs(error)
    loss = F.when(size <= delta, 0.5 * error * error).otherwise(delta * (size - 0.5 * delta))
    return loss * F.when(error > 0, 2 * tau).otherwise(2 * (1 - tau))


def log10_cost(cost: Column) -> Column:
    return F.log10(F.greatest(cost, F.lit(1.0)))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def geometric_mean(x: Column) -> Column:
    """Over positive values; NULL if there are none."""
    return F.exp(F.avg(F.when(x > 0, F.ln(x))))


def shown(cost: Column, censored: Column) -> Column:
    return F.concat(F.when(censored, ">=").otherwise(""), F.format_string("%.3e", cost))


def orders_of_magnitude(a: Column, b: Column) -> Column:
    return F.log10(a / b)


def ramp(step: Column, start: float, end: float, steps: int) -> Column:
    """Linear from start to end, then flat."""
    return F.lit(start) + (end - start) * F.least(step / F.lit(float(steps)), F.lit(1.0))


def annealed(step: Column, steps: int, start: float, least: float) -> Column:
    """Temperature falling linearly from start, never under ``least``."""
    return F.greatest(F.lit(least), start * (1 - step / F.lit(float(max(1, steps)))))


def one_cycle(step: Column, steps: int, peak: float, warm: float = 0.2, start_div: float = 5.0, end_div: float = 20.0) -> Column:
    """A rate that rises by a cosine from peak / start_div to the peak and falls to a part of the start."""
    turn = max(1.0, warm * steps - 1)
    cosine = lambda a, b, x: b + (a - b) * (1 + F.cos(F.pi() * x)) / 2
    after = F.least(F.lit(1.0), (step - turn) / F.lit(max(1.0, steps - 1 - turn)))
    return F.when(step <= turn, cosine(peak / start_div, peak, step / F.lit(turn))).otherwise(cosine(peak, peak / start_div / end_div, after))
