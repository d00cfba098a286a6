"""Scalar functions as column expressions: log probabilities, link functions, kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def log_factorial(y: Column) -> Column:
    """ln y! of a whole number; sequence() would count down below 1, hence the guard."""
    return F.when(y < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), y.cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double"))))


def log_rising(y: Column, k: Column) -> Column:
    """ln Gamma(y + k) - ln Gamma(k) of a whole y >= 0."""
    return F.when(y < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(0), y.cast("int") - 1), F.lit(0.0), lambda a, i: a + F.ln(k + i)))


def poisson_logpmf(y: Column, mean: Column, eps: float = FLOOR) -> Column:
    m = F.greatest(mean, F.lit(eps))
    return y * F.ln(m) - m - log_factorial(y)


def negbin_logpmf(y: Column, mean: Column, dispersion: float) -> Column:
    """NB2 with variance mean + mean^2 / dispersion; mean 0 with y 0 gives 0, the limit."""
    if dispersion <= 0:
        raise ValueError("dispersion must be positive")
    k = F.lit(float(dispersion))
    return log_rising(y, k) - log_factorial(y) + k * (F.ln(k) - F.ln(k + mean)) + F.when(y > 0, y * (F.ln(mean) - F.ln(k + mean))).otherwise(0.0)


def observed_logpmf(y_true: Column, y_obs: Column, p: float, false_rate: float) -> Column:
    """ln of P(y_obs | y_true) = sum over k of Binomial(k; y_true, p) * Poisson(y_obs - k; false_rate), by log-sum-exp.

    Certain detection (p = 1) leaves clutter alone, no clutter leaves thinning alone; the impossible gives -inf.
    """
    if not (0 < p <= 1 and false_rate >= 0):
        raise ValueError("p must be in (0, 1] and the false rate not negative")
    low = F.lit(float("-inf"))
    clutter = lambda n: n * math.log(false_rate) - false_rate - log_factorial(n)
    if p == 1:
        miss = y_obs - y_true
        return F.when(miss < 0, low).otherwise(clutter(miss) if false_rate else F.when(miss == 0, 0.0).otherwise(low))
    thin = lambda k: log_factorial(y_true) - log_factorial(k) - log_factorial(y_true - k) + k * math.log(p) + (y_true - k) * math.log1p(-p)
    if false_rate == 0:
        return F.when(y_obs > y_true, low).otherwise(thin(y_obs))
    terms = F.transform(F.sequence(F.lit(0), F.least(y_true, y_obs).cast("int")), lambda k: thin(k) + clutter(y_obs - k))
    top = F.array_max(terms)
    return top + F.ln(F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_softplus(x: float) -> float:
    """ln(e^x - 1 + 1e-6), continued by x itself where e^x would overflow."""
    return x if x > 700 else math.log(math.expm1(x) + 1e-6)


def exp_decay(d: Column, lengthscale: float) -> Column:
    if lengthscale <= 0:
        raise ValueError("lengthscale must be positive")
    return F.exp(-d / F.lit(float(lengthscale)))


def rbf(d2: Column, lengthscale: float) -> Column:
    return F.exp(d2 * F.lit(-0.5 / lengthscale**2))


def lag_kernel(n_lags: int, beta: float, normalize: bool = True) -> list[float]:
    """exp(-beta (l - 1)) for l = 1..n_lags, summing to 1 if normalised."""
    if n_lags <= 0:
        raise ValueError("n_lags must be positive")
    g = [math.exp(-beta * k) for k in range(n_lags)]
    return [x / sum(g) for x in g] if normalize else g


KernelFn = Callable[[np.ndarray], np.ndarray] | Callable[[Column], Column]
#: Distances a numpy kernel is tried on before it is shipped.
PROBE = np.array([[0.0, 1.0, 2.5], [10.0, 100.0, 1000.0]])


def check_kernel_fn(kernel: Callable[[np.ndarray], np.ndarray], name: str = "kernel") -> None:
    """TypeError unless it returns an array, ValueError unless of the same shape, finite and not negative."""
    out = kernel(PROBE.copy())
    if not isinstance(out, np.ndarray):
        raise TypeError(f"{name} must return an array")
    if out.shape != PROBE.shape:
        raise ValueError(f"{name} must keep the shape")
    if not np.isfinite(out).all():
        raise ValueError(f"{name} must return finite values")
    if (out < 0).any():
        raise ValueError(f"{name} must not return negative values")


def kernel_column(kernel: KernelFn, d: Column) -> Column:
    """A kernel of a distance column: a column function as it is (it stays in generated code), a numpy one by Arrow batches."""
    try:
        out = kernel(d)
        if isinstance(out, Column):
            return out
    except Exception:  # noqa: BLE001, S110 - a numpy function given a column may fail in any way
        pass
    check_kernel_fn(kernel)
    return F.pandas_udf(lambda s: s.__class__(kernel(s.to_numpy())), "double")(d)
