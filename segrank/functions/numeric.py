"""Numeric column helpers: quantisation, activations, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
QUANT_FACTOR = 100  # impacts are weights x 100, truncated toward zero
GMEAN_EPS = 1e-9     # guard before ceil so float noise on an integer cannot round up


def quantise(w: Column, factor: int = QUANT_FACTOR) -> Column:
    """float32 product, truncated toward zero, as INT."""
    return (w.cast("float") * F.lit(factor).cast("float")).cast("int")


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def log1p_relu(x: Column) -> Column:
    """E6 / E3 activation ``log1p(relu(x))``."""
    return F.log1p(relu(x))


def softplus(x: Column) -> Column:
    # overflow-safe: max(x,0) + log1p(exp(-|x|))
    return relu(x) + F.log1p(F.exp(-F.abs(x)))


def epic_term_importance(x: Column) -> Column:
    """E5: ``log1p(softplus(x))``."""
    return F.log1p(softplus(x))


def sigmoid(x: Column) -> Column:
    """E5 document importance."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def activation(x: Column, kind: str) -> Column:
    """E6 by name: relu, log1p_relu, identity, one."""
    if kind == "relu":
        return relu(x)
    if kind == "log1p_relu":
        return log1p_relu(x)
    if kind == "identity":
        return x
    if kind == "one":
        return F.lit(1.0)
    raise ValueError(f"unknown activation {kind!r}")


def r6(x: Column) -> Column:
    """Round scores to 6 decimals so engines that sum in a different order
    still agree on ranks and hashes."""
    return F.round(x.cast("double"), 6)
