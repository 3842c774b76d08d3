"""Symmetrical components of three-phase quantities (Fortescue, 1918) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TURN = 2 * math.pi / 3


def _magnitude(parts: list[tuple[Column, Column]]) -> Column:
    re = sum((m * F.cos(a) for m, a in parts[1:]), parts[0][0] * F.cos(parts[0][1]))
    im = sum((m * F.sin(a) for m, a in parts[1:]), parts[0][0] * F.sin(parts[0][1]))
    return F.sqrt(re * re + im * im) / 3


def symmetrical_components(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Zero, positive and negative sequence magnitudes of three phasors (magnitude, angle in radians)."""
    (ma, aa), (mb, ab), (mc, ac) = a, b, c
    zero = _magnitude([(ma, aa), (mb, ab), (mc, ac)])
    positive = _magnitude([(ma, aa), (mb, ab + _TURN), (mc, ac - _TURN)])
    negative = _magnitude([(ma, aa), (mb, ab - _TURN), (mc, ac + _TURN)])
    return zero, positive, negative


def unbalance_percent(a: Column, b: Column, c: Column) -> Column:
    """Negative over positive sequence in percent for phases a third of a turn apart; null if all are zero."""
    zero = F.lit(0.0)
    _, positive, negative = symmetrical_components((a, zero), (b, zero - _TURN), (c, zero + _TURN))
    return F.when(positive > 0, 100 * negative / positive)


def imbalance_percent(a: Column, b: Column, c: Column, least: float = 1e-6) -> Column:
    """The greatest deviation of three magnitudes from their mean, in percent of it; null for a mean near 0."""
    mean = (a + b + c) / 3
    return F.when(mean > least, 100 * F.greatest(F.abs(a - mean), F.abs(b - mean), F.abs(c - mean)) / mean)
