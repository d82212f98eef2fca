"""Forgetting: stability, retrievability, status, and the three parts of the forget signal."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from .text import stripped


@dataclass(frozen=True)
class Decay:
    base_days: float = 7.0
    access: float = 1.0
    importance: float = 1.3
    consolidation: float = 2.0
    least: float = 0.1
    most: float = 365.0
    active: float = 0.7
    fading: float = 0.3
    weak: float = 0.1


#: Retrievability below which a memory is deleted.
FORGOTTEN = 0.05


@dataclass(frozen=True)
class Gate:
    noise: float = 0.4
    redundancy: float = 0.35
    obsolescence: float = 0.25
    threshold: float = 0.3


def consolidated() -> Column:
    return F.col("is_summary") | (F.size("consolidated_from") > 0)


def days(as_of: str, since: Column) -> Column:
    """Days from ``since`` to ``as_of``, fractions kept."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(F.lit(as_of).cast("timestamp_ntz")) - micros(since)) / F.lit(86400000000.0)


def stability(c: Decay = Decay(), merged: Column | None = None) -> Column:
    """F20; ``merged`` where consolidation is known."""
    merged = consolidated() if merged is None else merged
    s = c.base_days * (1 + c.access * F.log1p(F.col("access_count").cast("double")))
    s = s * F.when(F.col("importance") > 0.7, c.importance).otherwise(1.0) * F.when(merged, c.consolidation).otherwise(1.0)
    return F.greatest(F.lit(c.least), F.least(F.lit(c.most), s))


def stability_of(access_count: int, importance: float, consolidated: bool, c: Decay = Decay()) -> float:
    """F20 of one memory, for state that is kept row by row."""
    s = c.base_days * (1 + c.access * math.log1p(access_count))
    s *= c.importance if importance > 0.7 else 1.0
    s *= c.consolidation if consolidated else 1.0
    return max(c.least, min(c.most, s))


def retrievability(as_of: str, c: Decay = Decay()) -> Column:
    """from the last access, or else from ``when_ts``."""
    return F.exp(-F.greatest(F.lit(0.0), days(as_of, F.coalesce("last_accessed", "when_ts"))) / stability(c))


def status(r: Column, c: Decay = Decay()) -> Column:
    """F21."""
    return F.when(r >= c.active, "active").when(r >= c.fading, "fading").when(r >= c.weak, "weak").otherwise("forgotten")


def noise() -> Column:
    """F22."""
    size = F.length("what")
    return F.least(F.lit(1.0), (
        F.when(F.col("importance") < 0.3, 0.3).when(F.col("importance") < 0.5, 0.1).otherwise(0.0)
        + F.when(F.size("who") == 0, 0.2).otherwise(0.0)
        + F.when(size < 10, 0.2).when(size < 30, 0.1).otherwise(0.0)
        + F.when(stripped(F.lower("what")).isin(*L.GENERIC_WHATS), 0.2).otherwise(0.0)
        + F.when(~consolidated(), 0.1).otherwise(0.0)
    ))


def redundancy(similar: Column) -> Column:
    """F23 from the number of similar memories."""
    return F.when(similar >= 3, 0.5).when(similar >= 1, 0.2).otherwise(0.0)


def obsolescence(as_of: str, r: Column) -> Column:
    """whole days."""
    age = F.floor(days(as_of, F.col("when_ts")))
    idle = F.floor(days(as_of, F.coalesce("last_accessed", "when_ts")))
    old = F.when((age > 90) & (idle > 60), 0.4).when((age > 30) & (idle > 30), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), old + F.when(r < 0.2, 0.4).when(r < 0.4, 0.2).otherwise(0.0))


def signal(n: Column, r: Column, o: Column, g: Gate = Gate()) -> Column:
    """F25."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), g.noise * n + g.redundancy * r + g.obsolescence * o))
