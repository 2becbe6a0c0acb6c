"""Hash-keyed random numbers: a pure function of (seed, trial, position), so plans can be recomputed anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed, *parts) -> Column:
    """MD5 of the parts joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(seed, *parts, lane: int = 0) -> Column:
    """Uniform in [0, 1) from eight hex digits; ``lane`` 0 to 3 picks which of the four in one digest."""
    return F.conv(F.substring(key(seed, *parts), 1 + 8 * lane, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed, *parts) -> Column:
    """Standard normal by Box and Muller from two lanes of one digest."""
    radius = F.sqrt(F.lit(-2.0) * F.log(1.0 - uniform(seed, *parts)))
    return radius * F.cos(2.0 * math.pi * uniform(seed, *parts, lane=1))


def choice(values: list, seed, *parts) -> Column:
    """One of ``values``, each as likely."""
    at = F.floor(uniform(seed, *parts) * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)
