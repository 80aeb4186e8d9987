"""Learning-rate schedules as expressions of the epoch."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(epoch: Column, warmup: int, decay: int, start: float, peak: float, floor: float) -> Column:
    """Cosine rise from ``start`` to ``peak`` in ``warmup`` epochs, cosine fall to ``floor`` in ``decay``, then ``floor``."""
    rise = start + (peak - start) * 0.5 * (1 - F.cos(math.pi * epoch / max(1, warmup)))
    fall = floor + (peak - floor) * 0.5 * (1 + F.cos(math.pi * (epoch - warmup) / max(1, decay)))
    return F.when(epoch < warmup, rise).when(epoch < warmup + decay, fall).otherwise(floor)
