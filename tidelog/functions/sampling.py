"""Trace sampling: a position in [0, 1) mixed from an id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Multipliers of the mix.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@F.pandas_udf(T.DoubleType())
def position(span_id: pd.Series) -> pd.Series:
    x = span_id.to_numpy(np.int64).view(np.uint64) * np.uint64(MIX[0])
    x = (x << np.uint64(31) | x >> np.uint64(33)) * np.uint64(MIX[1])
    return pd.Series((x >> np.uint64(11)) / 2.0**53)


def sampled(span_id: Column, ratio: float, always: Column) -> Column:
    """Whether a span is recorded: forced ones always, others by their position."""
    return always | (position(span_id) < min(max(ratio, 0.0), 1.0))
