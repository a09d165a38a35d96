"""Per-series cross products, shared by the regression models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DOUBLES = ArrayType(DoubleType())


@F.pandas_udf(DOUBLES)
def cross_products(rows: pd.Series) -> list:
    """Aggregate rows ``z`` of one width to the flattened matrix ``sum(z z')``.

    ``z`` holds the regressors and, last, the target, so the matrix has everything that a least
    squares fit on any subset of the regressors needs. Its size depends on the width alone.
    """
    z = np.stack(rows.to_numpy())
    return (z.T @ z).ravel().tolist()


def unpack(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Flattened cross products to ``X'X``, ``X'y`` and ``y'y``."""
    width = int(round(len(flat) ** 0.5))
    full = np.asarray(flat, dtype=float).reshape(width, width)
    return full[:-1, :-1], full[:-1, -1], float(full[-1, -1])
