"""Per-fold Gramians, from the pairwise moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from featurelab.functions.moments import fold_moments


def fold_gramians(df: DataFrame, cols: list[str], fold: str | None = None) -> dict[int, np.ndarray]:
    """{fold: X^T X} over ``cols``; fold None -> {0: ...}.  Each entry sums the rows in which
    both columns are present."""
    return {k: m.gramian() for k, m in fold_moments(df, cols, fold).items()}
