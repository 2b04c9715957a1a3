"""The regularised incomplete beta function, for score transforms of rerankers."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape parameters of the two built-in transforms.
SHAPES = {"cohere": (0.4, 0.4), "voyage": (0.5, 1.8)}


def beta_cdf(x: np.ndarray, a: float, b: float, terms: int = 200) -> np.ndarray:
    """I_x(a, b) by the modified Lentz evaluation of its continued fraction; x outside [0, 1] is clipped, NaN stays NaN."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    turn = x > (a + 1) / (a + b + 2)
    out = np.empty_like(x)
    for side, (p, q), at in ((~turn, (a, b), x), (turn, (b, a), 1 - x)):
        z = at[side]
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d.copy()
        for m in range(1, terms):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + num / np.where(np.abs(c) < 1e-300, 1e-300, c)
                h *= c * d
        out[side] = np.where(z <= 0, 0.0, front * h)
    out[turn] = 1 - out[turn]
    out[x <= 0], out[x >= 1] = 0.0, 1.0
    return out


def transform(score: Column, model: str) -> Column:
    """A provider's score spread evenly over [0, 1]."""
    a, b = SHAPES[model]

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), np.nan, beta_cdf(x.fillna(0.0).to_numpy(), a, b)))

    return F.nullif(spread(score.cast("double")), F.lit(float("nan")))
