"""Functions for SQL: registered in a session by name, used with LATERAL or like any other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.beta import beta_cdf
from corpusloom.operators.chunks import recursive_split
from corpusloom.operators.lines import text_lines


class _Lines:
    def eval(self, text: str, longest: int):
        for n, line in enumerate(text_lines(text, longest)):
            yield n, line


class _Pieces:
    def eval(self, text: str, size: int):
        for n, piece in enumerate(recursive_split(text, size) if text else []):
            yield n, piece


def register(spark: SparkSession) -> None:
    """text_lines(text, longest) and text_pieces(text, size) as table functions, beta_cdf(x, a, b) as a function."""
    spark.udtf.register("text_lines", F.udtf(_Lines, returnType="line_no int, content string", useArrow=True))
    spark.udtf.register("text_pieces", F.udtf(_Pieces, returnType="piece int, content string", useArrow=True))

    @F.pandas_udf("double")
    def beta(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(float("nan"), index=x.index)
        for (p, q), part in pd.DataFrame({"x": x, "a": a, "b": b}).dropna().groupby(["a", "b"]):
            out[part.index] = beta_cdf(part["x"].to_numpy(), p, q)
        return out

    spark.udf.register("beta_cdf", beta)
