"""Reranking of ranked lists (query_id, rank, …, similarity)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.beta import transform

FLAT_SIMILARITY = 0.8


def keep_order(results: DataFrame, ignore_absolute_relevance: bool = False) -> DataFrame:
    """The lists as they are; with ignore_absolute_relevance every similarity becomes 0.8."""
    return results.withColumn("similarity", F.lit(FLAT_SIMILARITY)) if ignore_absolute_relevance else results


def by_scorer(results: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], model: str | None = None, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """The lists in the order of an injected scorer(queries, texts) -> scores in [0, 1]; `model` names a transform of the scores.

    Ties keep their former order; a query without results stays without.
    """

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(scorer(query.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    scored = results.withColumn("__score", score(F.col(query_col), F.col(text_col)))
    order = Window.partitionBy("query_id").orderBy(F.col("__score").desc(), F.col("rank"))
    value = transform(F.col("__score"), model) if model else F.col("__score")
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).withColumn("similarity", value).drop("__score")


def shared_words(queries: list[str], texts: list[str]) -> list[float]:
    """The default scorer without a model: share of the query's words that the text holds."""
    out = []
    for q, t in zip(queries, texts):
        asked, held = set(q.lower().split()), set(t.lower().split())
        out.append(len(asked & held) / len(asked) if asked else 0.0)
    return out
