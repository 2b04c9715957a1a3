"""All queries of the library by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import conversation, loading, search, storage, text

_PARTS = (text, search, storage, conversation, loading)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.SQL.items()}
flagship = search.flagship
