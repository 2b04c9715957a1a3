"""Log records and counts of the steps of a pipeline."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@contextmanager
def step(log: logging.Logger, name: str, **ids: str) -> Iterator[None]:
    """Start and end at INFO, the duration as duration_s, a failure with its traceback; ids (kb_id, doc_id, query_id) go along as extras."""
    began = time.monotonic()
    log.info("%s started", name, extra={"step": name, **ids})
    try:
        yield
    except Exception:
        log.exception("%s failed", name, extra={"step": name, "duration_s": time.monotonic() - began, **ids})
        raise
    log.info("%s ended", name, extra={"step": name, "duration_s": time.monotonic() - began, **ids})


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`rows`, and an observation that holds their number once they have been read; no second pass is made."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
