"""Points in time from the spellings that chat clients send."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?"
_OFFSET = r"(?:[zZ]|[+-]\d{2}(?::?\d{2})?)"
ISO = rf"^{_DATE}(?:[tT ]+{_CLOCK}\s*{_OFFSET}?)?$"
EPOCH = r"^-?\d{1,11}(?:\.\d{1,9})?$"
EPOCH_MILLIS = r"^\d{12,14}$"


def instant(c: Column) -> Column:
    """ISO-8601 (blank or T, with or without fraction and offset; UTC where none is given) or epoch seconds
    (milliseconds from 12 digits on) as a timestamp; null for anything else, such as days that do not exist."""
    s = F.trim(c)
    # one spelling: T, a full clock, a point before the fraction of at most six digits, an offset with a colon
    iso = F.regexp_replace(F.upper(s), r"[T ]+(?=\d{2}:)", "T")
    iso = F.regexp_replace(iso, ",", ".")
    iso = F.regexp_replace(iso, r"\s+", "")
    iso = F.regexp_replace(iso, r"(\.\d{6})\d+", "$1")
    iso = F.regexp_replace(iso, r"(T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)([+-]\d{2}):?(\d{2})?$", "$1$2:$3")
    iso = F.regexp_replace(iso, r"([+-]\d{2}):$", "$1:00")
    zoned = F.when(iso.rlike(r"T.*(Z|[+-]\d{2}:\d{2})$"), iso).when(iso.rlike("T"), F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    seconds = F.when(s.rlike(EPOCH_MILLIS), s.try_cast("decimal(20,6)") / 1000).otherwise(s.try_cast("decimal(20,6)"))
    micros = F.round(seconds * 1000000).cast("bigint")
    return F.when(s.rlike(ISO), zoned.try_cast("timestamp")).when(s.rlike(EPOCH) | s.rlike(EPOCH_MILLIS), F.timestamp_micros(micros))
