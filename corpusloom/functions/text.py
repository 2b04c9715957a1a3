"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
_INVISIBLE_LETTERS = "ᅟᅠㅤﾠ"
#: What stands for a missing value, in lower case, other characters replaced by one blank.
PLACEHOLDERS = (
    "null", "none", "nil", "nan", "na", "n a", "undefined", "unknown", "empty", "blank", "missing", "void", "tbd", "todo",
    "no response", "no answer", "no reply", "no value", "no data", "not available", "not applicable", "empty response", "empty answer", "missing value",
    "leer", "keine antwort", "nicht vorhanden", "keine angabe", "vide", "aucune réponse", "pas de réponse", "sans réponse", "non disponible",
    "vacío", "vacio", "sin respuesta", "no disponible", "nulo",
)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Letters and digits only, in lower case, all else one blank."""
    return F.trim(F.lower(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}]+|[{_INVISIBLE_LETTERS}]+", " ")))


def says_nothing(c: Column) -> Column:
    """Null, or only white space, invisible characters, punctuation or a placeholder; never null itself."""
    x = squeeze(c)
    return c.isNull() | (x == "") | x.isin(*PLACEHOLDERS)


def words(c: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
