"""String functions whose edge cases differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space.
CONTROL_SPACE = "\t\n\x0b\x0c\r"
SEPARATORS = "\x1c\x1d\x1e\x1f"
NEXT_LINE = "\x85"
UNICODE_SPACE = (
    " \xa0 "
    "           "
    "    　"
)
BOM = "﻿"

RECORD_SPACE = CONTROL_SPACE + SEPARATORS + UNICODE_SPACE + NEXT_LINE
REPLY_SPACE = CONTROL_SPACE + UNICODE_SPACE + BOM


def reply_is_yes(reply: Column) -> Column:
    """True for a reply that says YES, whatever its case and surrounding space; never null."""
    return F.coalesce(F.upper(F.btrim(reply, F.lit(REPLY_SPACE))) == "YES", F.lit(False))


def first_text(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


# Digits may be grouped by single underscores; no suffix letters, no hexadecimal, no NaN.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?)$"
)
_RECORD_SPACE_SQL = "".join(f"\\u{ord(c):04x}" for c in RECORD_SPACE)


def parse_number(text: str) -> str:
    """SQL expression: text to double; null for anything that is not a number, and for NaN.

    A plain cast takes type suffixes (``1d``) and refuses grouped digits (``1_000``),
    so the form is checked first.
    """
    bare = f"btrim({text}, '{_RECORD_SPACE_SQL}')"
    return f"""CASE WHEN {bare} RLIKE r'{_NUMBER}'
      THEN try_cast(replace({bare}, '_', '') AS DOUBLE) END"""


def clean_json_text(text: str) -> str:
    """SQL expression: strip the ends, then drop every U+FEFF."""
    return f"replace(btrim({text}, '{_RECORD_SPACE_SQL}'), '\\ufeff', '')"
