"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enclosed_name(text: Column, prefix: str, suffix: str = "") -> Column:
    """What stands between a prefix and a suffix, trimmed; null where the text does not have both."""
    inner = F.substr(text, F.lit(len(prefix) + 1), F.length(text) - F.lit(len(prefix) + len(suffix)))
    return F.when(F.startswith(text, F.lit(prefix)) & F.endswith(text, F.lit(suffix)), F.trim(inner))


def collapse_breaks(text: Column) -> Column:
    """Runs of line breaks and tabs as one blank."""
    return F.regexp_replace(text, r"[\n\r\t\f]+", " ")


def words(text: Column, separator: str = " ") -> Column:
    """Parts between separators, without empty ones."""
    return F.filter(F.split(text, separator), lambda w: w != "")


def cut_out(text: Column, start: Column, size: Column) -> Column:
    """The text without ``size`` characters from ``start`` (0 is the first)."""
    return F.concat(F.substr(text, F.lit(1), start), F.substr(text, start + size + F.lit(1)))


def index_of(text: Column, char: str, start: Column) -> Column:
    """Place of a string from ``start`` on (0 is the first), or -1."""
    return F.call_function("locate", F.lit(char), text, start + F.lit(1)) - F.lit(1)


def leading_count(text: Column, char: str) -> Column:
    """How often a character stands at the beginning."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(char)))


def either_case(text: Column) -> Column:
    """A pattern that matches the letters of a text in either case."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.lower(c) != F.upper(c), F.concat(F.lit("["), F.lower(c), F.upper(c), F.lit("]"))).otherwise(c)), "")
