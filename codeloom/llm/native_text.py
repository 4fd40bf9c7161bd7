"""Word expressions shared by the native operators: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but digits, ASCII letters in lower case and code points from U+0080 on.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"  # a word of a text in whatever case


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() does it where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def spaced(text: Column) -> Column:
    """The words of a text, each between two single spaces: ' a b c '; one space where there are none, null being empty."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), SEPARATORS, " ")


def number_of_words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def count_words(padded: Column) -> Column:
    """Number of words of a spaced() string."""
    return (F.char_length(padded) - F.char_length(F.replace(padded, F.lit(" "), F.lit(""))) - 1).cast("long")


def words_of(padded: Column) -> Column:
    """Array of the words of a spaced() string, empty where there are none."""
    return F.when(F.char_length(padded) > 1, F.split(F.btrim(padded), " ")).otherwise(F.array().cast("array<string>"))
