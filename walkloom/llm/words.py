"""The word rule that the license and contamination operators share: runs of digits, lower-case ASCII
letters and everything beyond ASCII, after lower-casing A-Z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from walkloom.llm.common import lower_ascii

#: Fixed: everything between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a whole text with single blanks between them; empty for null."""
    return F.trim(F.regexp_replace(lower_ascii(text), BETWEEN, " "))


def words_of(spaced_text: Column) -> Column:
    return F.when(spaced_text == "", F.array().cast("array<string>")).otherwise(F.split(spaced_text, " "))


def count_of(spaced_text: Column) -> Column:
    blanks = F.octet_length(spaced_text) - F.octet_length(F.replace(spaced_text, F.lit(" "), F.lit("")))
    return (blanks + (spaced_text != "").cast("int")).cast("long")
