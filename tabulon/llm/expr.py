"""Column expressions on text that several operators share. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def split_words(text: Column) -> Column:
    """The words of a text; a text without words gives an empty array."""
    bare = stripped(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+"))


def count_words(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    bare = stripped(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_CLASS + "+"))).cast("long")
