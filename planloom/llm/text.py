"""Column expressions on texts that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space and the control characters 0x09 to 0x0D, which separate words.
BLANKS = " \t\n\x0b\x0c\r"

#: Characters outside ASCII whose lower-case form holds an ASCII letter.
LOWER_TO_ASCII = ("İ", "K")


def pieces(text: Column, blanks: str, separators: str) -> Column:
    """What is left of ``text`` between runs of ``separators`` (a pattern);
    ``blanks`` are the characters of that class, trimmed first so that no empty
    piece can arise. A null text has no pieces."""
    trimmed = F.btrim(text, F.lit(blanks))
    return (F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>"))
            .otherwise(F.split(trimmed, separators)))


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D."""
    return pieces(text, BLANKS, r"[ \x09-\x0D]+")


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z lower-cased, to be compared with ASCII words only.

    ``lower`` also changes other letters, which never makes them ASCII save for
    the two characters of LOWER_TO_ASCII; texts with those are translated letter
    by letter.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = F.contains(text, F.lit(LOWER_TO_ASCII[0])) | F.contains(text, F.lit(LOWER_TO_ASCII[1]))
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def grams(words_column: str, k: int) -> Column:
    """64-bit hashes of the rolling ``k``-word windows of an array column.

    The column must be one that an earlier step has computed: inside the lambda
    it is read once for every word.
    """
    w = F.col(words_column)
    window = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return (F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), window))
            .otherwise(F.array().cast("array<bigint>")))
