"""Fill-in-the-middle transformation (operator 13): a text is cut at two places and its parts change order.

A wavelet matrix over character classes answers where to cut. Each byte of a UTF-8 text has a class
(rest of a character, other character, blank, line end) and a bit that says whether a blank or the end
follows, three bits in all. Rank queries on these symbols combine into the counts that are needed:

* word ends: symbols that are no blank and are followed by one;
* line ends: the two symbols of class line end;
* characters: everything but the rest of a character.

A cut behind k units is the smallest place with k ends before it, found by bisection on ranks. All texts of
an Arrow batch stand in one buffer, so all their cuts are searched at once; a matrix takes under two bytes
for each byte of text, and at most ``CHUNK_BYTES`` (or one longer text) are in a matrix at a time.

Which form a text gets is decided from the hash of the seed and the id alone, so it doesn't depend on
order, partitions or repeated attempts.

Defined results: a null text is empty; an empty text, one that holds a mark, and one whose doc_id is
null stay plain; blanks at the end of a text are a unit of their own; a text of blanks is one unit. Repeated
rows give repeated results. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
CHUNK_BYTES = 8 << 20

#: Classes of bytes; a symbol is twice the class, plus one before a blank or the end of a text.
REST, OTHER, BLANK, LINE_END = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x80:0xC0] = REST
CLASSES[[0x20, *range(0x09, 0x0E)]] = BLANK
CLASSES[0x0A] = LINE_END
BITS = 3

#: Symbols that end a unit.
ENDS = {"words": (2 * REST + 1, 2 * OTHER + 1), "lines": (2 * LINE_END, 2 * LINE_END + 1)}
NO_CHARACTER = (2 * REST, 2 * REST + 1)


class _Bits:
    """A bit vector with the number of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols of ``bits`` bits: level by level, zeros go to the left and ones to the right."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.levels = []
        for bit in reversed(range(bits)):
            ones = symbols >> bit & 1
            vector = _Bits(ones)
            self.levels.append((bit, vector, len(symbols) - vector.ones))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def count(self, symbols: tuple[int, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often any of ``symbols`` stands in start..end (end excluded)."""
        total = np.zeros(len(start), np.int64)
        for symbol in symbols:
            low, high = start, end
            for bit, vector, zeros in self.levels:
                ones_low, ones_high = vector.rank(low), vector.rank(high)
                if symbol >> bit & 1:
                    low, high = zeros + ones_low, zeros + ones_high
                else:
                    low, high = low - ones_low, high - ones_high
            total += high - low
        return total

    def behind(self, symbols: tuple[int, ...], k: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The smallest place with ``k`` of ``symbols`` between it and ``start``; ``end`` where there are fewer."""
        low, high = start.copy(), end.copy()
        for _ in range(int((end - start).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            enough = self.count(symbols, start, middle) >= k
            high, low = np.where(enough, middle, high), np.where(enough | (low >= high), low, middle + 1)
        return high


def _symbols(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of the bytes of texts that end at ``ends`` (not empty ones)."""
    classes = CLASSES[data]
    follows = np.ones(len(data), np.uint8)
    follows[:-1] = classes[1:] >= BLANK
    follows[ends - 1] = 1
    return classes * 2 + follows


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str):
    """Units of each text, and characters before the first cut and between the two.

    ``data`` holds the UTF-8 bytes of texts that begin at ``offsets`` (one more than texts).
    """
    start, end = offsets[:-1], offsets[1:]
    kind = ENDS[unit]
    symbols = _symbols(data, end[end > start])
    matrix = WaveletMatrix(symbols)
    n = matrix.count(kind, start, end)
    last = symbols[np.maximum(end, 1) - 1] if len(symbols) else np.zeros(len(end), np.uint8)
    n += (end > start) & ~np.isin(last, kind)
    one, two = h1 % (n + 1), h2 % (n + 1)
    first = matrix.behind(kind, np.minimum(one, two), start, end)
    second = matrix.behind(kind, np.maximum(one, two), start, end)
    characters = lambda a, b: b - a - matrix.count(NO_CHARACTER, a, b)
    return n, characters(start, first), characters(first, second)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow array of texts without nulls."""
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets.astype(np.int64)


def _found(texts: pa.Array, h1: pa.Array, h2: pa.Array, unit: str) -> pa.Array:
    results, at = [], 0
    if len(texts):
        data, offsets = _buffers(texts)
        one, two = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            part = offsets[at:to + 1]
            results.append(cuts(data[part[0]:part[-1]], part - part[0], one[at:to], two[at:to], unit))
            at = to
    columns = [np.concatenate(x) for x in zip(*results, strict=True)] or [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], ["n", "prefix", "middle"])


def _cut(unit: str):
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        return _found(texts, h1, h2, unit)

    # annotations are names here, and the kind of function is told by them
    cut.__annotations__ = {"texts": pa.Array, "h1": pa.Array, "h2": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, "n bigint, prefix bigint, middle bigint")


def hashes(doc_id: Column, seed: int, n: int) -> list[Column]:
    """The first ``n`` groups of eight hex digits of the sha256 of ``seed:doc_id``, as integers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "words",
                marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, fim_text) of each text.

    ``rate`` of a hundred texts are cut, of these ``spm_rate`` with the suffix first (spm), others with the
    prefix first (psm); ``unit`` is "words" (with the blanks before them) or "lines".
    """
    p, s, m = map(F.lit, marks)
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed, 4)
    text = F.coalesce("text", F.lit(""))
    plain = (F.col("h3").isNull() | (F.col("h3") % 100 >= rate) | (F.col("text") == "")
             | F.contains("text", p) | F.contains("text", s) | F.contains("text", m))
    shaped = docs.select("doc_id", text.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    form = F.when(plain, "plain").otherwise(F.when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm"))
    cut = _cut(unit)("text", F.coalesce("h1", F.lit(0)), F.coalesce("h2", F.lit(0)))
    found = shaped.select("doc_id", "text", form.alias("form"), cut.alias("cut"))
    prefix = F.substring("text", F.lit(1), F.col("cut.prefix").cast("int"))
    middle = F.substring("text", (F.col("cut.prefix") + 1).cast("int"), F.col("cut.middle").cast("int"))
    suffix = F.substring("text", (F.col("cut.prefix") + F.col("cut.middle") + 1).cast("int"), F.length("text"))
    output = (F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text")))
    kept = lambda name: F.when(F.col("form") != "plain", F.col(f"cut.{name}"))
    return found.select("doc_id", "cut.n", "form", kept("prefix").alias("prefix_chars"),
                        kept("middle").alias("middle_chars"), output.alias("fim_text"))


def restored(fim_text: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a row of ``fill_middle`` came from. No text that was cut holds a mark."""
    parts = F.split(fim_text, "|".join(map(re.escape, marks)))
    part = lambda *order: F.concat(*[F.get(parts, i) for i in order])
    return (F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).otherwise(fim_text))
