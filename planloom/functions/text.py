"""String expressions: folding, dashes, numbers, scripts, colours of text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from planloom import constants as K

# fixed values: letters written out before accents are removed
LETTER_PAIRS = (("ø", "o"), ("æ", "ae"), ("å", "aa"), ("ö", "o"), ("ä", "ae"), ("ß", "ss"))

# fixed values: white space and dash characters stripped from both ends, and patterns
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
DASHES = "-\u2010\u2011\u2012\u2013\u2014\u2015"
DIMENSION_PATTERN = r"(?U)^\d{2,5}$"
# (?U): white space and digits of all scripts, a no-break space among them
AREA_PATTERN = r"(?U)^\d{1,3}(?:[,.]\d{1,2})?\s*m[²2]?$"
NUMERIC_RUN_PATTERN = r"^[0-9][0-9 .,:/\\-]*$"
NUMBER_TAIL_PATTERN = r"(?U)[\s\-‐-―]*(\d+)$"

#: Blocks whose compatibility forms are folded: Latin, super/subscripts,
#: letter-like signs, ligatures and full-width forms.
FOLD_BLOCKS = ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2070, 0x209C), (0x2100, 0x214F),
               (0xFB00, 0xFB06), (0xFF01, 0xFF5E))


def fold_word(s: str) -> str:
    """Plain-Python form of :func:`fold_text`, for vocabulary keys."""
    s = s.casefold()
    for a, b in LETTER_PAIRS:
        s = s.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) for translate, plus characters that fold to several."""
    single, several = [], []
    for lo, hi in FOLD_BLOCKS:
        for cp in range(lo, hi + 1):
            c = chr(cp)
            if unicodedata.category(c) == "Cn":
                continue
            out = fold_word(c)
            if out == c or c.lower() != c:
                continue
            (single if len(out) == 1 else several).append((c, out))
    return ("".join(c for c, _ in single), "".join(o for _, o in single), tuple(several))


def fold_text(s: Column) -> Column:
    """Lower case, Nordic letters written out, accents and forms removed."""
    src, dst, several = _fold_table()
    out = F.lower(s)
    for a, b in LETTER_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    plain = F.octet_length(s) == F.length(s)
    full = F.regexp_replace(F.translate(out, src, dst), r"\p{Mn}", "")
    for a, b in several:
        full = F.replace(full, F.lit(a), F.lit(b))
    return F.when(plain, out).otherwise(full)


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE_SPACE))


def strip_edge_dashes(s: Column) -> Column:
    """Trim white space, then dashes at both ends (no second trim)."""
    return F.btrim(strip(s), F.lit(DASHES))


def trailing_number(s: Column) -> tuple[Column, Column, Column]:
    """(head, separator, number): the separator becomes one space."""
    tail = F.regexp_extract(s, NUMBER_TAIL_PATTERN, 1)
    head = F.when(tail == "", s).otherwise(F.regexp_replace(s, NUMBER_TAIL_PATTERN, ""))
    return head, F.when(tail == "", "").otherwise(" "), tail


def split_trailing_number(s: Column) -> Column:
    head, sep, tail = trailing_number(s)
    return F.struct(head.alias("head"), sep.alias("sep"), tail.alias("number"))


def is_dimension(s: Column) -> Column:
    return s.rlike(DIMENSION_PATTERN)


def is_area(s: Column) -> Column:
    return s.rlike(AREA_PATTERN)


def dimension_warning(s: Column) -> Column:
    """Message for a dimension outside the plausible range, else NULL."""
    value = s.try_cast("int")
    text = F.format_string(
        f"Dimension of %d mm; expected {K.DIM_MIN_MM} to {K.DIM_MAX_MM} mm.", value)
    return F.when(is_dimension(s) & ~value.between(K.DIM_MIN_MM, K.DIM_MAX_MM), text)


def classify_numeric(s: Column) -> Column:
    """STRUCT<kind, warning>; kind is NULL for anything but numbers."""
    kind = F.when(is_dimension(s), "dimension").when(is_area(s), "area")
    return F.struct(kind.alias("kind"), dimension_warning(s).alias("warning"))


def is_numeric_run(s: Column) -> Column:
    return strip(s).rlike(NUMERIC_RUN_PATTERN)


def is_graphical_symbol(s: Column) -> Column:
    """No letter or digit at all."""
    return ~s.rlike(r"[\p{L}\p{N}]")


def is_wrong_script(s: Column) -> Column:
    ranges = "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in K.NON_LATIN_RANGES)
    return s.rlike(f"[{ranges}]")


def font_alias(name: Column, bold: Column, italic: Column) -> Column:
    """Base-14 alias. A name with "serif" counts as serif, "sans-serif" too."""
    low = F.lower(name)

    def pick(family):
        regular, slanted, heavy, both = K.FONT_ALIASES[family]
        return (F.when(bold & italic, both).when(bold, heavy)
                .when(italic, slanted).otherwise(regular))

    return (F.when(low.rlike("courier|mono"), pick("mono"))
            .when(low.rlike("times|serif|georgia|garamond"), pick("serif"))
            .otherwise(pick("sans")))


def luma(b: Column, g: Column, r: Column) -> Column:
    wb, wg, wr = K.LUMA_BGR
    return b * wb + g * wg + r * wr


def luma8(b: Column, g: Column, r: Column) -> Column:
    """The 8-bit form."""
    return F.round(luma(b, g, r)).cast("int")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def similarity(a: Column, b: Column) -> Column:
    """0..100: one minus edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return 100.0 * (1.0 - F.levenshtein(a, b) / longest)
