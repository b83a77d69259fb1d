"""Quality rules as a short-circuit cascade (operator 4), DataFrame functions only.

A rule is a measurement and a condition that rejects a document. ``plan_rules``
times every rule and counts what it rejects on a small sample, then orders the
rules by rejections per second. ``reject`` applies them in that order: a measurement
is only taken of documents that no earlier rule has rejected. Since a document is
kept only if no rule rejects it, the order changes the cost and never the verdict.

Defined results: a null text counts as empty; an empty text has no words and is
rejected as short; rows are judged one by one, so repeated rows get equal verdicts;
other columns are kept; working columns begin with ``_q_``, a prefix that the input must not use.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.text import BLANKS, grams, words
from planloom.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols per word, exclamation marks per word, characters per word, and the
#: share of repeated lines above which a text is no prose.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_BANGS_PER_WORD = 0.5
MAX_CHARS_PER_WORD = 30
MAX_DUP_LINE_PERCENT = 50
#: Documents used to estimate costs and rejections.
SAMPLE_ROWS = 512


@dataclass(frozen=True)
class Rule:
    """``measures``: steps of (column, expression), each seeing the columns before it."""

    name: str
    measures: Sequence[tuple[str, Callable[[], Column]]]
    rejects: Callable[[], Column]
    base: bool = False


def _count_of(pattern: str) -> Callable[[], Column]:
    return lambda: F.length("_q_text") - F.length(F.regexp_replace("_q_text", pattern, ""))


def _repeat_words() -> Column:
    """Words covered by windows whose hash occurs twice or more.

    ``_q_places`` holds (hash, position) in order, so equal windows are
    neighbours; each later window adds the words that the one before it in the
    text has not covered.
    """
    at = F.col("_q_places")
    same = lambda x, j: F.coalesce(F.get(at, j)["h"] == x["h"], F.lit(False))
    twice = F.filter(at, lambda x, j: (F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False))) | same(x, j + 1))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    return F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"))


def _places() -> Column:
    """(hash, position) of all windows in order, or none where no hash repeats."""
    g = F.col("_q_grams")
    pairs = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0))


def _with_word(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")


RULES = (
    Rule("short", (), lambda: F.col("_q_n_words") < MIN_WORDS, base=True),
    Rule("repetitive",
         (("_q_grams", lambda: grams("_q_words", 3)), ("_q_places", _places), ("_q_n_repeat_words", _repeat_words)),
         lambda: 100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"), base=True),
    Rule("symbols", (("_q_n_symbols", _count_of(r"[#*$%&|<>]")),),
         lambda: F.col("_q_n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("_q_n_words")),
    Rule("bangs", (("_q_bangs", _count_of("!")),),
         lambda: F.col("_q_bangs") > MAX_BANGS_PER_WORD * F.col("_q_n_words")),
    Rule("long_words", (("_q_word_chars", lambda: F.length(F.array_join("_q_words", ""))),),
         lambda: F.col("_q_word_chars") > MAX_CHARS_PER_WORD * F.col("_q_n_words")),
    Rule("dup_lines",
         (("_q_lines", lambda: _with_word(F.split("_q_text", "\n"))),
          ("_q_n_dup_lines", lambda: F.size("_q_lines") - F.size(F.array_distinct("_q_lines")))),
         lambda: 100 * F.col("_q_n_dup_lines") > MAX_DUP_LINE_PERCENT * F.size("_q_lines")),
)


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.withColumn("_q_text", text).withColumn("_q_words", words(F.col("_q_text")))
            .withColumn("_q_n_words", F.size("_q_words").cast("long")))


def _measured(df: DataFrame, rule: Rule, alive: Column | None) -> DataFrame:
    for name, expression in rule.measures:
        value = expression()
        df = df.withColumn(name, value if alive is None else F.when(alive, value))
    return df


def plan_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second of work, estimated on ``sample_rows`` documents.

    The sample is taken from the first partitions, without reading the rest, leaves
    out texts of over 100,000 characters so that the driver's memory is bounded, and
    only decides the order. Without any document the given order stays.
    """
    rows = docs.where(F.length("text") <= 100_000).select("text").limit(sample_rows).collect()
    if not rows:
        return list(rules)
    spark = docs.sparkSession
    sample = cut_lineage(_prepared(spark.createDataFrame(rows, "text string")))
    found = []
    for rule in rules:
        began = time.monotonic()
        judged = _measured(sample, rule, None).select(F.count_if(rule.rejects()))
        rejected = judged.first()[0]
        found.append(((rejected + 1) / (time.monotonic() - began), rule))
    return [rule for _, rule in sorted(found, key=lambda x: -x[0])]


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with all measurements of all rules (``_q_`` and their names), and
    ``_q_rejected_by``, the first of ``rules`` to reject (null: kept)."""
    df = _prepared(docs)
    for rule in rules:
        df = _measured(df, rule, None)
    first = F.coalesce(*[F.when(rule.rejects(), F.lit(rule.name)) for rule in rules])
    return df.withColumn("_q_rejected_by", first)


def reject(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` with ``_q_rejected_by`` (null: kept), measuring no more than needed.

    Only the columns of ``docs`` and that one are returned.
    """
    df = _prepared(docs.withColumn("_q_rejected_by", F.lit(None).cast("string")))
    for rule in plan_rules(docs) if rules is None else rules:
        alive = F.col("_q_rejected_by").isNull()
        df = _measured(df, rule, alive)
        df = df.withColumn("_q_rejected_by", F.coalesce(
            "_q_rejected_by", F.when(alive & rule.rejects(), F.lit(rule.name))))
    return df.select(*docs.columns, "_q_rejected_by")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    The row number is there to keep Spark from pushing the filter below the
    measurements, where it would split a text again for every word.
    """
    judged = reject(docs).withColumn("_q_row", F.monotonically_increasing_id())
    return judged.where(F.col("_q_rejected_by").isNull() & (F.col("_q_row") >= 0)).select(*docs.columns)
