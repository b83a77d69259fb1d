"""License scan by diagonal voting (operator 3), DataFrame functions only.

Every rolling three-word window of a text is hashed and joined with the places of
all windows of the templates. A hit at word ``p`` of the text and word ``q`` of a
template votes for the diagonal ``p - q``, where that template would start. The
join compares the words themselves, so equal hashes of other words do not count.

A phrase stands where all its windows vote for one diagonal. A notice may have lost
or gained some words: neighbouring diagonals (at most GAP apart) are merged, and the
share of the notice's windows found on them is its score; a share of MIN_SHARE or
more gives its label.

The templates are a fixed list, so their side of the join is broadcast; ``find`` checks
its number of windows against MAX_WINDOWS. One window more, added to every text, hits an
entry of its own and carries the text's word count, so that each text is split once and
texts without any hit come out as well. Only hits are shuffled, by document.

Defined results: null and empty texts have no words; rows of equal doc_id and equal text
get the same result, once for each row; a null doc_id is a document like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.text import grams, lower_ascii, pieces

K = 3
GAP = 4
MIN_SHARE = 0.6
#: Windows of all templates together up to which they are broadcast (some 100 bytes each).
MAX_WINDOWS = 100_000

#: Word separators: all of ASCII but digits and letters.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
SEPARATOR_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Hash that stands for "end of the text"; hits at the last place of the list only.
END_HASH = 0


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


TEMPLATES = (
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
                    "software and associated documentation files the software to deal in the software "
                    "without restriction"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain "
                         "a copy of the license at"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public "
                    "license as published by the free software foundation"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are "
                    "permitted provided that the following conditions are met"),
)


def template_windows(spark, templates: Sequence[Template]) -> DataFrame:
    """(template, q, words, h) of every window of every template, and the entry for the end of a text."""
    rows = [(t, q, x.words[q:q + K]) for t, x in enumerate(templates) for q in range(len(x.words) - K + 1)]
    if len(rows) > MAX_WINDOWS:
        raise ValueError(f"{len(rows)} template windows; at most {MAX_WINDOWS} can be broadcast")
    made = spark.createDataFrame(rows, "template int, q int, t_words array<string>")
    end = spark.range(1).select(F.lit(-1).alias("template"), F.lit(0).alias("q"),
                                F.array().cast("array<string>").alias("t_words"),
                                F.lit(END_HASH).cast("bigint").alias("t_hash"))
    hashed = made.withColumn("t_hash", F.xxhash64(*[F.get("t_words", j) for j in range(K)]))
    return hashed.unionByName(end)


def hits(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """One row per row of ``docs``-keyed document: n_words, n_rows and the verified hits.

    Columns: doc_id, text_key, n_words, n_rows (rows with this doc_id and text) and
    hits, an array of (template, diagonal, q).
    """
    split = (docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                         pieces(lower_ascii(F.col("text")), SEPARATORS, SEPARATOR_RUN).alias("w"))
             .withColumn("h", F.concat(grams("w", K), F.array(F.lit(END_HASH).cast("bigint")))))
    # The list is never empty. The outer form keeps Spark from inferring a filter on its size,
    # which it would push below the splitting and so split the text again for every word.
    rolled = split.select("doc_id", "text_key", "w", F.size("h").alias("n"), F.posexplode_outer("h").alias("p", "hash"))
    voted = rolled.join(F.broadcast(template_windows(docs.sparkSession, templates)),
                        F.col("hash") == F.col("t_hash"))
    equal = F.col("p") < F.col("n") - 1
    for j in range(K):
        equal = equal & (F.get("w", F.col("p") + j) == F.get("t_words", F.lit(j)))
    end = (F.col("template") == -1) & (F.col("p") == F.col("n") - 1)
    vote = F.struct("template", (F.col("p") - F.col("q")).alias("diagonal"), "q")
    seen = voted.where(F.when(F.col("template") == -1, end).otherwise(equal)).select(
        "doc_id", "text_key", F.size("w").alias("n_words"), end.alias("at_end"), F.when(~end, vote).alias("vote"))
    return seen.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if("at_end").alias("n_rows"), F.sort_array(F.collect_set("vote")).alias("hits"))


def _of(t: int, q: int | None = None):
    """The hits of template ``t`` (and of its window ``q``)."""
    return F.filter("hits", lambda x: (x["template"] == t) & (F.lit(True) if q is None else x["q"] == q))


def _places(t: int, template: Template):
    """Starts of a phrase: diagonals for which all its windows vote."""
    found = None
    for q in range(len(template.words) - K + 1):
        voted = F.transform(_of(t, q), lambda x: x["diagonal"])
        found = voted if found is None else F.array_intersect(found, voted)
    return found


def _labelled(places, label: str):
    return F.transform(places, lambda p: F.struct(F.lit(label).alias("label"), p.alias("word")))


def _share(t: int, template: Template):
    """Largest share of a notice's windows on one group of neighbouring diagonals."""
    none = F.array().cast("array<int>")

    def step(acc, x):
        joined = x["diagonal"] - acc["last"] <= GAP
        on = F.when(joined, F.array_union(acc["on"], F.array(x["q"]))).otherwise(F.array(x["q"]))
        return F.struct(x["diagonal"].alias("last"), on.alias("on"),
                        F.greatest(acc["best"], F.size(on)).alias("best"))

    start = F.struct(F.lit(-2 ** 30).alias("last"), none.alias("on"), F.lit(0).alias("best"))
    return F.aggregate(_of(t), start, step, lambda acc: acc["best"] / F.lit(float(len(template.words) - K + 1)))


def find(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Places of phrases and labels of each document.

    Returns doc_id, n_words, places (array of (label, word) of all phrases), shares (array of
    (label, share) of all notices that were hit) and score (largest share, 1 for a phrase).
    """
    phrases = [(t, x) for t, x in enumerate(templates) if x.phrase]
    notices = [(t, x) for t, x in enumerate(templates) if not x.phrase]
    by_label = [_labelled(_places(t, x), x.label) for t, x in phrases]
    scored = [F.struct(F.lit(x.label).alias("label"), _share(t, x).alias("share")) for t, x in notices]
    found = hits(docs, templates)
    found = found.withColumn("places", F.flatten(F.array(*by_label)) if by_label else F.lit(None))
    found = found.withColumn("shares", F.filter(F.array(*scored), lambda x: x["share"] > 0))
    best = F.coalesce(F.array_max(F.transform("shares", lambda x: x["share"])), F.lit(0.0))
    found = found.withColumn("score", F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best))
    again = F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))
    return found.select("doc_id", "n_words", "places", "shares", "score", again.alias("copy")).drop("copy")
