"""Line dedup by pairwise alignment (operator 8).

Lines of at least MIN_WORDS words are hashed (128 bits). Of the documents that share a
line, the first holder is the one with the smallest doc_id; every later one is paired with
it for that line. So a line that thousands hold makes as many pairs
as it has holders, no line is too frequent to count, and rare and frequent lines go one way.

Each pair is aligned by patience diff over the lines whose first holder is the earlier document:
equal lines at both ends, then those that are unique on both sides in their longest common order,
then the same between them; where no line is unique, the n-th of one side is taken for the n-th of the
other. Lines so aligned are deleted from the later document.

What is left of the shared lines of a document, as it stands there in another order than in their first holders, is paired
again: by the shared lines that stand two, four, eight ... in a row, of which a line left is the first or the last.
The first holder of such a row, which is rarer than its lines, is one more document to align with, until no line left
stands in a row that an earlier document has. So every round again makes two pairs for each line left at most.

With ``short_lines``, which the query and ``keep`` use, what is hashed and aligned are runs of lines: from each line with
a word, the shortest run forward and the shortest backward that has MIN_WORDS words (a line of so many is a run by
itself; a run has MIN_WORDS lines with words at most, and lines without a word don't count). So a common block of that many words
goes whole, its short lines at both ends too, also where all its lines are short. Lines without a word go where the next line
with one is deleted on both sides, or on one side at an end of the text. An exact copy of an earlier text of that many words goes
whole and takes no other part. Without ``short_lines``, lines of fewer words stay.

Only hashes and places are shuffled for this, and each text once, to be cut.

Defined results: a null text stays null and has no lines; null doc_ids are later than all others; rows with
equal doc_id and text are one document and treated alike; of equal doc_ids with different texts the one with
the smaller text hash is earlier. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from planloom.llm.shared import packed
from planloom.llm.text import words
from planloom.session import cut_lineage

MIN_WORDS = 5


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs``, sorted by the first number, in which the second rises too."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[i] = ends[at - 1] if at else -1
        tops[at:at + 1], ends[at:at + 1] = [j], [i]
    found, i = [], ends[-1] if ends else -1
    while i >= 0:
        found.append(pairs[i])
        i = back[i]
    return found[::-1]


def _anchors(a: Sequence, b: Sequence, where: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    a_from, a_to, b_from, b_to = where
    in_a, in_b = Counter(a[a_from:a_to]), Counter(b[b_from:b_to])
    single = {x for x, n in in_a.items() if n == 1 and in_b[x] == 1}
    if single:
        at = {b[j]: j for j in range(b_from, b_to) if b[j] in single}
        return _longest_rising([(i, at[a[i]]) for i in range(a_from, a_to) if a[i] in single])
    numbered, seen = {}, Counter()
    for j in range(b_from, b_to):
        numbered[b[j], seen[b[j]]] = j
        seen[b[j]] += 1
    seen, pairs = Counter(), []
    for i in range(a_from, a_to):
        j = numbered.get((a[i], seen[a[i]]))
        seen[a[i]] += 1
        if j is not None:
            pairs.append((i, j))
    return _longest_rising(pairs)


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (in a, in b) of lines that patience diff aligns, in order."""
    aligned, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a_from, a_to, b_from, b_to = todo.pop()
        while a_from < a_to and b_from < b_to and a[a_from] == b[b_from]:
            aligned.append((a_from, b_from))
            a_from, b_from = a_from + 1, b_from + 1
        while a_from < a_to and b_from < b_to and a[a_to - 1] == b[b_to - 1]:
            a_to, b_to = a_to - 1, b_to - 1
            aligned.append((a_to, b_to))
        if a_from == a_to or b_from == b_to:
            continue
        anchors = _anchors(a, b, (a_from, a_to, b_from, b_to))
        if not anchors:
            continue
        aligned += anchors
        for (i, j), (k, m) in zip([(a_from - 1, b_from - 1), *anchors], [*anchors, (a_to, b_to)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(aligned)


def _order_of(doc_id, text_key):
    """Sorts documents from early to late."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), text_key.alias("text_key"))


def _order(doc_id: str, text_key: str):
    return _order_of(F.col(doc_id), F.col(text_key))


def runs_of(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(hash, first line, last line) of the shortest runs of lines with ``min_words`` words, forward and backward from each
    line that has a word."""
    lines = [(i, x, n) for i, x in enumerate((text or "").encode("utf-8", "replace").split(b"\n"))
             if (n := len(x.split(None, min_words)))]
    spans = set()
    for step in (1, -1):
        for k in range(len(lines)):
            n, end = 0, k
            while 0 <= end < len(lines):
                n += lines[end][2]
                if n >= min_words:
                    spans.add((min(k, end), max(k, end)))
                    break
                end += step
    return [(xxhash.xxh3_128_digest(b"\n".join([x for _, x, _ in lines[a:b + 1]])), lines[a][0], lines[b][0])
            for a, b in sorted(spans)]


#: Texts whose runs are in Python's memory at a time.
_TEXTS_AT_ONCE = 200


def _runs(keyed: DataFrame, min_words: int) -> DataFrame:
    """(text_key, doc_id, line, place, last): a row for each run of each text of ``keyed`` (text_key, doc_id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                row, line, place, last = [], [], [], []
                for n, text in enumerate(part["text"]):  # one text at a time becomes a Python object
                    for x, a, b in runs_of(text.as_py(), min_words):
                        row.append(n)
                        line.append(x)
                        place.append(a)
                        last.append(b)
                row = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["text_key"].take(row), part["doc_id"].take(row), pa.array(line, pa.binary()),
                     pa.array(place, pa.int32()), pa.array(last, pa.int32())],
                    names=["text_key", "doc_id", "line", "place", "last"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select("text_key", "doc_id", "text").mapInArrow(
        find, f"text_key long, doc_id {kind}, line binary, place int, last int")


def copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, n_lines): documents whose text, of ``min_words`` words or more, an earlier one has too."""
    enough = rf"^[ \x09-\x0D]*(?:[^ \x09-\x0D]+[ \x09-\x0D]+){{{min_words - 1}}}[^ \x09-\x0D]"
    keyed = docs.where(F.col("text").rlike(enough)).select(
        _order_of(F.col("doc_id"), _key("text")).alias("doc"), F.md5("text").alias("digest"), F.length("text").alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    firsts = keyed.groupBy("digest", "n_chars").agg(F.min("doc").alias("first"), F.max("doc").alias("latest")).where("first <> latest")
    return cut_lineage(keyed.join(firsts, ["digest", "n_chars"]).where("doc <> first").select("doc", "n_lines").distinct())


def shared_lines(docs: DataFrame, min_words: int = MIN_WORDS, short_lines: bool = False, without: DataFrame | None = None) -> DataFrame:
    """(line, doc, place, last, first): every place (to the line ``last``) of lines or runs that several documents have,
    not counting those that stand in ``without``.

    ``doc`` and ``first`` are structs that order documents. Written to the shared folder.
    """
    keyed = docs.select(_key("text").alias("text_key"), "doc_id", "text")
    if short_lines:
        lines = _runs(keyed, min_words).select("line", _order("doc_id", "text_key").alias("doc"), "place", "last")
    else:
        lines = (keyed.select("text_key", "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "text"))
                 .where(F.size(words(F.col("text"))) >= min_words)
                 .select(F.unhex(F.md5("text")).alias("line"), _order("doc_id", "text_key").alias("doc"), "place",
                         F.col("place").alias("last")))
    if without is not None:
        lines = lines.join(without.select("doc"), "doc", "left_anti")
    firsts = cut_lineage(lines.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("latest"))
                         .where("first <> latest").drop("latest"))
    return cut_lineage(lines.join(firsts, "line"))


def _key(text: str):
    return F.xxhash64(text)


_DOC = "struct<no_id:boolean,doc_id:bigint,text_key:bigint>"


def _places():
    return F.collect_list(F.struct("place", "last"))


def _align(late: DataFrame, early: DataFrame, on: list[str]) -> DataFrame:
    """(doc, first, aligned): lines of ``late`` (doc, first, line, place, last) that are aligned with ``early``
    (``on``, early). Each side's places are listed once for a pair."""
    lines = late.groupBy("doc", "first", "line").agg(_places().alias("late")).join(early, on)
    pairs = lines.groupBy("doc", "first").agg(F.collect_list(F.struct("line", "late", "early")).alias("lines"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch["lines"]:  # one pair at a time becomes Python objects
                lines = row.as_py()
                side = lambda name: sorted((p["place"], p["last"], x["line"]) for x in lines for p in x[name])  # noqa: B023, E731
                a, b = side("early"), side("late")
                met = patience([x for *_, x in a], [x for *_, x in b])
                found.append(sorted({i for _, j in met for i in range(b[j][0], b[j][1] + 1)}))
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["first"], pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc", "first", "aligned"])

    return pairs.mapInArrow(align, f"doc {_DOC}, first {_DOC}, aligned array<int>")


def _rest(lines: DataFrame, aligned: DataFrame) -> DataFrame:
    """(doc, line, place, last) of ``lines`` that are not deleted whole by what is ``aligned``."""
    gone = aligned.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("aligned"))).alias("gone"))
    by_doc = lines.groupBy("doc").agg(F.collect_list(F.struct("line", "place", "last")).alias("lines")).join(gone, "doc", "left")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (lines, gone) in enumerate(zip(batch["lines"], batch["gone"])):
                gone = set(gone.as_py() or ())
                some = [x for x in lines.as_py() if not gone.issuperset(range(x["place"], x["last"] + 1))]
                at += [i] * len(some)
                rows += some
            kinds = (("line", pa.binary()), ("place", pa.int32()), ("last", pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"].take(pa.array(at, pa.int64())), *[pa.array([x[c] for x in rows], kind) for c, kind in kinds]],
                names=["doc", "line", "place", "last"])

    return by_doc.mapInArrow(left, f"doc {_DOC}, line binary, place int, last int")


def alignments(shared: DataFrame) -> DataFrame:
    """(doc, first, aligned): lines in each later document that are aligned with an earlier one."""
    late = shared.where("doc <> first")
    early = cut_lineage(shared.where("doc = first").groupBy("line").agg(_places().alias("early")))
    found = cut_lineage(_align(late, early, ["line"]))
    rest = cut_lineage(_rest(late.select("doc", "line", "place", "last"), found))
    in_doc = Window.partitionBy("doc").orderBy("place", "last")
    rows, n = None, 1
    while not rest.isEmpty():
        if rows is None:  # rows of one line, of the documents that have any line left
            asked = shared.join(rest.select("line").distinct(), "line", "left_semi").select("doc").distinct()
            rows = shared.join(asked, "doc", "left_semi").select("doc", "line", "place", "last", F.xxhash64("line").alias("h"),
                                                               F.xxhash64(F.lit(1), "line").alias("h2"))
        both = [F.when(F.lead("h", n).over(in_doc).isNotNull(), F.xxhash64(*first, x, F.lead(x, n).over(in_doc))).alias(x)
                for x, first in (("h", ()), ("h2", (F.lit(n),)))]
        rows, n = cut_lineage(rows.select("doc", "line", "place", "last", *both)), 2 * n
        firsts = (rows.where("h IS NOT NULL").groupBy("h", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("latest"))
                  .where("first <> latest").drop("latest"))
        row = F.struct("h", "h2")
        ends = rows.select("doc", "place", "last", F.array(row, F.lag(row, n - 1).over(in_doc)).alias("rows")).select(
            "doc", "place", "last", F.explode("rows").alias("row"))
        known = (ends.where("row.h IS NOT NULL").join(rest.select("doc", "place", "last"), ["doc", "place", "last"])
                 .select("doc", "row.h", "row.h2").distinct().join(firsts, ["h", "h2"]).where("first <> doc")
                 .select("doc", "first").distinct())
        known = cut_lineage(known)
        if known.isEmpty():
            break
        new = known.join(found.select("doc", "first"), ["doc", "first"], "left_anti")
        holders = rows.select(F.col("doc").alias("first"), "line", "place", "last").groupBy("first", "line").agg(_places().alias("early"))
        more = cut_lineage(_align(rest.join(new, "doc"), holders, ["first", "line"]))
        found = cut_lineage(found.unionByName(more))
        rest = cut_lineage(_rest(rest, more))
    return found


def _with_blanks(lines: list[str], gone: set[int]) -> set[int]:
    """``gone`` and the lines without a word that lie between two of it, or between one and an end of the text."""
    more, blanks, inside, near = set(gone), [], True, False
    for i, line in enumerate(lines):
        if i in gone:
            more.update(blanks if inside else [])
            blanks, inside, near = [], True, True
        elif line.encode("utf-8", "replace").split():
            blanks, inside, near = [], False, False
        else:
            blanks.append(i)
    return more.union(blanks) if near else more


def _cut(short_lines: bool):
    @F.arrow_udf(StructType([StructField("text", StringType()), StructField("deleted", ArrayType(IntegerType()))]))
    def cut(texts: pa.Array, deleted: pa.Array) -> pa.Array:
        made, gone = [], []
        for text, places in zip(texts, deleted):
            text, places = text.as_py(), places.as_py()
            if places:
                lines = text.split("\n")
                at = _with_blanks(lines, set(places)) if short_lines else set(places)
                text, places = "\n".join([x for i, x in enumerate(lines) if i not in at]), sorted(at)
            made.append(text)
            gone.append(places)
        return pa.StructArray.from_arrays([pa.array(made, pa.string()), pa.array(gone, pa.list_(pa.int32()))], names=["text", "deleted"])

    # a filter on what it returns must not be pushed below it, which would cut every text twice, in two workers a task
    return cut.asNondeterministic()


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, short_lines: bool = False) -> DataFrame:
    """``docs`` with texts cut, and _n_partners and _deleted (places of lines; null: none)."""
    whole = copies(docs, min_words) if short_lines else None
    deleted = alignments(shared_lines(docs, min_words, short_lines, whole)).groupBy("doc").agg(
        F.count("*").alias("n_partners"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("aligned")))).alias("places"))
    if short_lines:
        deleted = deleted.unionByName(whole.select(
            "doc", F.lit(1).cast("bigint").alias("n_partners"), F.sequence(F.lit(0), F.col("n_lines") - 1).alias("places")))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc.doc_id")) & (_key("row.text") == F.col("doc.text_key"))
    cut = packed(docs).join(deleted, same, "left").select(
        "row", "n_partners", "places", _cut(short_lines)("row.text", "places").alias("cut"))
    kept = [F.col("cut.text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cut.select(*kept, F.col("n_partners").alias("_n_partners"), F.col("cut.deleted").alias("_deleted"))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` with texts cut, short lines too; documents whose every line with a word is gone are dropped."""
    rest = packed(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "row")
    cut = dedup(rest, short_lines=True)
    emptied = F.col("_deleted").isNotNull() & (F.size(words(F.col("text"))) == 0)
    return cut.where(~emptied).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
