import test_line_dedup

from planloom.llm import line_dedup
from planloom.llm.queries import QUERIES

VERSE = ["So much depends", "upon", "", "a red wheel", "barrow"]
LONG = "this line has more than five words"
TEXTS = [
    "\n".join(["Title", "", LONG, "x = 1", "", "another line of at least five words", "The end"]),
    "\n".join(["Title", "", LONG, "x = 1", "", "another line of at least five words", "The end"]),
    "\n".join(["own line of the third document here", "Yes", *VERSE, "No"]),
    "\n".join(["quite a different line of document four", "Maybe", *VERSE, "", "Perhaps"]),
    "\n".join(["Intro", LONG, "x = 1", "", "something else that only stands in here"]),
    "yes\nno",
    "yes\nno",
]
LEFT = [
    TEXTS[0],
    "",
    TEXTS[2],
    "quite a different line of document four\nMaybe\n\nPerhaps",
    "Intro\n\nsomething else that only stands in here",
    "yes\nno",
    "yes\nno",
]


def test_common_blocks_go_whole(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], test_line_dedup.SCHEMA).repartition(3)
    got = {r.doc_id: r for r in line_dedup.dedup(docs, short_lines=True).collect()}
    assert [got[i].text for i in range(len(TEXTS))] == LEFT
    assert got[1]._deleted == [0, 1, 2, 3, 4, 5, 6] and got[3]._deleted == [2, 3, 4, 5, 6]
    assert sorted(r.doc_id for r in line_dedup.keep(docs).collect()) == [0, 2, 3, 4, 5, 6]
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    removed = {r.doc_id: r.n_removed_lines for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert removed == {0: 0, 1: 7, 2: 0, 3: 5, 4: 2, 5: 0, 6: 0}


def test_without_short_lines_nothing_changes(spark):
    rows = [(i, "\n".join(x for x in t.split("\n") if len(x.split()) >= 5)) for i, t in test_line_dedup.rows_with_overlaps() if i is not None and t]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], test_line_dedup.SCHEMA)
    got = sorted([(r.doc_id, r.text) for r in line_dedup.dedup(docs, short_lines=True).collect()], key=repr)
    assert got == sorted(test_line_dedup.brute(rows), key=repr)


def test_keep_cuts_each_text_once(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], test_line_dedup.SCHEMA)
    plan = line_dedup.keep(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
