import re

from planloom.llm import licenses

SCHEMA = "doc_id long, text string, w string, n int, h long"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text):
    w, places = words(text), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), sorted(places)


def test_places_equal_brute_force(spark):
    mit = "Released under the MIT license."
    texts = [None, "", " ", mit, mit + " " + mit, "under the mit", "Apache License, Version 2.0; CC-BY-NC", "CC BY NC by nc cc by nc",
             "é under the mit licensé", "x " * 20_000 + mit + " y" * 20_000, "under the mit license\n" * 3000, "UNDER THE M\u0130T LICENSE",
             "日本 under\tthe\x00mit--license 日本"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, mit), (3, mit)]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(4)
    got = sorted((repr(r.doc_id), r.n_words, sorted((x.word, x.label) for x in r.places)) for r in licenses.find(docs).collect())
    assert got == sorted((repr(d), *brute(t)) for d, t in rows)


def test_empty_table(spark):
    assert licenses.find(spark.createDataFrame([], SCHEMA)).collect() == []
