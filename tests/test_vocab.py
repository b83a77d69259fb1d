"""Vocabulary cases, folding and vocabularies as tables."""

import random

import pytest
from pyspark.sql import functions as F

from planloom import constants as K
from planloom.functions import text as T
from planloom.operators.detect import triage_runs
from planloom.operators.vocab import Vocabulary, nearest_words, snap_text

CASES = {
    "Kokken": ("Køkken", "room"), "Vaer.": ("Vær.", "room"), "Vaer. 1": ("Vær. 1", "room"),
    "Vaer.-1": ("Vær. 1", "room"), "Vaerelse": ("Værelse", "room"), "Stue": ("Stue", "room"),
    "Entré": ("Entré", "room"), "entre": ("Entre", "room"), "ENTRE": ("Entre", "room"),
    "eNtRe": ("Entre", "room"), "entré": ("Entré", "room"), "---Entre": ("Entre", "room"),
    "-Kokken": ("Køkken", "room"), "--Bad": ("Bad", "room"), "Toilet--": ("Toilet", "room"),
    "Kaelderrum": ("Kælderrum", "room"), "Kaelder": ("Kælder", "room"), "--Vr.3": ("Vær. 3", "room"),
    "Vr.": ("Vær.", "room"), "Bad/Toilet": ("Bad/WC", "room"), "2900": ("2900", "dimension"),
    "12,4 m²": ("12,4 m²", "area"), "H*": ("H*", "annotation"), "T": ("T", "annotation"),
    "Qzxwv": ("Qzxwv", "unknown"), "K": ("K", "unknown"), "O": ("O", "unknown"), "": ("", "unknown"),
    "1": ("1", "unknown"), "105": ("105", "dimension"),
}


@pytest.mark.parametrize("as_table", [False, True])
def test_snap_cases(spark, as_table):
    df = spark.createDataFrame([(k, 0.99) for k in CASES], "text string, conf double")
    words = spark.createDataFrame(list(enumerate(K.ROOMS)), "ord int, word string") if as_table else None
    got = {r.text: (r.snap.text, r.snap.kind) for r in snap_text(df, words=words).collect()}
    assert got == CASES


def test_dimension_range_and_confusable(spark):
    df = spark.createDataFrame([("199", .9), ("200", .9), ("20000", .9), ("20001", .9), ("1", .755)],
                               "text string, conf double")
    got = {r.text: r.snap for r in snap_text(df).collect()}
    assert [got[k].warning is None for k in ("199", "200", "20000", "20001")] == [False, True, True, False]
    assert (got["1"].text, got["1"].kind, got["1"].changed) == ("T", "annotation", True)
    assert got["1"].warning


def test_fold_matches_plain_python(spark):
    words = ["Køkken", "ÅÄÖ éèê ß", "ﬁne Ｂａｄ", "m² x³", "İstanbul", "Œuvre", "ǅ ĳ ŉ", "plain"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", T.fold_text(F.col("w")).alias("f")).collect():
        assert r.f == T.fold_word(r.w), r.w


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_words_equal_brute_force(spark):
    rng = random.Random(17)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 14))) for _ in range(150)]
    heads = ["".join(rng.choices("abcde", k=rng.randint(1, 14))) for _ in range(60)]
    for w in words[:90]:
        w = list(w)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        heads.append("".join(w) or "e")
    want = {}
    for h in set(heads):
        score, order = max((100.0 * (1.0 - distance(h, w) / max(len(h), len(w))), -i) for i, w in enumerate(words))
        if score >= 70:
            want[h] = (round(score, 6), words[-order])
    table = spark.createDataFrame([(i, w, w) for i, w in enumerate(words)], "ord int, word string, folded string")
    got = nearest_words(spark.createDataFrame([(h,) for h in heads], "fold string"), table).collect()
    assert {r.fold: (round(r.best.score, 6), r.best.word) for r in got} == want and len(want) > 60


def test_vocabulary_beyond_the_limit_of_literals(spark):
    words = [f"rum {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q" for i in range(6000)]
    with pytest.raises(ValueError):
        Vocabulary(rooms=tuple(words))
    df = spark.createDataFrame([(words[5000], .9), (words[17].upper(), .9), (words[99] + "xx", .9)], "text string, conf double")
    table = spark.createDataFrame(list(enumerate(words)), "ord int, word string")
    got = {r.text: r.snap for r in snap_text(df, words=table).collect()}
    assert [got[t].kind for t in got] == ["room"] * 3 and got[words[17].upper()].text == words[17]


def test_triage_order(spark):
    rows = [(1, 0, "->", .99, 0., 0., 10., 10.), (1, 1, "Stue", .99, 50., 50., 60., 60.),
            (1, 2, "GO", .99, 0., 0., 10., 10.), (1, 3, "Kokken", .5, 0., 0., 10., 10.),
            (1, 4, "一", .9, 0., 0., 10., 10.), (1, 5, "Qzxwv", .9, 0., 0., 10., 10.)]
    df = spark.createDataFrame(rows, "sheet_id long, det_idx long, text string, conf double, x0 double, y0 double, "
                                     "x1 double, y1 double")
    zone = spark.createDataFrame([(1, 40., 40., 55., 55.)], "sheet_id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.det_idx: (r.disposition, [f.code for f in r.flags]) for r in triage_runs(df, protected=zone).collect()}
    assert got == {0: ("symbol", ["non-text-symbol"]), 1: ("protected", []), 2: ("symbol", ["non-text-symbol"]),
                   3: ("run", ["low-confidence", "lexicon-snap"]), 4: ("symbol", ["non-text-symbol"]),
                   5: ("run", ["implausible"])}
