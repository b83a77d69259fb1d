import random
import re
from collections import Counter

from planloom.llm import quality

SCHEMA = "doc_id long, text string, n_words int, kept string"


def brute(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of a text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n, chars = len(words), sum(map(len, words))
    symbols, dup = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(covered) > 50 * n
    more = symbols > 0.5 * n or text.count("!") > 0.5 * n or chars > 30 * n or 100 * dup > 50 * len(lines)
    return n, chars, symbols, dup, len(covered), base, not (base or more)


def texts():
    rng = random.Random(10)
    out = [None, "", " \n\t ", "one", "\x0ba\x0cb\rc d", "é日 " * 60, "same line\n" * 70]
    for _ in range(120):
        vocabulary = rng.choice([3, 12, 400])
        words = [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "!", "##", "."]) * rng.choice([0, 1]) for _ in range(rng.randint(0, 140))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "  "]) for w in words))
    out.append(" ".join(f"v{i % 700}" for i in range(30000)))
    out.append("x" * 4000 + " y" * 60)
    return out


def test_measures_and_verdicts(spark):
    rows = [(i if i % 7 else None, t, 3, "x") for i, t in enumerate(texts())] + [(1, "a b", 1, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    names = ["_q_n_words", "_q_word_chars", "_q_n_symbols", "_q_n_dup_lines", "_q_n_repeat_words"]
    for order in (quality.RULES, quality.RULES[::-1], quality.plan_rules(docs)):
        assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)
        got = sorted([(r.doc_id, r.text, *[r[n] for n in names], r._q_rejected_by is None)
                      for r in quality.measure(docs, order).collect()], key=repr)
        want = sorted([(d, t, *brute(t)[:5], brute(t)[6]) for d, t, *_ in rows], key=repr)
        assert got == want
        lazily = {(r.doc_id, r.text): r._q_rejected_by is None for r in quality.reject(docs, order).collect()}
        assert lazily == {(d, t): brute(t)[6] for d, t, *_ in rows}
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if brute(r[1])[6]), key=repr)
    assert quality.keep(docs.limit(0)).collect() == []
