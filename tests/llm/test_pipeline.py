import random

import corpus_pipeline
import test_decontaminate
import test_line_dedup
import test_quality
import test_simhash
import test_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghiklmnoprst", k=rng.randint(2, 8))) for _ in range(500)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, line(rng.randint(15, 40))) for i in range(12)]
    texts = ["\n".join(line(rng.randint(5, 30)) for _ in range(rng.randint(3, 9))) for _ in range(60)]
    for _ in range(20):
        lines = rng.choice(texts).split("\n")
        kind = rng.randrange(4)
        if kind == 0:
            lines[rng.randrange(len(lines))] = line(12)
        if kind == 1:
            lines = [x + " more" for x in lines]
        if kind == 2:
            lines.insert(1, rng.choice(items)[1])
        if kind == 3:
            words = rng.choice(items)[1].split()
            lines = [" ".join(words[8:]), *lines, " ".join(words[:8])]
        texts.append("\n".join(lines))
    texts += [texts[0], None, "", "short", "## " * 80]
    rng.shuffle(texts)
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], items


def brute(rows, items):
    docs = [(d, t) for d, t, *_ in rows if test_quality.brute(t)[6]]
    cut = [(d, t) for (d, t), (_, before) in zip(test_line_dedup.brute(docs, short_lines=True), docs) if t == before or (t or "").split()]
    stay = {c for _, c in test_simhash.brute(cut).values()}
    docs = [(d, t) for d, t in cut if d in stay]
    leaked = {d for d, *_ in test_decontaminate.brute(docs, items)}
    return {d: t for d, t in docs if d not in leaked}


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == brute(rows, items) and 40 < len(kept) < 78
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept)
    test_tokens.check_packing(packed, 1024)


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
