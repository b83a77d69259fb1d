import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from planloom.llm import packing, queries, token_files, tokens
from planloom.llm.tokens import Encoder, encoder, ids_bytes

FILES = (queries.WORD_BPE, queries.BYTE_BPE)
SCHEMA = "doc_id long, text string, start long, ids string"


@pytest.mark.parametrize("name", FILES)
def test_pieces_have_the_ids_of_whole_texts(name):
    path = queries.tokenizer_path(name)
    ours, theirs = Encoder(path), Tokenizer.from_file(path)
    assert ours.kind is not None
    rng = random.Random(1)
    alphabet = list("a b.c! \n\t.,'sSabÉéß12日\xa0\x85\x1c\r\x0b́­K $!-") + ["  ", "\n\n", "<|endoftext|>", "'re", " The"]
    texts = ["", " ", "a", "Σας ΟΔΟΣ", "İx K"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(6000)]
    for text in texts:
        assert ours.encode(text) == ids_bytes(theirs.encode(text, add_special_tokens=False).ids), text


def test_forms_of_a_word_share_a_piece():
    ours = Encoder(queries.tokenizer_path(queries.WORD_BPE))
    ours.encode("Word word, WORD. (word) été Été! it's 12")
    assert set(ours.cached) == {"word", ",", ".", "(", ")", "été", "!", "it", "'s", "1", "2"}


def test_all_latin_characters_have_the_ids_of_whole_texts():
    path = queries.tokenizer_path(queries.WORD_BPE)
    ours, theirs = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    latin, near = [chr(i) for i in range(256)], list("'stremvdlSTREMVDL .,-") + ["<|endoftext|>", "<|ENDOFTEXT|>", "ª", "µ", "¼", "ß", "Þ", "×"]
    texts = [x for c in latin for x in (c, f"a{c}B", f"{c}'S", f"1{c}2", f"{c}{c},")]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 30))) for letters in (latin, near) for _ in range(3000)]
    for text in texts:
        assert ours.encode(text) == ids_bytes(theirs.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("name", FILES)
def test_texts_encoded_together(monkeypatch, name):
    path = queries.tokenizer_path(name)
    ours, theirs = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(5)
    alphabet = list("a b.c! \n\t.,'sSabÉß12日\xa0\x85\x1c\r\x0b\x00") + ["  ", "<|endoftext|>", "'re", " The"]
    texts = ["", " ", "", "x" * 300] + ["".join(rng.choices(alphabet, k=rng.choice([1, 5, 40, 150]))) for _ in range(2000)] + [""]
    want = [ids_bytes(theirs.encode(text, add_special_tokens=False).ids) for text in texts]
    for most in (8_000_000, 100, 1):
        monkeypatch.setattr(tokens, "MOST_CHARS", most)
        assert list(ours.encode_each(iter(texts))) == want
    assert list(ours.encode_each([])) == []


def test_a_repeated_word_is_looked_up_once(monkeypatch):
    ours, asked = Encoder(queries.tokenizer_path(queries.WORD_BPE)), []
    monkeypatch.setattr(tokens, "MOST_PIECES", 1)  # the cache forgets at once
    monkeypatch.setattr(ours, "word", lambda letters, word=ours.word: asked.append(letters) or word(letters))
    assert list(ours.encode_each(["one two one", "Two ONE", "two"])) == [ours.whole(x) for x in ("one two one", "Two ONE", "two")]
    assert asked == ["one", "two"]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 2 ** 32 - 1), max_size=30), max_size=8))
def test_file_round_trip(documents):
    arrays = [np.array(d, np.uint32) for d in documents]
    ids = [None if i % 3 == 2 else i - 1 for i in range(len(arrays))]
    got_ids, got = token_files.unpack(b"".join(token_files.pack(ids, arrays)))
    assert got_ids == ids and [g.tolist() for g in got] == documents


def test_frequent_ids_take_one_byte():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(40000, 40200, 5000), np.arange(70000)]).astype(np.uint32)
    assert len(b"".join(token_files.pack([1], [ids]))) < 4 * 70000 + 1.3 * len(ids) + 2 * 75000
    assert token_files.unpack(b"".join(token_files.pack([1], [ids])))[1][0].tolist() == ids.tolist()


def documents(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choices(["The", "of", "thing,", "été.", "x\n"], k=rng.choice([0, 1, 5, 700, 3000]))), 1, "x")
            for i in range(60)]
    rows += [(None, "null id", 1, "x"), (7, None, 1, "x"), (8, "same", 1, "x"), (8, "same", 1, "x"), (8, "other", 1, "x")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_files_hold_all_documents_in_order(spark, monkeypatch):
    rows, docs = documents(spark)
    path = queries.tokenizer_path(queries.WORD_BPE)
    monkeypatch.setattr(token_files, "MOST_TOKENS", 5000)
    folder, files = token_files.write(docs, path, 1)
    assert files.count() > 4
    got = sorted(token_files.read(spark, folder, files).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc_id, text, *_) in zip(got, want, strict=True):
        ids = encoder(path).encode(text or "") + ids_bytes([1])
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.value)) == (doc_id, start, len(ids) // 4, ids)
        start += len(ids) // 4
    none, empty = token_files.write(docs.limit(0), path, 1)
    assert token_files.read(spark, none, empty).collect() == []


def check_packing(rows, capacity):
    """Gapless sequences without overlap; the number of sequences."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_documents(spark):
    rows, docs = documents(spark)
    path = queries.tokenizer_path(queries.BYTE_BPE)
    packed = packing.pack_documents(docs, path, 2).collect()
    n = check_packing(packed, 1024)
    total = sum(r.length for r in packed)
    assert -(-total // 1024) <= n <= 1.2 * total / 1024 + 2
    for doc_id, text, *_ in rows:
        ids = encoder(path).encode(text or "") + ids_bytes([2])
        mine = sorted((r for r in packed if r.doc_id == doc_id), key=lambda r: r.piece)
        if doc_id != 8:
            assert sum(r.length for r in mine) == len(ids) // 4
            assert all(r.length == 1024 for r in mine[1:]) and [r.piece for r in mine] == list(range(len(mine)))
            for r in mine:
                assert r.ids_crc32 == zlib.crc32(ids[4 * r.start:4 * (r.start + r.length)])
    assert sum(r.doc_id == 8 for r in packed) == 3
    assert packing.pack_documents(docs.limit(0), path, 2).collect() == []
    assert packing.pieces(docs.where("text = ''"), path, None).collect() == []


def test_sequences_hold_the_ids(spark):
    rows, docs = documents(spark)
    docs = docs.where("doc_id <> 8")
    path = queries.tokenizer_path(queries.BYTE_BPE)
    cut = packing.pieces(docs, path, 2, 256, with_ids=True)
    packed = packing.pack(packing.cut_lineage(cut.drop("ids")), 256)
    made = {r.sequence_id: bytes(r.ids) for r in packing.sequences(cut, packed).collect()}
    for r in packed.collect():
        part = made[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)]
        assert zlib.crc32(part) == r.ids_crc32


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 32), max_size=200), st.integers(1, 6))
def test_best_fit_equals_plain_search(lengths, open_bins):
    fast = packing.BestFit(32, open_bins)
    bins, stack = {}, []  # open bin: free space; most recent last
    n = 0
    for length in lengths:
        fitting = [b for b in stack if bins[b] >= length]
        if fitting:
            space = min(bins[b] for b in fitting)
            chosen = [b for b in stack if bins[b] == space][-1]
            stack.remove(chosen)
        else:
            chosen, space, n = n, 32, n + 1
        bins[chosen] = space - length
        got = fast.place(length)
        assert got == (chosen, 32 - space)
        if bins[chosen]:
            stack.append(chosen)
            if len(stack) > open_bins:
                fullest = min(bins[b] for b in stack)
                out = chosen if bins[chosen] == fullest else [b for b in stack if bins[b] == fullest][-1]
                stack.remove(out)
    with pytest.raises(ValueError):
        fast.place(33)
