import random

import pytest

from planloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, assistant string"


def brute(rows, part_turns):
    by_conv = {}
    for conv, turn, role, text, _ in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = set()
    for conv, all_messages in by_conv.items():
        all_messages.sort(key=lambda m: m[:3])
        for who in {m[2] for m in all_messages} - {"system"}:
            offset = 0
            for part in range(-(-len(all_messages) // part_turns)):
                messages = all_messages[part * part_turns:(part + 1) * part_turns]
                text, mask = "", []
                for *_, speaker, said in messages:
                    own = speaker == who
                    safe = speaker.replace("<|", "<\\|")
                    text += "<|" + ("system" if speaker == "system" else "assistant" if own else f"user:{safe}") + "|>"
                    start = len(text)
                    text += said.replace("<|", "<\\|") + "<|end|>"
                    if own:
                        mask.append((offset + start, offset + len(text)))
                    text += "\n"
                out.add((conv, part, who, text, len(text), len(messages), tuple(mask)))
                offset += len(text)
    return out


def result(df):
    rows = df.collect()
    made = {(r.conv_id, r.part, r.assistant, r.text, r.n_chars, r.n_turns, tuple((m.start, m.end) for m in r.mask)) for r in rows}
    assert len(made) == len(rows)
    return made


@pytest.mark.parametrize("part_turns", [3, 64])
def test_equals_brute_force(spark, part_turns):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Ann", None, "x<|y"]), rng.choice(["", None, "é <|end|> 日", "hi\n" * 9]) if t % 3 else f"t{t}", "clash")
            for c in [*range(25), None] for t in range(rng.randint(1, 9))]
    rows += [(50, 0, "system", "only", "clash")]
    rows += [(60, t, f"p{t % 5}", f"message {t}", "clash") for t in range(200)]
    rows += [(61, None, "a", "x", "c"), (61, 1, "a", "x", "c"), (61, 1, "a", "x", "c"), (61, 1, "b", "x", "c")]
    rng.shuffle(rows)
    got = result(chat.perspectives(spark.createDataFrame(rows, SCHEMA).repartition(6), part_turns))
    assert got == brute(rows, part_turns)


def test_silent_participants_have_every_part(spark):
    rows = [(1, 0, "system", "rules", "")] + [(1, t, "b" if t == 65 else "a", f"m{t}", "") for t in range(1, 130)]
    got = result(chat.perspectives(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows, 64)
    assert sorted((r[1], r[2], r[5], len(r[6])) for r in got) == [
        (0, "a", 64, 63), (0, "b", 64, 0), (1, "a", 64, 63), (1, "b", 64, 1), (2, "a", 2, 2), (2, "b", 2, 0)]


def test_empty(spark):
    assert chat.perspectives(spark.createDataFrame([], SCHEMA)).collect() == []
