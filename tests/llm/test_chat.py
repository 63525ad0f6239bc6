import hashlib
import random

import pytest

from tidemark.llm import chat

NASTY = ["[INST]", "[/INST]", " [/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "<<ANS>>", "<<ROLE:x>>", "<</ROLE>>", "[", "<", "\\", "[\\/INST]", "<\\\\/s>", "<\\<SYS>>", "/INST]", "\n", " ", "é🙂", "a"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "a>>b%;", "", None])
def test_any_text_comes_back(role):
    rng = random.Random(str(role))
    for _ in range(600):
        text = "".join(rng.choices(NASTY, k=rng.randint(0, 7)))
        assert chat.unescape(chat.escape(text)) == text
        piece, a, b = chat.format_turn(role, text)
        other, _, _ = chat.format_turn("user", text)
        assert [(r, t) for r, t, _, _ in chat.parse(piece + other + piece)] == [(role, text), ("user", text), (role, text)]
        assert chat.unescape(piece[a:b]) == text


def test_plain_text_is_not_touched():
    assert chat.format_turn("user", "a [b] <c> \\ d")[0] == "[INST] a [b] <c> \\ d [/INST]"
    with pytest.raises(chat.GrammarError):
        list(chat.parse("[INST] no end"))


def test_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "plain", "".join(rng.choices(NASTY, k=5))])))
    rows += [(5, 0, "user", "tie b"), (5, 0, "user", "tie a"), (None, 1, "user", "no id"), (None, None, "assistant", "first"), (90, 1, "assistant", "x" * 200_000), (5, 0, "user", "tie a")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, seq int, piece string").repartition(5)
    got = {r.conv_id: r for r in chat.round_trip(chat.probe(spark, df)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = {}
    key = lambda r: tuple((x is not None, x) for x in r[1:3]) + (r[3] or "",)
    for r in sorted(rows, key=key):
        by.setdefault(r[0], []).append((r[2], r[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role or ''}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.BEGIN) + sum(len(chat.format_turn(role, t)[0]) for role, t in turns)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.round_trip(df).count() == 0
