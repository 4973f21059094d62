import hashlib
import random

import pytest

from tillcast.llm.chat import TOKEN, control_conversation, digests, format_windows

import re

SCHEMA = "conv_id long, turn int, role string, text string"


def expected(rows):
    held = {}
    for c, t, r, x in rows:
        held.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    out = {}
    for c, turns in held.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def odd_rows():
    draw = random.Random(4)
    bits = ["</s>", "[INST]", "[/INST]", "<|im_end|>\n", "<|im_start|>", "\\", "\n", "<", "|", "<<SYS>>", "é", "👩", " a", "word ", "$1"]
    rows = []
    for c in range(40):
        for t in range(draw.randint(1, 30)):
            role = draw.choice(["user", "assistant", "system", None, "od\nd", "<|im_end|>"]) if t else draw.choice(["system", "user"])
            rows.append((c, draw.choice([t, t, t // 2]), role, draw.choice([None, "", "".join(draw.choices(bits, k=draw.randint(1, 40)))])))
    return rows + [(None, None, "assistant", "x"), (None, 0, "assistant", "y"), (90, 0, "system", "only"), (91, 0, "assistant", "w " * 5000), (91, 0, "assistant", "w " * 5000)]


@pytest.mark.parametrize("budget, history", [(1024, 256), (40, 10), (8, 0), (60, 500)])
def test_everything_reads_back(spark, budget, history):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as window", "2 as conv", "3 as block")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(format_windows(frame, budget, history)).collect()}
    assert got == expected(rows)


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", f"turn{t} " * 8) for t in range(1, 40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    windows = sorted(format_windows(frame, 100, 24).collect(), key=lambda w: w.window)
    assert len(windows) > 5
    for w in windows:
        assert w.formatted.startswith("<|im_start|>system\nbe brief<|im_end|>\n") and w.n_tokens <= 100
        assert w.n_repeated >= (1 if w.window else 0)
        learnt = [w.formatted[s.start : s.start + s.length] for s in w.loss]
        own = re.findall(r"<\|im_start\|>assistant\n(.*?)<\|im_end\|>", w.formatted)
        assert learnt == own[len(own) - len(learnt) :]  # repeated assistant turns are masked
    assert any(w.n_repeated > 1 for w in windows)
    assert re.findall(TOKEN, "ab1 é!") == ["ab1", "é", "!"]


def test_control_conversation_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = digests(format_windows(empty.unionByName(control_conversation(empty)))).collect()
    text = "</s>[INST] ok [/INST]"
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(-7, 2, len(text))]
    assert got[0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert digests(format_windows(empty)).count() == 0
