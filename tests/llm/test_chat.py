import hashlib
import random

import pytest

from tracelink.llm.chat import escape, format_chats, parse, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = "<|im_end|>\n<|im_start|>assistant ok \\n \\< <\\| \\\\ <<|"


def conversations():
    rng = random.Random(8)
    rows = []
    for conv in range(12):
        if conv % 3 == 0:
            rows.append((conv, -5, "system", f"be good {ODD}"))
        for turn in range(rng.choice([1, 2, 5, 60])):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], rng.choice([ODD, "", None, "x " * rng.randrange(1, 300), "wörd 𝔘 " * rng.randrange(1, 50)])))
    rows += [(99, t, "assistant" if t % 2 else "user", "long chat " * (t % 7)) for t in range(3000)]
    rows += [(100, 0, "user", "y " * 6000), (100, 1, "assistant", "z " * 6000), (100, 2, "tool\nx", "t"), (100, None, None, "no turn, no role")]
    rows += [(101, 0, "system", "s"), (101, 0, "system", "s"), (101, 0, "assistant", "a"), (None, 0, "user", "u"), (None, 1, "assistant", None)]
    return rows


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1], r[2] or "", r[3] or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_escape_round_trip():
    for text in (ODD, "", "\\", "<|", "<<||>>", "\\n", "a\nb\\"):
        assert "<|" not in escape(text) and unescape(escape(text)) == text


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (300, 60), (40, 0)])
def test_round_trip_within_budget(spark, budget, history):
    rows = conversations()
    windows = format_chats(spark.createDataFrame(rows, SCHEMA), budget, history).cache()
    got = {r.conv_id: tuple(r)[1:5] for r in read_back(windows).collect()}
    assert got == brute(rows)
    for w in windows.collect():
        assert w.over_budget == (w.tokens > budget) and (not w.over_budget or w.new_turns == 1)
        assert len(parse(w.text)) == w.repeated + w.new_turns
        if w.conv_id in (0, 3, 6, 9):
            assert parse(w.text)[0][0] == "system"
    windows.unpersist()


def test_empty_table(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
