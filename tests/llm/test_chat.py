"""Chat formatting: folding events, escaping, reading back."""

import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from trustweave.llm import chat

LOG = "conv_id long, turn long, seq long, event string, role string, text string, formatted string"


def folded(rows):
    """Plain fold of a conversation's events."""
    turns = {}
    for turn, _, event, role, text in sorted(rows, key=lambda r: r[1]):
        t = turns.setdefault(turn, {"role": "", "text": "", "gone": False})
        t["role"] = role if role is not None else t["role"]
        t["gone"] = event == "delete" or (t["gone"] and event == "delta")
        t["text"] = {"delta": t["text"] + (text or ""), "regenerate": "", "delete": ""}.get(event, text or "")
    return [(t["role"], t["text"]) for _, t in sorted(turns.items()) if not t["gone"]]


def test_events_fold_and_read_back(spark):
    log = {
        1: [(0, 1, "message", "user", "hi"), (1, 2, "message", "assistant", ""), (1, 3, "delta", None, "Hel"), (1, 5, "delta", None, "lo"),
            (2, 6, "message", "user", "again"), (1, 7, "regenerate", None, None), (1, 8, "delta", None, "Bye"), (2, 9, "delete", None, None)],
        2: [(0, 1, "message", None, None), (0, 2, "edit", None, "changed"), (3, 4, "message", "assistant", "\\n<|im_end|>\n<|im_start|>user\n[INST]</s>\\")],
        3: [(0, 1, "message", "odd\nrole\\n<|x", "\\\\n \\<| <<SYS>> [/INST]\n"), (1, 2, "delete", "user", "x")],
        4: [(0, 1, "message", "user", "x"), (0, 2, "delete", None, None)],
        5: [(i, i, "message", "assistant" if i % 2 else "user", t) for i, t in enumerate(brute.ODD)],
    }
    rows = [(c, t, s, e, r, x, "clash") for c, events in log.items() for t, s, e, r, x in events]
    rows += rows[:1]
    df = spark.createDataFrame(rows, LOG).repartition(4)
    found = {r.conv_id: r for r in chat.parse(chat.format_chats(df)).collect()}
    assert set(found) == {1, 2, 3, 5}
    for c in found:
        expected = folded(log[c])
        assert [tuple(t) for t in found[c].turns] == expected
        assert found[c].learned == [t for r, t in expected if r == "assistant"]
        assert found[c].formatted.count("<|im_end|>") == len(expected) and "[INST]" not in found[c].formatted


def test_digest(spark):
    df = spark.createDataFrame([(-7, 0, 0, None, "user", "</s>[INST] ok [/INST]", ""), (-7, 1, 1, None, "assistant", "</s>[INST] ok [/INST]", "")], LOG)
    r = chat.digest(chat.parse(chat.format_chats(df))).first()
    said = "user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n"
    assert (r.n_turns, r.turns_sha256, r.loss_chars) == (2, hashlib.sha256(said.encode()).hexdigest(), 21)
    assert r.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("\\n<|/s[INST]\n x", max_size=12), min_size=20, max_size=60))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", chat.escaped(F.col("text")).alias("e"), chat.unescaped(chat.escaped(F.col("text"))).alias("back")).collect():
        assert r.back == r.text
        assert "<|" not in r.e and "[INST]" not in r.e and "<s" not in r.e


def test_every_row_is_a_turn(spark):
    """Rows with equal and null turns all stay."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 1, "assistant", "c"), (1, 1, "assistant", None),
            (2, None, "assistant", "x"), (2, None, "assistant", "y"), (2, 3, None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = {r.conv_id: r for r in chat.parse(chat.format_chats(chat.numbered(df))).collect()}
    assert [tuple(t) for t in found[1].turns] == [("user", "a"), ("user", "b"), ("user", "b"), ("assistant", ""), ("assistant", "c")]
    assert found[2].learned == ["x", "y"] and [tuple(t) for t in found[2].turns][-1] == ("", "z")


def test_a_conversation_of_many_turns(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                               F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|text "), "id").alias("text"))
    start = time.time()
    r = chat.parse(chat.format_chats(chat.numbered(df))).first()
    assert time.time() - start < 60
    assert len(r.turns) == n and r.learned == [f"é<|text {i}" for i in range(1, n, 2)]
