import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import chat_format as C

PARTS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "[INST] ", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "\\", "\\\\", "\\<", "<", "[", "]", " ", "\n", "x", "é🙂"])
TEXT = st.one_of(st.lists(PARTS, max_size=12).map("".join), st.text(max_size=30))
ROLE = st.one_of(st.sampled_from(["system", "user", "assistant", "tool", ""]), TEXT)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_round_trip(turns):
    assert C.parse_conversation("".join(C.render_turn(r, t) for r, t in turns)) == turns


def test_refuses_other_text():
    for bad in ("x", "<s>never closed", "[INST] a", "<s>a</s> "):
        with pytest.raises(ValueError):
            C.parse_conversation(bad)


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        x = out.setdefault(conv, [0, "", ""])
        x[0] += 1
        x[1] += f"{role or ''}\n{text or ''}\n"
        x[2] += (text or "") * (role == "assistant")
    return {c: (n, hashlib.sha256(t.encode()).hexdigest(), len(s), hashlib.sha256(s.encode()).hexdigest()) for c, (n, t, s) in out.items()}


def test_conversations(spark):
    rows = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "system", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "assistant", ""), (2, 5, "assistant", "b"), (2, 3, "assistant", "a"),
        (None, 0, "user", "no conversation"), (3, 0, "tool\\]", "[/ROLE]" * 3), (4, 0, "assistant", "long " * 50000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string").repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.conversation_digests(df).collect()}
    assert got == brute(rows)
    sizes = {r["conv_id"]: r["formatted_chars"] for r in C.conversation_digests(df).collect()}
    for r in C.format_conversations(df).collect():
        turns = C.parse_conversation(r["formatted"])
        assert len(r["formatted"]) == sizes[r["conv_id"]]
        assert [C.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]] == [t for role, t in turns if role == "assistant"]
    assert C.conversation_digests(df.limit(0)).count() == 0
