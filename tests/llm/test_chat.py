import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetstops.llm import chat

PARTS = ["<", "\\", "|", "<|", chat.END, chat.TURN, "a ", "\n", "word word ", "<\\|", "é", "</s>[INST]"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=20).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "a\nb", "x\\n<|"]), TEXTS), min_size=1, max_size=12)


def windows(turns, budget, history):
    own, out = chat.Windows(budget, history), []
    for role, text in turns:
        out += own.add(role, text)
    return [*out, own.close()]


@settings(max_examples=500, deadline=None)
@given(TURNS, st.sampled_from([5, 20, 60]), st.sampled_from([0, 10, 30]))
def test_windows_keep_every_turn_once(turns, budget, history):
    out = windows(turns, budget, history)
    got, loss = [], []
    for k, w in enumerate(out):
        parsed = chat.parse(w["text"])
        assert len(parsed) == w["repeated"] + w["new"] and w["first_turn"] == len(got) and w["window"] == k
        opening = turns[0][0] == "system" and k > 0
        if opening:
            assert parsed[0] == turns[0]
        past = parsed[opening : w["repeated"]]
        assert past == turns[len(got) - len(past) : len(got)]
        assert sum(chat.turn_tokens(t) for _, t in past) <= history
        assert w["tokens"] <= budget or w["new"] == 1 and not past
        got += parsed[w["repeated"] :]
        loss += [chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
    assert got == turns
    assert loss == [t for r, t in turns if r == "assistant"]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


def digest(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_odd_rows(spark):
    long = "long words " * 40_000
    rows = [
        (1, 0, "system", "be <|turn|> kind"), (1, 1, "user", None), (1, 2, "assistant", long), (1, 3, None, ""), (1, 4, "assistant", ""),
        (2, 0, "user", "x"), (2, 0, "user", "x"), (2, None, "assistant", "first"), (None, 0, "assistant", "none's"), (None, 1, "assistant", "again"), (3, 5, "assistant", "<|end|>\n"),
    ]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, window string, loss string")
    out = chat.format_windows(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_windows(out).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {c: digest([r[2:] for r in sorted((r for r in rows if r[0] == c), key=order)]) for c in {r[0] for r in rows}}
    assert got == want
    assert chat.format_windows(df.limit(0)).count() == 0 and chat.read_windows(out.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = chat.op1_chat_format(spark, sf).collect()
    assert Counter(r.conv_id for r in got) == Counter(dict.fromkeys(want, 1))
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(want[r.conv_id])


def test_parse_refuses_other_text():
    with pytest.raises(ValueError):
        chat.parse("no template")
