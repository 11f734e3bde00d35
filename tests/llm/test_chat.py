import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from staffmart.llm import chat as C

KIND = "conv_id long, turn long, role string, text string"


def expected(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


PIECES = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "[ROLE]", "\\", "[", "<", "/", "s>", "é", " ", "x"]), max_size=12).map("".join)


@given(PIECES)
def test_escaping_is_reversible_and_hides_marks(text):
    template = C.Template()
    hidden = template.escape(text)
    assert C.unescape(hidden) == text
    assert not any(m in hidden for m in template.marks())


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), PIECES), min_size=1, max_size=6))
def test_segments_can_be_read_back(turns):
    template, out = C.Template(), []
    reader = C.Reader(1, template)
    for role, text in turns:
        turn = template.turns.get(role)
        text = template.escape(text)
        parts = [(turn.opens, False), (text, turn.loss), (turn.closes, False)] if turn else [
            (template.other[0], False), (template.escape(role), False), (template.other[1], False), (text, False), (template.other[2], False)]
        out += parts
    for text, loss in out:
        reader.segment(text, loss, None)
    r = reader.row()
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(turns)
    assert r["formatted_chars"] == sum(len(t) for t, _ in out)


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "é\U0001f600")],
    2: [("system", "be kind"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
    3: [("assistant", "first")],
    4: [("user", "a"), ("user", "b"), ("assistant", "c")],
    5: [("user", None), ("assistant", None)],
    6: [("tool", "x\\"), (None, "[ROLE]"), ("user", "")],
    None: [("user", "no id"), ("assistant", "none")],
}


def frame(spark, conversations):
    rows = [(c, k, r, t, "clash", 1) for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows[::-1], KIND + ", segment string, loss int")


def test_digests_are_those_of_the_turns(spark):
    rows = C.digests(C.segments(frame(spark, CONVERSATIONS))).collect()
    assert len(rows) == len(CONVERSATIONS)
    for r in rows:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(CONVERSATIONS[r.conv_id])
    assert {r.conv_id: r.valid for r in rows} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, None: True}
    assert {r.conv_id: r.error for r in rows}[4] == "turn 2: user after user"


def test_batches_and_repeated_turns(spark):
    many = {k: [("user", f"q{k}"), ("assistant", f"a{k}" * (k % 9))] * 3 for k in range(200)}
    many[7] = [("user", "u"), ("assistant", "a")] * 3000
    turns = frame(spark, many)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        rows = C.digests(C.segments(turns)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == {k: expected(v) for k, v in many.items()}
    same = spark.createDataFrame([(1, 0, "user", "x")] * 3, KIND)
    assert C.digests(C.segments(same)).first().n_turns == 3
    assert C.digests(C.segments(spark.createDataFrame([], KIND))).count() == 0


def test_templates_that_cannot_be_read_back_are_refused():
    turn = C.Turn("aa", "</a>", True, ())
    with pytest.raises(ValueError):
        C.Template(turns={"user": turn}).check()
    with pytest.raises(ValueError):
        C.Template(turns={"user": C.Turn("<a>", "<a>", True, ())}).check()


def test_segments_keep_their_order_when_numbered(spark):
    rows = sorted(C.formatted_texts(C.segments(frame(spark, CONVERSATIONS))).where("conv_id = 1").collect(), key=lambda r: r.position)
    assert "".join(r.segment for r in rows) == "[INST]hi[/INST]<s>hello</s>[INST]bye[/INST]<s>é\U0001f600</s>"
    assert [r.segment for r in rows if r.loss] == ["hello", "é\U0001f600"]
