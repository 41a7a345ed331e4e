import hashlib

import pytest

from sellerlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment string, loss string"
ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <s>"), (1, 2, "assistant", "\\ yes \\\\ </s> <\\/s> [/INST]"),
    (2, 1, "assistant", "late"), (2, 0, "user", None), (3, 0, "assistant", "first"), (4, 0, "user", "open end"),
    (5, 0, "to[TEXT]ol", "odd [ROLE]"), (5, 1, None, ""), (6, 0, "user", "x" * 100_000), (6, 1, "assistant", "[TEXT]" * 5_000),
    (7, 0, "user", "same"), (7, 0, "user", "same"), (None, None, "user", "n"), (8, None, "user", "b"), (8, 3, "assistant", "a\n"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "s", "l") for r in rows], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_digests(spark):
    by = {}
    for c, t, r, x in ROWS:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame(spark))).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), sha(learned))
    assert {c for c, r in got.items() if r.valid} == {1, 2, 6, 8}


def test_marks_only_where_the_template_puts_them(spark):
    t = chat.ChatTemplate()
    out = chat.format_conversations(frame(spark)).collect()
    for r in out:
        n = len([x for x in ROWS if x[0] == r.conv_id])
        known = [x for x in ROWS if x[0] == r.conv_id and x[2] in t.roles]
        marks = sum(r.formatted.count(c) for c in t.controls())
        assert marks == 2 * n + (n - len(known))
        assert "".join(s.segment for s in r.segments) == r.formatted


def test_segments_match_the_formatted_string(spark):
    rows = chat.segments(frame(spark, [x for x in ROWS if x[0] == 1])).orderBy("turn", "part").collect()
    whole = chat.format_conversations(frame(spark, [x for x in ROWS if x[0] == 1])).first().formatted
    assert "".join(r.segment for r in rows) == whole


def test_own_template_empty_table_and_clashing_marks(spark):
    t = chat.ChatTemplate(roles={"user": chat.Marks("<|u|>", "<|/u|>"), "assistant": chat.Marks("<|a|>", "<|/a|>", True)},
                          other=chat.Marks("{(", ")}"), other_text="=>")
    got = chat.digests(chat.format_conversations(frame(spark), t), t).where("conv_id = 1").first()
    assert got.loss_chars == len(ROWS[2][3])
    assert chat.digests(chat.format_conversations(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(other=chat.Marks("<s>x", "[/ROLE]"))


def test_stays_in_the_jvm(spark):
    plan = chat.digests(chat.format_conversations(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
