import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from sentinelle.llm import chat
from sentinelle.llm.q_chat import logged, op1_chat_format

TRICKY = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "s>", "[", "INST]", "/", "é", "\n", " [/INST]", "<\\s>"]), max_size=8).map("".join)


@given(TRICKY)
def test_escapes_come_back(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@given(st.sampled_from(["user", "assistant", "system", ""]) | TRICKY, TRICKY)
def test_segments_come_back(role, text):
    written, lo, hi = chat.segment(role, text)
    assert chat.parse(written) == (role, text)
    assert chat.unescape(written[lo:hi]) == (text if role == "assistant" else "")


def log(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], chat.EVENTS + ", segment string")


def turns(spark, rows):
    got = chat.render(log(spark, rows)).collect()
    return sorted((str(r.conv_id), r.turn, *chat.parse(r.segment)) for r in got)


def test_fold(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi"),
        (1, 2, 1, "delta", "assistant", "he"),
        (1, 4, 1, "delta", "assistant", "o"),
        (1, 3, 1, "delta", "assistant", "ll"),
        (1, 5, 2, "message", "user", "void"),
        (1, 6, 1, "regenerate", "assistant", None),
        (1, 7, 1, "delta", "assistant", "new"),
        (1, 8, 2, "message", "user", "ok"),
        (1, 9, 2, "edit", "user", "better"),
        (None, None, None, "message", None, None),
        (None, None, None, "message", None, None),
    ]
    assert turns(spark, rows) == [("1", 0, "user", "hi"), ("1", 1, "assistant", "new"), ("1", 2, "user", "better"), ("None", 0, "", ""), ("None", 1, "", "")]
    assert turns(spark, []) == []


def test_long_conversation_and_digests(spark):
    rows = [(5, i, i, "message", "user" if i % 2 == 0 else "assistant", f"text {i} <s>") for i in range(5000)]
    got = chat.digests(chat.render(log(spark, rows))).collect()
    assert len(got) == 1
    assert got[0].n_turns == 5000
    assert got[0].turns_sha256 == hashlib.sha256("".join(f"{r[4]}\n{r[5]}\n" for r in rows).encode()).hexdigest()
    assert got[0].loss_sha256 == hashlib.sha256("".join(r[5] for r in rows if r[4] == "assistant").encode()).hexdigest()
    assert got[0].formatted_chars == len(chat.formatted(chat.render(log(spark, rows))).first().formatted)


def test_query_has_the_planted_conversation(spark):
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: r for r in op1_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[-7].loss_chars, got[-7].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_the_query_folds_edits_and_regenerations(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", "x", "a <s> b", "日本語 text"])) for c in (1, 2, None) for t in [None, None, *range(9), 3, 3]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log_ = logged(frame)
    assert {e.kind for e in log_.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted(((str(s.conv_id), s.turn, *chat.parse(s.segment)) for s in chat.render(log_).collect()))
    want = []
    for c in (1, 2, None):
        mine = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        want += [(str(c), i, role, text) for i, (_, _, role, text) in enumerate(mine)]
    assert got == sorted(want)
