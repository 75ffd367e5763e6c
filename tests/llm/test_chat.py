"""Chat formatting: fold of event logs against a plain replay, round trips, digests."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from titleloom.llm import chat

EVENTS = "conv_id bigint, seq bigint, turn bigint, kind string, text string, formatted string"
ROWS = "conv_id bigint, turn bigint, role string, text string, kind int"

MARKED = st.text(st.one_of(st.sampled_from(list("<|>\\[]/si")), st.characters(exclude_categories=["Cs"])), max_size=30)
PIECES = st.lists(st.one_of(st.sampled_from([*chat.CONTROL_STRINGS, "<\\|end|>", "<\\\\s>", "\\", "<", "\n"]), MARKED), max_size=6).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escape_is_reversible_and_complete(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL_STRINGS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_parse_inverts_render(turns):
    assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns


def replay(log):
    """State after applying the events of one conversation one by one."""
    state = {}
    for seq, turn, kind, text in sorted(log, key=lambda e: e[0]):
        text = text or ""
        if kind == chat.REGENERATE:
            state = {t: v for t, v in state.items() if t <= turn}
            state.setdefault(turn, ["", ""])[1] = ""
        elif kind == chat.OPEN:
            state.setdefault(turn, ["", ""])[0] = text
        elif kind == chat.DELTA:
            state.setdefault(turn, ["", ""])[1] += text
        else:
            state.setdefault(turn, ["", ""])[1] = text
    return [(t, *state[t]) for t in sorted(state)]


def test_fold_equals_replay(spark):
    rng = random.Random(2)
    logs = {}
    for conv in range(40):
        turn, log = 0, []
        for seq in range(rng.choice([1, 6, 30])):
            kind = rng.choice([chat.OPEN, chat.DELTA, chat.DELTA, chat.EDIT, chat.REGENERATE])
            turn = max(0, turn + rng.choice([0, 0, 1, -1]))
            log.append((seq, turn, kind, rng.choice([None, "", "x<|end|>", "äb", "user", "assistant"])))
        logs[conv] = log
    rows = [(c, *e, "x") for c, log in logs.items() for e in log]
    rng.shuffle(rows)
    got = {}
    for r in sorted(chat.format_turns(spark.createDataFrame(rows, EVENTS)).collect()):
        (role, text), = chat.parse(r.formatted)
        assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == (text if role == "assistant" else "")
        got.setdefault(r.conv_id, []).append((r.turn, role, text))
    assert got == {c: replay(log) for c, log in logs.items()}


def test_read_back(spark):
    rows = [
        (1, 0, "system", "Be <s>kind</s>.", 1), (1, 1, "user", None, 1), (1, 2, "assistant", "a\nb\\", 1), (1, 3, None, "x", 1),
        (1, 4, "assistant", "🙂" * 3, 1), (2, None, "assistant", "", 1), (2, 1, "assistant", "tie", 1), (2, 1, "assistant", "tie", 1),
        (None, 0, "user", "no id", 1), (3, 0, "assistant", "long " * 50_000, 1),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.events_of(chat.probe(df, "</s>[INST] ok [/INST]")))).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]", 1), (-1, 1, "assistant", "</s>[INST] ok [/INST]", 1)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = [(role or "", text or "") for c, _, role, text, _ in rows if c == conv]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for role, t in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{a}\n{b}\n" for a, b in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(chat.render(*m)[0]) for m in mine)
    empty = chat.read_back(chat.format_turns(chat.events_of(df.limit(0))))
    assert empty.collect() == []


def test_the_log_holds_edits_and_regenerations(spark):
    """Drafts, edits and discarded answers are in the log and nowhere behind the fold."""
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} " * 3) for c in range(20) for t in range(6)]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    log = chat.events_of(talks)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds[chat.EDIT] > 10 and kinds[chat.REGENERATE] > 10 and kinds[chat.OPEN] > len(rows)
    formatted = chat.format_turns(log).collect()
    assert not any("draft" in str(r) or "say it again" in str(r) for r in formatted)
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(log)).collect()}
    assert len(back) == 20 and all(r.n_turns == 6 for r in back.values())
