from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.llm import chat, queries
from marquee.llm.chat import Options, parsed, unescaped
from tests.llm.conftest import clashing

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, own in conv.items():
        own.sort()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        out[c] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read_back(windows):
    rows = chat.report(windows).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def test_query_equals_brute_force(engine, small):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    marks = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", marks), (-7, 1, "assistant", marks)]
    got = queries.op9_chat(engine, "/root/testdata/sf0.001").collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == brute(rows)


ODD = ["### User: x", "\\### ", "\\\\</turn>", "</turn>\\", "\n</turn>\n### Assistant: no", "#### a", "###", "\\", "", None, "é😀 ### "]


def test_edges(engine):
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(ODD)]
    rows += [(2, 0, None, "a"), (2, None, "user", "b"), (2, 0, "tool", "c"), (2, 0, "tool", "c"), (2, 1, "we: ird\n", "d"), (None, 0, "assistant", "e")]
    rows += [(3, 0, "system", "be brief"), *((3, i, "assistant" if i % 2 else "user", "word " * 150) for i in range(1, 30)), (3, 30, "assistant", "long " * 3000)]
    frame = clashing(engine.createDataFrame(rows, TURNS), "tokens", "before", "start", "kind", "body", "long", "half")
    assert read_back(chat.windows(frame)) == brute(rows)
    assert chat.windows(engine.createDataFrame([], TURNS)).count() == 0


def test_windows_keep_budget_history_and_system_turn(engine):
    random.seed(3)
    options = Options(budget=200, history=60)
    rows = [(1, 0, "system", "rules of the house")]
    rows += [(1, i, "assistant" if i % 2 == 0 else "user", f"t{i} " + "w " * random.randrange(30)) for i in range(1, 80)]
    windows = chat.windows(engine.createDataFrame(rows, TURNS), options).orderBy("start").collect()
    assert len(windows) > 5
    count = chat.Tokens(chat.read()).count
    seen = 0
    for k, w in enumerate(windows):
        turns = parsed(w["text"])
        size = [count(x) + options.extra for _, x in turns]
        fresh = turns[w["repeated"] :]
        assert sum(size) <= w["tokens"] <= options.budget
        assert [x for _, x in fresh] == [x for _, _, _, x in rows][seen : seen + len(fresh)]
        if k:
            assert turns[0] == ("system", "rules of the house") and w["repeated"] >= 1
            assert sum(size[1 : w["repeated"]]) <= options.history
            assert [x for _, x in turns[1 : w["repeated"]]] == [x for _, _, _, x in rows][seen - w["repeated"] + 1 : seen]
        spans = [unescaped(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
        assert spans == [x for r, x in fresh if r == "assistant"]
        seen += len(fresh)
    assert seen == len(rows)


@pytest.mark.parametrize("text", ODD[:-2])
def test_escape_is_reversible(engine, text):
    if text is None:
        return
    row = engine.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e")).first()
    assert unescaped(row["e"]) == text
    import re

    assert not re.search(r"(?<!\\)(### |</turn>)", row["e"])


def greedy(turns, options):
    """Windows of one conversation of uncut turns, given as tokens, as ``start, first, end, repeated``."""
    before = [sum(turns[:i]) for i in range(len(turns) + 1)]
    wide = options.stretch * options.budget
    at, out = 0, []
    while at < len(turns):
        low = at
        while low > 1 and before[low - 1] >= before[at] - options.history:
            low -= 1
        used = turns[0] + before[at] - before[low] if at else 0
        end = at + 1
        while end < len(turns) and used + before[end + 1] - before[at] <= options.budget and before[end] // wide == before[at] // wide:
            end += 1
        out.append((before[at], at, end, 1 + at - low if at else 0))
        at = end
    return out


def test_windows_equal_a_plain_loop_across_stretches(engine):
    random.seed(5)
    options = Options(budget=200, history=60, stretch=3)
    rows = [(c, 0, "system", "rules of the house") for c in (1, 2)]
    rows += [(c, i, "user", "w " * random.randrange(40)) for c, n in ((1, 400), (2, 30)) for i in range(1, n)]
    frame = engine.createDataFrame(rows, TURNS)
    count = chat.Tokens(chat.read()).count
    for parts in (1, 7):
        got = chat.windows(frame.repartition(parts), options).collect()
        for conv in (1, 2):
            own = [x for c, _, _, x in rows if c == conv]
            expected = greedy([count(x) + options.extra for x in own], options)
            mine = sorted((w for w in got if w["conv_id"] == conv), key=lambda w: w["start"])
            assert [(w["start"], w["repeated"]) for w in mine] == [(start, repeated) for start, _, _, repeated in expected]
            assert [[x for _, x in parsed(w["text"])][w["repeated"] :] for w in mine] == [own[first:end] for _, first, end, _ in expected]


def test_long_system_turn_and_long_turns(engine):
    random.seed(7)
    options = Options()
    words = ["alpha", "beta", "### ", "</turn>", "\\", "é😀", "\n", "gamma"]

    def text(n):
        return " ".join(random.choice(words) for _ in range(n))

    rows = [(1, 0, "system", text(2500)), *((1, i, "assistant" if i % 2 == 0 else "user", text(60)) for i in range(1, 60))]
    rows += [(2, 0, "user", "x" * 30000), (2, 1, "assistant", text(9000)), (2, 2, "other", text(3000)), (2, 3, "assistant", "")]
    rows += [(3, 0, "system", "a"), (3, 1, "system", text(2000)), (3, 2, "assistant", "b")]
    windows = chat.windows(engine.createDataFrame(rows, TURNS), options)
    count = chat.Tokens(chat.read()).count
    kept = windows.collect()
    for w in kept:
        inside = chat.entries(w["text"])
        assert w["tokens"] <= options.budget
        # Joined pieces may take a token more where they meet, and save the marks of a turn there.
        assert sum(count(x.replace("### ", "\\### ").replace("</turn>", "\\</turn>")) for _, x, _ in inside) <= options.budget
        system = next(x for c, _, _, x in rows if c == w["conv_id"])
        if w["start"] and w["conv_id"] != 2:
            assert inside[0][0] == "system" and system.startswith(inside[0][1]) and inside[0][1]
    assert read_back(windows) == brute(rows)
    # The output follows the input, and windows of many turns are nearly full.
    fresh = sum(count(x) + options.extra for _, _, _, x in rows)
    assert sum(w["tokens"] for w in kept) < 2.2 * fresh
    full = [w["tokens"] for c in (1, 2) for w in sorted((w for w in kept if w["conv_id"] == c), key=lambda w: w["start"])[:-1]]
    assert sum(full) > 0.85 * options.budget * len(full)


def test_budget_must_hold_a_piece(engine):
    with pytest.raises(ValueError, match="budget too small"):
        Options(budget=200, history=180)


def test_no_join_meets_the_stretches_of_one_conversation(engine):
    plan = chat.windows(engine.createDataFrame([(1, 0, "system", "a"), (1, 1, "user", "b")], TURNS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # The one join adds the last stretch to pieces of system turns, one row a conversation on either side.
    assert text.split("== Initial Plan ==")[0].count("Join") == 1
