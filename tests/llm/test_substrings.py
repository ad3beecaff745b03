from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from marquee.llm import queries, substrings
from marquee.llm.substrings import Options
from marquee.llm.words import Words
from tests.llm.conftest import clashing


def brute(rows, w=35):
    texts = [(x or "").encode().split() for _, x in rows]
    seen = Counter(tuple(t[i : i + w]) for t in texts for i in range(len(t) - w + 1))
    out = Counter()
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - w + 1):
            if seen[tuple(t[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        kept = b" ".join(x for x, g in zip(t, gone, strict=True) if not g)
        out[doc, len(t), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(frame, options=Options()):
    return Counter(map(tuple, substrings.report(frame, options).collect()))


def test_query_equals_brute_force(engine, small):
    rows = [(r["doc_id"], r["text"]) for r in small("documents").collect()]
    got = Counter(map(tuple, queries.op8_substrings(engine, "/root/testdata/sf0.001").collect()))
    assert got == brute(rows)


def test_edges(documents):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "a " * 200), (4, "b " * 34), (5, "c " * 35), (6, "c " * 36), (7, f"x {long} y"), (8, f"z\t{long}")]
    rows += [(9, " ".join(long.split()[:34])), (10, "xy " * 100 + long), (11, f"dup {long.upper()}"), (11, f"dup {long.upper()}"), (None, "ab cd ef " * 30)]
    got = found(clashing(documents(rows), "key", "marks", "symbols", "n_words", "kept"))
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_all_lengths_among_few_words(documents, seed):
    """Few distinct words make runs, periods and chance repeats of every length."""
    random.seed(seed)
    letters = "ab" if seed == 2 else "abcdefgh"
    passage = [random.choice(letters) for _ in range(90)]
    rows = []
    for i in range(60):
        own = [random.choice(letters) for _ in range(random.randrange(0, 60))]
        a, n = random.randrange(60), random.randrange(5, 60)
        at = random.randrange(len(own) + 1)
        rows.append((i, " ".join(own[:at] + passage[a : a + n] + own[at:])))
    rows.append((99, "ab " * 40 + "c " + "ab " * 40))
    assert found(documents(rows), Options(window=12, rounds=2)) == brute(rows, 12)


def test_very_long_text(documents):
    random.seed(1)
    own = [f"v{random.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(own)), (2, " ".join(own[70_000:70_050])), (3, "short")]
    assert found(documents(rows)) == brute(rows)


def test_empty_table_and_texts(documents):
    assert substrings.report(documents([])).count() == 0
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"a  b {long}"), (2, f"{long} c"), (3, "as  it was"), (4, long), (4, long), (5, None)]
    got = sorted((r["doc_id"], r["text"]) for r in substrings.shortened(documents(rows)).collect())
    assert got == [(1, "a b"), (2, "c"), (3, "as  it was"), (4, ""), (4, ""), (5, None)]


def test_words_and_windows_that_sums_of_powers_confuse(documents):
    """Thue-Morse words and runs of words, whose polynomial hashes modulo 2**64 meet their complements'."""
    mark = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[x ^ flip] for x in mark) for flip in (0, 1)]
    rest = " ".join(f"w{i}" for i in range(40))
    runs = [" ".join(("left", "right")[x ^ flip] for x in mark[:1100]) for flip in (0, 1)]
    rows = [(1, f"{words[0]} {rest}"), (2, f"{words[1]} {rest.replace('w5 ', 'v5 ')}"), (3, runs[0]), (4, runs[1])]
    rows += [(5, f"x {words[0]} " + "y " * 5), (6, " ".join(words * 20))]
    assert found(documents(rows)) == brute(rows)


def test_phrases_of_few_words_bring_no_texts_together():
    """Texts with phrases in common, and no window, share no anchor and are not compared."""
    random.seed(4)
    phrases = [" ".join(f"p{i}x{k}" for k in range(8)) for i in range(20)]
    texts = [" ".join(f"{' '.join(f'v{random.randrange(10**9)}' for _ in range(6))} {random.choice(phrases)}" for _ in range(40)) for _ in range(50)]
    found = substrings.Stretches(Words(pa.array(texts)), Options())
    assert max(Counter(found.symbol.tolist()).values()) == 1
    # Each window is in one stretch, and equal windows share their anchor wherever they begin.
    assert sum(found.high - found.low + 1) == sum(len(t.split()) - 34 for t in texts)
    moved = substrings.Stretches(Words(pa.array([" ".join(["x", *texts[0].split()[5:200]])])), Options())
    assert len(set(moved.symbol.tolist()) & set(found.symbol.tolist())) >= len(moved.symbol) - 3
