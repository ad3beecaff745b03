from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

from marquee.llm import neardup, queries
from marquee.llm.components import components
from marquee.llm.neardup import Options, superminhash
from tests.llm.conftest import clashing

LAX = Options(shingle=3, percent=85)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else []))


def brute(rows, n=3, percent=85):
    """Sizes and components by comparing all pairs that share a shingle."""
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    sets, at = [shingles(t, n) for _, t in rows], defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in at[s])
        for s in own:
            at[s].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = find(rows[i][0]), find(rows[j][0])
                up[max(a, b)] = min(a, b)
    return Counter((d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True))


def found(frame, options=LAX):
    return Counter(map(tuple, neardup.group(frame, options).collect()))


def test_query_equals_brute_force(engine, small):
    rows = [(r["doc_id"], r["text"]) for r in small("documents").collect()]
    got = Counter(map(tuple, queries.op10_neardup(engine, "/root/testdata/sf0.001").collect()))
    assert got == brute(rows)


def test_chains_and_large_groups_of_near_copies(documents):
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    base = random.sample(words, 120)
    rows = []
    for i in range(120):  # copies of one text, each with a change of its own
        own = list(base)
        own[random.randrange(120)] = f"x{i}"
        rows.append((i + 1000, " ".join(own)))
    for i in range(30):  # a chain: neighbours are alike, ends are not
        rows.append((500 - i, " ".join(words[i * 2 : i * 2 + 100])))
    random.shuffle(rows)
    assert found(documents(rows)) == brute(rows)


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "a b c d " * 30_000), (9, "A B C D " * 30_000), (8, "x y z"), (8, "x y z")]
    got = found(clashing(documents(rows), "component_id", "kept", "n", "bucket", "node", "digest", "label"))
    assert got == brute(rows)
    assert got[(5, 1, 4, False)] == 1 and got[(9, 4, 7, False)] == 1 and got[(8, 1, 8, True)] == 2


def test_rows_of_one_id_hold_their_texts_together(documents):
    rows = [(3, "a b c d"), (5, "a b c d"), (5, "k l m n"), (6, "k l m n"), (None, "a b c d")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.group(documents(rows), LAX).collect()}
    assert got == {(3, 3, True), (5, 3, False), (6, 3, False), (None, None, True)}


def test_words_that_sums_of_powers_confuse(documents):
    """Thue-Morse words, whose polynomial hashes modulo 2**64 meet their complements'."""
    mark = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in mark) for flip in (0, 1))
    rows = [(1, f"x {a}"), (2, f"x {b}"), (3, f"x y {a} z u v w"), (4, f"x y {b} z u v w"), (5, " ".join([a, b] * 9)), (6, " ".join([b, a] * 9))]
    assert found(documents(rows)) == brute(rows)


def test_unlike_texts_of_one_id_all_stay(documents):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(1, words[0]), (1, words[1]), (1, words[1].upper()), (2, words[0]), (3, words[2]), (3, words[3]), (3, None), (3, None), (4, words[2])]
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in neardup.drop_copies(documents(rows), LAX).collect()]
    assert sorted(t for _, t in kept) == ["", *sorted(words)]
    assert {(1, words[1]), (3, words[3]), (3, "")} <= set(kept)


def test_empty_table(documents):
    assert neardup.group(documents([])).count() == 0
    assert neardup.drop_copies(documents([])).count() == 0


def test_one_row_of_each_group_stays(documents):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words than those"), (3, "other words than those"), (4, None), (None, "x")]
    kept = neardup.drop_copies(clashing(documents(rows), "place", "row", "kept"))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "place", "row", "kept"]


def test_signatures_estimate_similarity_better_than_independent_minima():
    random_ = np.random.default_rng(0)
    m, errors = 64, []
    for _ in range(150):
        both, a, b = (random_.integers(0, 2**63, k).astype(np.uint64) for k in (20, 6, 6))
        sets = [np.unique(np.concatenate((both, x))) for x in (a, b)]
        ranks = superminhash(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), m, 1)
        errors.append((ranks[0] == ranks[1]).mean() - 20 / 32)
    assert abs(np.mean(errors)) < 0.02
    # Small sets fill the slots by exclusion: the spread is below that of m independent draws.
    assert np.var(errors) < 0.8 * (20 / 32) * (12 / 32) / m


def test_signature_equals_step_by_step_definition():
    """One element at a time with a whole permutation each, and no early stop."""
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 7).astype(np.uint64))
    m = 24
    got = superminhash(values, np.array([0, len(values)]), m, 9)[0]
    slots = [2**64 - 1] * m
    for v in values:
        state = neardup.mix(np.array([v]) ^ neardup.mix(np.array([9], np.uint64)))
        place = list(range(m))
        for j in range(m):
            drawn = int(neardup.mix(state + np.uint64((j + 1) * int(neardup._STEP) & (1 << 64) - 1))[0])
            k = j + ((drawn >> 40) * (m - j) >> 24)
            place[j], place[k] = place[k], place[j]
            slots[place[j]] = min(slots[place[j]], j << 32 | drawn & 0xFFFFFFFF)
    assert got.tolist() == slots


def test_components_of_paths_and_stars(engine):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (139, 200), (140, 139)]
    got = {r["node"]: r["component"] for r in components(engine.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(2, 61)} | {i: 100 for i in [*range(101, 140), 140, 200]}
    assert got == want


def test_no_links(engine):
    assert components(engine.createDataFrame([], "a long, b long")).count() == 0


def test_texts_are_signed_a_little_at_a_time():
    """The permutations of a megabyte of text took more than 100 MB."""
    import tracemalloc

    import pyarrow as pa

    random.seed(4)
    texts = pa.array([" ".join(str(random.randrange(10**6)) for _ in range(3000)) for _ in range(60)])
    tracemalloc.start()
    found = neardup.signatures(texts, Options())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 60 and peak < 60e6
