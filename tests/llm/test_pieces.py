from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from marquee.llm import pieces, queries
from marquee.llm.pieces import BLANK, Lattices, Options, sampled, vocabulary
from tests.llm.conftest import clashing

K3 = Options(samples=3)


@pytest.fixture(scope="module")
def lattices():
    return Lattices(vocabulary(K3), K3)


def brute(t, text):
    """Log probabilities of all segmentations."""
    whole = BLANK + text.replace(" ", BLANK)
    known = {p: i for i, p in enumerate(t.v.pieces) if not np.isnan(t.v.weights[i])}
    out = {}

    def walk(at, ids, weight):
        if at == len(whole):
            out[tuple(ids)] = weight
            return
        for n in range(1, t.longest + 1):
            part = whole[at : at + n]
            if len(part) == n and part in known:
                walk(at + n, [*ids, known[part]], weight + t.v.weights[known[part]])
        if whole[at] not in known:
            walk(at + 1, [*ids, *(t.v.bytes_at + b for b in whole[at].encode())], weight + t.unknown)

    walk(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: v - total for k, v in out.items()}


def test_samples_are_distinct_and_follow_the_law_without_replacement(lattices):
    t, text, n = lattices, "then a\nox", 8000
    law = brute(t, text)
    keys = np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(5)
    paths, bound = sampled(t, [text] * n, keys)
    ids = [[tuple(pieces._ids(t, p.edge[p.first[j] : p.first[j + 1]]).tolist()) for j in range(n)] for p in paths]
    assert all(len({x[j] for x in ids}) == 3 for j in range(n))
    for p, x in zip(paths, ids, strict=True):
        assert np.allclose(p.log, [law[y] for y in x])
    assert (paths[0].top > paths[1].top).all() and (paths[1].top > paths[2].top).all() and (paths[2].top > bound).all()
    second = defaultdict(float)
    for x in law:
        for y in law:
            if x != y:
                second[y] += np.exp(law[x] + law[y]) / -np.expm1(law[x])
    for want, got in ((({k: np.exp(v) for k, v in law.items()}), ids[0]), (second, ids[1])):
        seen = Counter(got)
        for k, p in want.items():
            assert abs(seen[k] / n - p) < 4.5 * np.sqrt(p * (1 - p) / n) + 1e-3
    # Weighing each sample by its inclusion score estimates the total probability, which is 1.
    weights = sum(np.exp(p.log) / -np.expm1(-np.exp(p.log - bound)) for p in paths)
    assert abs(weights.mean() - 1) < 0.02


def test_all_segmentations_where_there_are_few(lattices):
    law = brute(lattices, "ab")
    many = Lattices(lattices.v, Options(samples=len(law) + 3))
    paths, bound = sampled(many, ["ab"], np.array([3], np.uint64))
    got = {tuple(many.piece[p.edge].tolist()) for p in paths if p.there[0]}
    assert got == set(law) and np.isneginf(bound[0])


def test_round_trip_and_digests(engine, small):
    rows = queries.op5_pieces(engine, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in small("documents").collect()}
    import hashlib

    assert len(rows) == 2 * len(texts)
    assert all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
    assert len({(r["doc_id"], r["ids_sha256"]) for r in rows}) == len(rows)
    assert all(0 <= r["inclusion"] <= 1 and -np.inf < r["log_inclusion"] <= 0 and r["log_prob"] <= 0 for r in rows)


TEXTS = ["", " ", "  two  blanks ", "\ttab\nline", f"a{BLANK}b", "emoji 😀 ü 漢字", "x" * 3000, "word " * 20_000, "<s> <0x41> </s>"]


def test_edges(documents):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(50, None), (None, "same"), (None, "same"), (7, "word " * 20_000)]
    frame = clashing(documents(rows), "ids", "rank", "n_pieces")
    out = pieces.sample(frame).withColumn("back", pieces.decoded(pieces.F.col("ids"))).collect()
    back = defaultdict(set)
    for r in out:
        back[r["doc_id"]].add(r["back"])
    assert all(back[i] == {x} for i, x in enumerate(TEXTS)) and back[50] == {None} and back[None] == {"same"}
    only = [r for r in out if r["doc_id"] == 0]
    assert len(only) == 1 and only[0]["inclusion"] == 1.0
    same = Counter((r["rank"], bytes(r["ids"])) for r in out if r["doc_id"] is None)
    assert set(same.values()) == {2}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in out:
        if r["doc_id"] in (2, 3, 5):
            assert model.decode(np.frombuffer(r["ids"], "<i4").tolist()) == TEXTS[r["doc_id"]]


def test_results_do_not_depend_on_partitions_or_cache(documents):
    rows = [(i, f"some text number {i} with words{i % 7}") for i in range(60)]
    a = {tuple(r) for r in pieces.sample(documents(rows).repartition(1)).collect()}
    b = {tuple(r) for r in pieces.sample(documents(rows[::-1]).repartition(7), Options(nodes=10)).collect()}
    key = lambda x: {(r[0], r[1], bytes(r[2])) for r in x}
    assert key(a) == key(b)


def test_frequent_words_stay_when_room_is_made(lattices, monkeypatch):
    added, add = Counter(), Lattices.add
    monkeypatch.setattr(Lattices, "add", lambda t, words: (added.update(map(str, words)), add(t, words))[1])
    narrow, often = Lattices(lattices.v, Options(samples=3, nodes=120)), ["then", "a\nox", "漢字😀", f"a{BLANK}b", ""]
    for i in range(40):
        texts = [" ".join([*often, *often, f"once{i}", f"{i}漢"]), f"new{i} {often[i % 5]}"]
        keys, fresh = np.array([i, i + 1000], np.uint64), Lattices(lattices.v, K3)
        (got, bound), (want, wanted) = sampled(narrow, texts, keys), sampled(fresh, texts, keys)
        for p, q in zip(got, want, strict=True):
            assert pieces._ids(narrow, p.edge).tolist() == pieces._ids(fresh, q.edge).tolist()
            assert np.allclose(p.log, q.log) and np.allclose(p.top, q.top)
        assert np.allclose(bound, wanted)
    # In the fresh lattices every time, in the narrow ones once.
    assert [added[x] for x in [*often, "once0", "new39"]] == [41] * 5 + [2] * 2


def test_texts_without_words_and_nulls_alone(documents):
    for text in (None, "", " ", BLANK):
        out = pieces.sample(documents([(1, text)])).withColumn("back", pieces.decoded(pieces.F.col("ids"))).collect()
        assert len(out) == 1 and {r["back"] for r in out} == {text}
        assert all((r["log_prob"] is None) == (text is None) and r["n_pieces"] == len(r["ids"] or b"") // 4 for r in out)


def test_empty_table(documents):
    assert pieces.sample(documents([])).count() == 0
