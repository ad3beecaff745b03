from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from marquee.llm import packing, queries
from marquee.llm.packing import Options, Room, packed_rows
from marquee.llm.tokens import Tokens, read
from tests.llm.conftest import clashing

TOKENS = Tokens(read())


def test_tree_gives_the_tightest_room():
    random.seed(1)
    room, held = Room(100), []
    for step in range(3000):
        if random.random() < 0.5:
            free = random.randrange(101)
            room.put(free, step)
            held.append((free, step))
        else:
            need = random.randrange(1, 101)
            found = room.take(need)
            fits = [x for x, _ in held if x >= need]
            assert (found is None) == (not fits)
            if found:
                assert found[1] == min(fits)
                held.remove((found[1], found[0]))


def test_rows_are_best_fit_decreasing():
    random.seed(2)
    sizes = [random.randrange(1, 65) for _ in range(500)]
    rows = packed_rows(sizes, 64)
    assert sorted(k for r in rows for k in r) == list(range(500))
    assert all(sum(sizes[k] for k in r) <= 64 for r in rows)
    free, want = [], []
    for k in sorted(range(500), key=lambda k: -sizes[k]):
        fits = [f for f in free if f >= sizes[k]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[k])
        else:
            free.append(64 - sizes[k])
    want = len(free)
    assert len(rows) == want


def documents_of(packed, options):
    """Texts put together again, checking the layout on the way."""
    out = defaultdict(dict)
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], TOKENS.dtype)
        assert len(ids) == options.length and r["ends"][0] == 0 and r["used"] == r["ends"][-1] <= options.length
        assert r["resets"] == r["ends"][:-1] and len(r["parts"]) == len(r["resets"])
        assert (ids[r["used"] :] == TOKENS.end).all()
        for part, a, b in zip(r["parts"], r["ends"], r["ends"][1:], strict=False):
            assert part["offset"] not in out[part["doc_id"]]
            out[part["doc_id"]][part["offset"]] = ids[a:b]
    texts = {}
    for doc, parts in out.items():
        ids = np.concatenate([parts[k] for k in sorted(parts)])
        assert sorted(parts) == [0, *np.cumsum([len(parts[k]) for k in sorted(parts)])[:-1].tolist()]
        assert ids[-1] == TOKENS.end and (ids[:-1] != TOKENS.end).all()
        texts[doc] = TOKENS.decode(ids[:-1].tobytes())
    return texts


def test_round_trip_of_a_whole_table(small):
    options = Options(length=256, block=20_000)
    packed = packing.pack(small("documents"), options)
    assert documents_of(packed, options) == {r["doc_id"]: r["text"] for r in small("documents").collect()}


def test_query(engine, small):
    rows = queries.op3_packing(engine, "/root/testdata/sf0.001").collect()
    assert {d for r in rows for d in r["doc_ids"]} == {r["doc_id"] for r in small("documents").collect()}
    assert sum(r["used"] for r in rows) > 0.97 * 2048 * (len(rows) - 1)


def test_edges(documents):
    options = Options(length=32)
    texts = {1: "", 2: " ", 3: "  a  b\n\n c ", 4: "word " * 5000, 5: "x" * 20_000, 6: "é😀漢" * 50, 7: "<|endoftext|>"}
    frame = clashing(documents([*texts.items(), (8, None)]), "ids", "row", "parts", "block")
    assert documents_of(packing.pack(frame, options), options) == texts
    assert packing.pack(documents([])).count() == 0 and packing.pack(documents([(1, None)])).count() == 0
    twice = packing.pack(documents([(1, "same"), (1, "same"), (None, "same")]).coalesce(1), options).first()
    assert [p["doc_id"] for p in twice["parts"]] == [1, 1, None]


def test_unpack_and_write(engine, documents, tmp_path):
    options = Options(length=16)
    frame = documents([(1, "some words to be cut in two or three rows of sixteen tokens each " * 2), (2, "b")])
    packing.write(frame, str(tmp_path / "rows"), options)
    parts = defaultdict(dict)
    for r in packing.unpack(engine.read.parquet(str(tmp_path / "rows")), options).collect():
        parts[r["doc_id"]][r["offset"]] = bytes(r["ids"])
    whole = {d: b"".join(p[k] for k in sorted(p)) for d, p in parts.items()}
    assert TOKENS.decode(whole[2]) == "b" and TOKENS.decode(whole[1]).startswith("some words") and len(parts[1]) > 1


def test_long_pieces_have_the_ids_of_the_vocabulary():
    tokens = Tokens(read())
    for text in ("ab" * 40_000, "x " + "é" * 9_000 + " y", "!" * 20_000, "\n" * 10_000 + "a"):
        ids = tokens.encode(text)
        assert np.frombuffer(ids, tokens.dtype).tolist() == tokens._encoding.encode_ordinary(text)
        assert tokens.decode(ids) == text
