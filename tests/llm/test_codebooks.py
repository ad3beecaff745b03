from __future__ import annotations

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import queries, sql
from marquee.llm.codebooks import Options, compress, nearest
from tests.compare import database, difference
from tests.llm.conftest import clashing

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain loops over whole numbers; rows of one length that ``parts`` divides."""
    fine = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in fine:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    width = len(fine[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            met = {}
            for _, v, _ in fine:
                met.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(met[k]) for x in zip(*met[k], strict=True)] if k in met else c for k, c in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in fine]
    sums = {}
    for _, label, x in found:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in x)
    return sorted(((i, "".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x), sums[label], digest) for i, label, x in found), key=repr)


def rows_of(frame):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def test_query_equals_sql(engine):
    folder = "/root/testdata/sf0.001"
    assert difference(queries.op12_codebooks(engine, folder), database(folder), sql.QUERIES["op12_codebooks"])[0] is None


def test_brute_force_with_ties_repeats_and_nulls(engine):
    random = np.random.default_rng(4)
    rows = [(i, np.round(random.normal(size=8), 1).tolist(), int(i % 3) if i % 5 else None) for i in range(200)]
    rows += rows[:30] + [(7, [9.0] * 8, 1), (None, [0.5] * 8, 1)] + [(300 + i, [0.25] * 8, 2) for i in range(50)]
    rows += [(400, None, 1), (401, [1.0, None] * 4, 1), (402, [float("nan")] * 8, 1), (403, [float("-inf")] * 8, None)]
    frame = engine.createDataFrame(rows, VECTORS)
    frame = clashing(frame, "id", "vector", "length", "code", "error", "of")
    for options in (Options(entries=16), Options(entries=256)):
        assert rows_of(compress(frame, options)) == brute(rows, entries=options.entries)


def test_lengths_large_numbers_and_missing_ids(engine):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.5], 1), (3, [], 2), (4, [5.0], 2), (None, [1.0, 1.0], 3), (5, [1e200, 1.0, 2.0], 1)]
    got = {r["vec_id"]: r for r in compress(engine.createDataFrame(rows, VECTORS), Options(entries=1)).collect()}
    assert got[3]["code"] == got[4]["code"] == "00000000" and got[3]["error"] == got[4]["error"] == 0
    # The mean of 3072 and 3584 is 3328; each is 256 away from it.
    assert (got[1]["error"], got[2]["error"], got[1]["label_error"]) == (65536, 65536, 131072)
    assert got[None]["code"] is got[None]["error"] is got[None]["label_error"] is got[None]["codebooks_sha256"] is None
    assert got[5]["code"] is None and got[5]["label_error"] == 131072
    assert len({got[i]["codebooks_sha256"] for i in (1, 3, 4)}) == 3
    assert compress(engine.createDataFrame([], VECTORS)).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 5), st.integers(1, 40), st.integers(0, 2**32), st.sampled_from([2, 50, 1 << 24]))
def test_search_finds_the_nearest_and_the_lower_number(width, many, seed, size):
    random = np.random.default_rng(seed)
    parts, book = random.integers(-size, size, (30, width)), random.integers(-size, size, (many, width))
    number, best = nearest(parts, book)
    every = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (best == every.min(1)).all()
