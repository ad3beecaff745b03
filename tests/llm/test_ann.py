from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import ann, queries
from marquee.llm.ann import Options, Search
from marquee.llm.grid import Grid
from tests.llm.conftest import clashing

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    """Exact order by score and id; equal rows once, vectors of one length among themselves."""
    seen = {}
    for i, v in rows:
        fine = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if fine:
            seen[i, tuple(v)] = np.array(v, np.float64)
    out = defaultdict(list)
    for (i, a), x in seen.items():
        if i % 20 == 0:
            found = [(-float(x @ y), j) for (j, b), y in seen.items() if j != i and len(a) == len(b)]
            out[i] = [j for _, j in sorted(found)[:k]]
    return {i: v for i, v in out.items() if v}


def ids(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append(r["vec_id"])
    return dict(out)


def test_query_equals_brute_force(engine, small):
    rows = [(r["vec_id"], r["embedding"]) for r in small("embeddings").collect()]
    got = queries.op1_ann(engine, "/root/testdata/sf0.001")
    assert ids(got) == brute(rows)
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    assert all(abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-12 for r in got.collect())


def test_small_blocks_and_edges(engine):
    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(40)]  # ties
    rows += [rows[3], rows[20], (500, None), (520, []), (540, [0.0] * 6), (560, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(580, [float("nan")] * 6), (600, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(620, [1.0, 2.0]), (621, [3.0, 4.0]), (640, [9.0])]
    frame = engine.createDataFrame([(*r, 0) for r in rows], VECTORS)
    frame = clashing(frame, "id", "vector", "q", "c", "length", "score")
    got = ann.nearest(frame, F.col("vec_id") % 20 == 0, Options(rows=37, queries=5, grid=Grid(block=6, least=40)))
    assert ids(got) == brute(rows)


def test_fewer_candidates_and_empty_tables(engine):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])]
    frame = engine.createDataFrame([(*r, 0) for r in rows], VECTORS)
    assert ids(ann.nearest(frame, F.col("vec_id") % 20 == 0)) == {0: [1, 2]}
    none = engine.createDataFrame([], VECTORS)
    assert ann.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_keep_every_neighbour_across_tiles():
    random = np.random.default_rng(2)
    for scale in (1.0, 1e-6, 1e6):
        c = random.standard_t(2, size=(500, 48)) * scale
        q = c[:40]
        search = Search(np.arange(40), q, Options(k=10, rows=90, queries=16))
        for a in range(0, 500, 200):
            search.meet(np.arange(a, min(a + 200, 500)), c[a : a + 200])
        found = search.found().to_pydict()
        i, j = np.array(found["query_id"]), np.array(found["vec_id"])
        exact = q @ c.T
        for row in range(40):
            exact[row, row] = -np.inf
            assert set(j[i == row]) == set(np.argsort(-exact[row])[:10])


def test_numbers_beyond_the_bounds(engine):
    """Norms that leave the range of doubles, scores that do, and scores that are no number."""
    random = np.random.default_rng(3)
    rows = [(i, (random.normal(size=6) * 10.0 ** random.integers(-3, 4)).tolist()) for i in range(100)]
    rows += [(20, [1e200, -1e200, 1.0, 0.0, 0.0, 0.0]), (121, [1e-5, 1e-5, 3.0, 0.0, 0.0, 0.0]), (122, [0.0, 0.0, 5.0, 0.0, 0.0, 0.0])]
    rows = [r for r in rows if r[0] != 20 or r[1][0] == 1e200]
    frame = engine.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    assert ids(ann.nearest(frame, F.col("vec_id") % 20 == 0)) == brute(rows)
    odd = [(0, [1e200, -1e200]), (1, [1e200, 1e200]), (2, [1e200, 0.0]), (3, [-1e200, 0.0]), (4, [1.0, 1.0])]
    frame = engine.createDataFrame([(*r, 0) for r in odd], "vec_id long, embedding array<double>, label int")
    got = ann.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 4, 3, 1] and got[0]["score"] == np.inf and np.isnan(got[3]["score"])
