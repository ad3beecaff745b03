from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import negatives, queries, sql
from marquee.llm.grid import Grid
from marquee.llm.negatives import Anchors, Options, Rows, coded, intervals, mine
from tests.compare import database, difference
from tests.llm.conftest import clashing

VECTORS = "vec_id long, embedding array<double>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100):
    """All pairs in whole numbers of any size."""
    one = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        if len(whole) * max((abs(x) for x in whole), default=0) ** 2 < 1 << 60:
            one[i] = min(one.get(i, (label, whole)), (label, whole))
    out = set()
    for a, (label, x) in one.items():
        if a % every:
            continue
        pairs = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y) in one.items() if i != a and len(x) == len(y))
        positives = [(-s, i) for s, i, other in pairs if other == label][:5]
        for top, i in positives:
            fit = [(-s, j) for s, j, other in pairs if other != label and 80 * top <= -100 * s <= 100 * top][:5]
            out |= {(a, i, k + 1, j, top, s) for k, (s, j) in enumerate(fit)}
    return out


def rows_of(frame):
    rows = [tuple(r[n] for n in NAMES) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force_and_sql(engine, small):
    moved = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in small("embeddings").collect()]
    got = queries.op11_negatives(engine, "/root/testdata/sf0.001")
    assert rows_of(got) == brute(moved) != set()
    assert difference(got, database("/root/testdata/sf0.001"), sql.QUERIES["op11_negatives"])[0] is None


def clustered(random, n, width):
    centre = random.normal(size=(6, width))
    return [(i, (centre[i % 6] + random.normal(size=width) * 0.7).tolist(), int(random.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("width", [6, 64, 300])
def test_small_fields_and_edges(engine, width):
    random = np.random.default_rng(width)
    rows = clustered(random, 400, width)
    rows += [(500 + i, [1.0] * width, i % 3) for i in range(60)]  # ties
    rows += [rows[5], (rows[10][0], [2.0] * width, 0), (700, None, 1), (701, [], 1), (800, [], 2), (801, [], 2)]
    rows += [(702, [float("nan")] * width, 1), (703, [float("inf")] * width, 1), (704, [None] * width, 1), (None, [1.0] * width, 1)]
    rows += [(705, [1.0] * width, None), (900, [1e300] * width, 1), (901, [3.0], 1), (1000, [2.0], 1), (902, [2.5], 2), (1100, [0.0] * width, 3)]
    frame = engine.createDataFrame([(i, v, label) for i, v, label in rows], VECTORS)
    frame = clashing(frame, "id", "vector", "length", "codes", "wanted", "block", "side")
    got = mine(frame, F.col("vec_id") % 20 == 0, Options(grid=Grid(block=7, least=50)))
    assert rows_of(got) == brute(rows, 20) != set()


def test_extreme_numbers(engine):
    random = np.random.default_rng(1)
    rows = [(i, (random.normal(size=8) * 10.0 ** random.integers(-3, 7)).tolist(), i % 2) for i in range(200)]
    frame = engine.createDataFrame(rows, VECTORS)
    assert rows_of(mine(frame, F.col("vec_id") % 20 == 0)) == brute(rows, 20) != set()


def test_no_rows_one_row(engine):
    assert mine(engine.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    assert mine(engine.createDataFrame([(0, [1.0], 1)], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("codes", [1, 2, 4])
def test_intervals_hold_the_product_and_spare_work(codes):
    import pyarrow as pa

    random = np.random.default_rng(codes)
    options = Options(codes=codes)
    centre = random.normal(size=(40, 64)) * 30
    x = np.floor(centre[random.integers(0, 40, 1000)] + random.normal(size=(1000, 64)) * 6).astype(np.int64)
    words, aligned, rest = coded(x, options)
    base = {"id": np.arange(1000), "label": np.zeros(1000, np.int64)}
    lists = {"vector": pa.array(x.tolist(), pa.list_(pa.int64())), "codes": pa.array(words.reshape(1000, -1).view(np.int64).tolist()), "aligned": pa.array(aligned.tolist())}
    table = pa.RecordBatch.from_pydict({**base, **lists, "rest": rest, "wanted": [None] * 1000})
    q, c = Anchors([table.slice(0, 50)], 64, options), Rows(table, 64, options)
    low, high = intervals(q, slice(0, 50), c, 64)
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    # Each further code leaves less room around the estimate.
    spare = high < np.sort(low, 1)[:, -5][:, None]
    assert spare.mean() >= {1: 0.0, 2: 0.5, 4: 0.9}[codes]
