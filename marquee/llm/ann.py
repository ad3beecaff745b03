"""Nearest neighbours by a block matrix join.

A task holds a block of queries and streams a strip of all rows through (see ``grid``), a tile at a
time. A tile is first multiplied in 8-bit numbers: with x = s a + e, where a are whole numbers up to
127 and e is what rounding leaves, a product x y differs from s t (a b) by at most
|e||y| + s|a||f|, all of which are known per vector. A pair whose upper bound is below the k-th best
score of its query so far, or below the k-th largest lower bound in the tile, can't be among the k
nearest; the other pairs are computed again in double precision. A strip's best k per query are
merged by heaps. No pair is lost, so the result is exact.

A query set that grows with the table makes work that grows with its square, but what is shuffled
grows with the blocks of queries, and what comes out of the tiles with the strips.

Defined results
* null, empty and zero vectors, and vectors with a null or non-finite component, take no part;
  neither do rows without an id.
* vectors are compared with those of their own length only.
* equal rows (id and vector) count once. Other rows with the query's id are no candidates.
* ties go to the smaller id. Fewer candidates than k: all of them. An empty table: no rows.
* where bounds leave the range of doubles, pairs are scored; where scores do, they are infinite,
  and those that are no number come last.
* other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.grid import Best, Grid, dealt, fields, matrix
from marquee.session import stored


@dataclass(frozen=True)
class Options:
    """``rows`` and ``queries``: those of a tile."""

    k: int = 20
    rows: int = 2048
    queries: int = 512
    grid: Grid = field(default_factory=Grid)


FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """``id, vector`` of the rows that take part, each once."""
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & fine & F.exists(values, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("id"), values.alias("vector")).distinct()


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers, scales, lengths of the rounded vectors and of what rounding leaves."""
    top = np.abs(x).max(1)
    whole = np.rint(x / top[:, None] * 127)
    scale = top / 127
    rounded = whole * scale[:, None]
    return whole.astype(np.int8), scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1)


def _whole_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 8-bit rows; sums of up to 1,000 of them are exact in single precision."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1000):
        out += a[:, i : i + 1000].astype(np.float32) @ b[:, i : i + 1000].astype(np.float32).T
    return out


class Search:
    """The k nearest of some queries among the rows that they have met."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, options: Options):
        self.ids, self.x, self.options = ids, x, options
        self.whole, self.scale, self.length, self.apart = _quantised(x)
        self.best = Best(len(ids), options.k, np.float64)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        size = self.options.queries
        with np.errstate(all="ignore"):
            for a in range(0, len(ids), self.options.rows):
                c_ids, c = ids[a : a + self.options.rows], x[a : a + self.options.rows]
                known = *_quantised(c), np.linalg.norm(c, axis=1)
                for i in range(0, len(self.ids), size):
                    self._tile(slice(i, min(i + size, len(self.ids))), c_ids, c, *known)

    def _tile(self, some: slice, ids, c, whole, scale, length, apart, norm) -> None:
        k, q = self.options.k, self.x[some]
        about = _whole_product(self.whole[some], whole) * self.scale[some][:, None] * scale[None, :]
        # The last term covers the rounding of these few operations themselves.
        own_length = self.length[some][:, None]
        slack = self.apart[some][:, None] * norm[None, :] + own_length * apart[None, :] + 1e-9 * (own_length * norm[None, :])
        own = self.ids[some][:, None] == ids[None, :]
        floor = self.best.floor[some]
        if len(ids) > k:
            low = np.where(own | ~np.isfinite(about - slack), -np.inf, about - slack)
            floor = np.maximum(floor, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        # Bounds that are no numbers exclude nothing.
        row, col = np.nonzero(~(about + slack < floor[:, None]) & ~own)
        for i in range(0, len(row), 1 << 16):
            x, y = row[i : i + (1 << 16)], col[i : i + (1 << 16)]
            # A running sum adds the components in their order, as a plain loop does.
            self.best.add(x + some.start, ids[y], np.cumsum(q[x] * c[y], axis=1)[:, -1])

    def found(self) -> pa.RecordBatch:
        best = self.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[best.row], best.id, best.score)], ["query_id", "vec_id", "score"])


def _searched(options: Options):
    """One search per field of the grid, over the rows that stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asking, now = None, [], None
        for where, side, batch in fields(batches, ["length"]):
            if where != at:
                if now is not None:
                    yield now.found()
                at, asking, now = where, [], None
            ids, x = batch.column("id").to_numpy(), matrix(batch.column("vector"))
            if side == 0:
                asking.append((ids, x))
                continue
            if now is None:
                now = Search(*map(np.concatenate, zip(*asking, strict=True)), options)
            now.meet(ids, x)
        if now is not None:
            yield now.found()

    return run


def _merged(k: int):
    """A heap of the k best for one query after the other; the rows come in order of queries."""

    def row(q: int, heap: list) -> pa.RecordBatch:
        best = sorted(heap, reverse=True)
        columns = [pa.array([q] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32())]
        columns += [pa.array([-v for _, _, v, _ in best], pa.int64()), pa.array([s for *_, s in best], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "rank", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []
        for batch in batches:
            for q, v, s in zip(*(batch.column(n).to_pylist() for n in ("query_id", "vec_id", "score")), strict=True):
                if q != now:
                    if heap:
                        yield row(now, heap)
                    now, heap = q, []
                # A score that is no number is below all others.
                item = (s == s, s if s == s else 0.0, -v, s)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                else:
                    heapq.heappushpop(heap, item)
        if heap:
            yield row(now, heap)

    return run


def nearest(vectors: DataFrame, asks: Column, options: Options = Options()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product of every row where
    ``asks`` (a condition on ``vec_id``) holds."""
    rows = stored(usable(vectors), "vectors").withColumn("length", F.size("vector"))
    asking = rows.withColumnRenamed("id", "vec_id").where(asks).withColumnRenamed("vec_id", "id")
    found = dealt(rows, asking, ["length"], options.grid).mapInArrow(_searched(options), FOUND)
    merged = found.repartition("query_id").sortWithinPartitions("query_id")
    return merged.mapInArrow(_merged(options.k), "query_id long, rank int, vec_id long, score double")
