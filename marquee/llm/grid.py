"""Rows that ask against all rows of a table, as a grid of blocks and strips.

Rows that ask are dealt into blocks, all rows into strips. A task holds one block, streams one strip
through and keeps the best it has met, so that what is sent grows with blocks times rows and what
comes out with strips times rows that ask. No pair of rows is ever shuffled. One block is enough
until more rows ask than a block holds; strips are as many as keep the cluster busy, and longer
tables get more of them, so that a lost executor costs a bounded piece of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """``block``: asking rows that a task holds. A strip has about ``least`` to ``most`` rows."""

    block: int = 1 << 14
    least: int = 1 << 10
    most: int = 1 << 22


def partitions(frame: DataFrame) -> int:
    spark = frame.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, asking: DataFrame, keys: list[str], grid: Grid = Grid()) -> DataFrame:
    """Both frames dealt out; only rows that are equal in ``keys`` (whole numbers) can meet.

    Both have the same columns, a unique ``id`` among them, and must give the same rows whenever
    they are read. The result adds ``block, strip, side`` and holds for each of the grid's fields
    the rows that ask (side 0) and after them the others (side 1).
    """
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = asking.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(grid.block)).alias("blocks"))
    strips = F.greatest(F.ceil(F.col("n") / F.lit(grid.most)), F.ceil(F.lit(tasks) / F.col("blocks")))
    shape = few.join(many, keys).select(*keys, "blocks", F.least(strips, F.ceil(F.col("n") / F.lit(grid.least))).alias("strips"))
    inner = rows.columns
    block = F.pmod(F.xxhash64("id", F.lit("block")), "blocks")
    strip = F.pmod(F.xxhash64("id", F.lit("strip")), "strips")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    ask = asking.join(shape, keys).select(*inner, block.alias("block"), every("strips").alias("strip"), F.lit(0).alias("side"))
    met = rows.join(shape, keys).select(*inner, every("blocks").alias("block"), strip.alias("strip"), F.lit(1).alias("side"))
    field = [*keys, "block", "strip"]
    return ask.union(met).repartition(partitions(rows), *field).sortWithinPartitions(*field, "side")


def fields(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """The runs of rows of one field and side: ``field, side, rows``."""
    names = [*keys, "block", "strip", "side"]
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield tuple(marks[:-1, a].tolist()), int(marks[-1, a]), batch.slice(a, b - a)


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


class Best:
    """The ``k`` best of each of ``rows``: larger scores first, then smaller ids."""

    def __init__(self, rows: int, k: int, kind: type):
        self.k = k
        self.row, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)
        # The k-th score where there are as many.
        self.floor = np.full(rows, -np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.zeros(len(self.floor), bool)
        touched[row] = True
        mine = touched[self.row]
        r = np.concatenate((self.row[mine], row))
        i = np.concatenate((self.id[mine], ids))
        s = np.concatenate((self.score[mine], score.astype(self.score.dtype, copy=False)))
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        good = place < self.k
        last = place == self.k - 1
        self.floor[r[last]] = np.where(np.isnan(s[last]), -np.inf, s[last]) if s.dtype.kind == "f" else s[last]
        self.row = np.concatenate((self.row[~mine], r[good]))
        self.id = np.concatenate((self.id[~mine], i[good]))
        self.score = np.concatenate((self.score[~mine], s[good]))
