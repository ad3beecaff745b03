"""Hard negatives by rotated one-bit codes whose error is known.

A vector x of whole numbers is rotated, and the signs of its components are its first code: a
vector c of +1 and -1 over the square root of the dimension. The alignment a = <x, c> is stored with
the code, and what is left, x - a c, is coded again in the same way, ``codes`` times. With the sum of
the aligned codes y and the last rest r, <x, q> = <y, q> + <r, q>. For an anchor q in ``_PLANES`` bit
planes, <y, q> is estimated by counting the bits that codes and planes have in common. Both errors are
bounded by the Cauchy-Schwarz inequality, |<r, q>| <= |r||q| and |<y, q - planes>| <= |y||q - planes|,
so an interval holds the true product with certainty. Only pairs whose interval reaches what is asked
for are scored in whole numbers, hence the result is exact.

Anchors meet the rows in the fields of a grid, twice: those of their own label for positives, then all
for negatives. A field keeps the best rows per anchor, or per anchor and positive.

Defined results
* rows without an id, a label or a vector, and vectors with a null or non-finite component, take no
  part. Neither do vectors whose length times squared largest component (after scaling) reaches 2**60,
  whose products could leave the range of longs.
* of rows with one id, the first by label, then vector, takes part, so equal rows count once.
* vectors are compared with those of their own length only; empty and zero vectors score 0.
* ties go to the smaller id. An anchor that is alone in its label has no rows, and neither has a
  positive without a row of another label in its band; a negative positive score has an empty band.
* an empty table gives no rows; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.grid import Best, Grid, dealt, fields, matrix
from marquee.llm.scratch import drop
from marquee.session import stored


@dataclass(frozen=True)
class Options:
    """``low``: a negative's least share of the positive's score, in percent; ``codes``: one-bit
    codes of a vector, each of what the earlier ones leave."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80
    codes: int = 4
    seed: int = 3
    grid: Grid = field(default_factory=Grid)


_PLANES = 8
# Components that are rotated together; longer vectors are rotated piece by piece.
_TURN = 256
# Anchors and rows of a tile.
_ANCHORS, _ROWS = 512, 2048
# Allowance for the rounding of rotations and estimates themselves, a share of both norms.
_ROUNDING = 1e-9


def usable(vectors: DataFrame, options: Options) -> DataFrame:
    """``id, label, length, vector`` of the rows that take part, a row per id."""
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 40)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    whole = F.transform(values, lambda x: F.floor(x * float(options.scale)))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))
    most = F.aggregate("vector", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x))).cast("double")
    rows = rows.where(F.size("vector") * most * most < float(1 << 60))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x"))
    return one.select("id", "x.label", F.size("x.vector").alias("length"), "x.vector")


@lru_cache(maxsize=8)
def rotations(width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Orthogonal matrices for the pieces of a vector."""
    out = []
    for at in range(0, width, _TURN):
        random = np.random.default_rng((seed, at))
        size = min(_TURN, width - at)
        out.append(np.linalg.qr(random.normal(size=(size, size)))[0])
    return tuple(out)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    parts = rotations(x.shape[1], seed)
    return np.concatenate([x[:, i * _TURN : (i + 1) * _TURN] @ m for i, m in enumerate(parts)], 1) if parts else x


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    packed = np.packbits(bits, 1)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def coded(x: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x codes x words), alignments (rows x codes) and the norm of what is left."""
    rest = rotated(x.astype(np.float64), options.seed)
    root = np.sqrt(max(x.shape[1], 1))
    words, aligned = [], []
    for _ in range(options.codes):
        positive = rest >= 0
        a = np.abs(rest).sum(1) / root
        words.append(_words(positive))
        aligned.append(a)
        rest = rest - np.where(positive, 1.0, -1.0) * (a / root)[:, None]
    return np.stack(words, 1), np.stack(aligned, 1), np.linalg.norm(rest, axis=1)


INDEX = "id long, label long, length int, vector array<long>, codes array<long>, aligned array<double>, rest double"


def _indexed(options: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, length)
                words, aligned, rest = coded(x, options)
                lists = [pa.array(y.tolist(), k) for y, k in ((words.reshape(len(x), -1).view(np.int64), pa.list_(pa.int64())), (aligned, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists, pa.array(rest)], [*part.schema.names, "codes", "aligned", "rest"])

    return run


class Anchors:
    """Anchors of a block: their vectors, and their rotations in bit planes."""

    def __init__(self, batches: list[pa.RecordBatch], length: int, options: Options):
        joined = pa.Table.from_batches(batches).combine_chunks()
        self.id, self.label = (joined.column(c).to_numpy() for c in ("id", "label"))
        self.x = _vectors(joined.column("vector").combine_chunks(), length)
        self.wanted = joined.column("wanted").to_pylist()
        turned = rotated(self.x.astype(np.float64), options.seed)
        self.low = turned.min(1, initial=0.0)
        top = turned.max(1, initial=0.0)
        self.step = np.where(top > self.low, (top - self.low) / (2**_PLANES - 1), 1.0)
        number = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.sum = number.sum(1)
        self.planes = [_words((number >> b & 1).astype(bool)) for b in range(_PLANES)]
        near = self.low[:, None] + number * self.step[:, None]
        self.apart = np.linalg.norm(turned - near, axis=1)
        self.norm = np.linalg.norm(turned, axis=1)


class Rows:
    """Rows of a tile as the index has them."""

    def __init__(self, batch: pa.RecordBatch, length: int, options: Options):
        self.id, self.label = (batch.column(c).to_numpy() for c in ("id", "label"))
        self.x = _vectors(batch.column("vector"), length)
        words = batch.column("codes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.codes = words.reshape(len(self.id), options.codes, -1)
        self.aligned = matrix(batch.column("aligned"))
        self.rest = batch.column("rest").to_numpy()
        # The sum of aligned codes is the vector but for the rest.
        self.norm = np.linalg.norm(self.x.astype(np.float64), axis=1)
        self.coded = self.norm + self.rest


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def intervals(q: Anchors, some: slice, c: Rows, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the products of the anchors ``some`` with the rows of a tile."""
    root = np.sqrt(max(length, 1))
    about = np.zeros((len(q.low[some]), len(c.id)))
    for m in range(c.codes.shape[1]):
        common = np.zeros(about.shape, np.int64)
        ones = np.zeros(len(c.id), np.int64)
        for w in range(c.codes.shape[2]):
            code = c.codes[:, m, w]
            ones += np.bitwise_count(code)
            for b in range(_PLANES):
                common += np.bitwise_count(q.planes[b][some, w][:, None] & code[None, :]).astype(np.int64) << b
        # The product with a vector of +1 and -1: twice the positive components less all of them.
        signed = q.low[some][:, None] * (2 * ones - length)[None, :] + q.step[some][:, None] * (2 * common - q.sum[some][:, None])
        about += c.aligned[:, m][None, :] * signed / root
    wide = q.norm[some][:, None] * c.rest[None, :] + q.apart[some][:, None] * c.coded[None, :]
    wide += _ROUNDING * (q.norm[some][:, None] + 1) * (c.coded[None, :] + 1)
    return about - wide, about + wide


def scored(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Whole-number products of pairs of rows."""
    if not len(row):
        return np.empty(0, np.int64)
    if 16 * len(row) > len(q) * len(c) and float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**53:
        # Nothing is rounded in doubles of that size.
        return (q.astype(np.float64) @ c.astype(np.float64).T)[row, col].astype(np.int64)
    out = [np.einsum("ij,ij->i", q[row[i : i + 65536]], c[col[i : i + 65536]]) for i in range(0, len(row), 65536)]
    return np.concatenate(out)


def _tiles(batch: pa.RecordBatch, q: Anchors, length: int, options: Options):
    """Tiles of a batch with their intervals: anchors, rows, bounds."""
    for a in range(0, batch.num_rows, _ROWS):
        c = Rows(batch.slice(a, _ROWS), length, options)
        for i in range(0, len(q.id), _ANCHORS):
            some = slice(i, min(i + _ANCHORS, len(q.id)))
            low, high = intervals(q, some, c, length)
            yield some, c, low, high


class _Positives:
    """The best rows of an anchor's own label."""

    def __init__(self, q: Anchors, options: Options):
        self.q, self.best = q, Best(len(q.id), options.positives, np.int64)

    def meet(self, some: slice, c: Rows, low: np.ndarray, high: np.ndarray) -> None:
        q = self.q
        row, col = np.nonzero((high >= self.best.floor[some][:, None]) & (q.id[some][:, None] != c.id[None, :]))
        self.best.add(row + some.start, c.id[col], scored(q.x[some], c.x, row, col))

    def found(self) -> pa.RecordBatch:
        best = self.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.q.id[best.row], best.id, best.score)], ["anchor", "positive", "score"])


class _Negatives:
    """The best rows of other labels in the band of each of an anchor's positives."""

    def __init__(self, q: Anchors, options: Options):
        self.q, self.percent, self.most = q, options.low, options.positives
        self.positive, self.score = np.full((len(q.id), self.most), -1), np.full((len(q.id), self.most), -1)
        for i, wanted in enumerate(q.wanted):
            for j, x in enumerate(wanted):
                self.positive[i, j], self.score[i, j] = x["positive"], x["score"]
        # A place without a positive has an empty band, as has a negative score.
        self.best = Best(len(q.id) * self.most, options.negatives, np.int64)

    def meet(self, some: slice, c: Rows, low: np.ndarray, high: np.ndarray) -> None:
        q, top = self.q, self.score[some]
        floor = np.maximum(self.best.floor.reshape(-1, self.most)[some], top * (self.percent / 100) * (1 - 1e-9))
        reach = np.zeros(low.shape, bool)
        for j in range(self.most):
            reach |= (top[:, j] >= 0)[:, None] & (high >= floor[:, j][:, None]) & (low <= top[:, j][:, None])
        row, col = np.nonzero(reach & (q.label[some][:, None] != c.label[None, :]))
        score = scored(q.x[some], c.x, row, col)
        for j in range(self.most):
            p = top[row, j]
            # percent * p <= 100 * score <= 100 * p without leaving longs.
            least = self.percent * (p // 100) - (-self.percent * (p % 100) // 100)
            fits = (p >= 0) & (least <= score) & (score <= p)
            self.best.add((row[fits] + some.start) * self.most + j, c.id[col[fits]], score[fits])

    def found(self) -> pa.RecordBatch:
        best = self.best
        i, j = best.row // self.most, best.row % self.most
        columns = [self.q.id[i], self.positive[i, j], best.id, self.score[i, j], best.score]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "positive", "negative", "score", "negative_score"])


def _met(keys: list[str], search: type, options: Options):
    """One search per field of the grid, over the rows that stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, at = None, [], None
        for where, side, batch in fields(batches, keys):
            if where != at:
                if now is not None:
                    yield now.found()
                now, asking, at = None, [], where
            if side == 0:
                asking.append(batch)
                continue
            if now is None:
                now = search(Anchors(asking, where[0], options), options)
            for tile in _tiles(batch, now.q, where[0], options):
                now.meet(*tile)
        if now is not None:
            yield now.found()

    return run


WANTED = "array<struct<positive:long,score:long>>"


def mine(vectors: DataFrame, anchors: Column, options: Options = Options()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id``; ``vectors`` has ``vec_id, embedding, label``.
    """
    index = stored(usable(vectors, options).mapInArrow(_indexed(options), INDEX), "index")
    asks = index.withColumnRenamed("id", "vec_id").where(anchors).withColumnRenamed("vec_id", "id")
    rows = index.withColumn("wanted", F.lit(None).cast(WANTED))
    asking = asks.withColumn("wanted", F.lit(None).cast(WANTED))
    keys = ["length", "label"]
    met = dealt(rows, asking, keys, options.grid).mapInArrow(_met(keys, _Positives, options), "anchor long, positive long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    met = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= options.positives)
    positives = met.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive", "score"))).alias("wanted"))
    positives = positives.select("id", F.transform("wanted", lambda x: F.struct(x["positive"].alias("positive"), x["score"].alias("score"))).alias("wanted"))
    positives = stored(positives, "positives")
    asking = stored(asks.join(positives, "id").select(*rows.columns), "anchors")
    keys = ["length"]
    schema = "anchor long, positive long, negative long, score long, negative_score long"
    met = stored(dealt(rows, asking, keys, options.grid).mapInArrow(_met(keys, _Negatives, options), schema), "negatives")
    drop(index, positives, asking)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative")
    met = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.negatives)
    return met.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("negative").alias("negative_id"),
        F.col("score").alias("positive_score"),
        "negative_score",
    )
