"""A quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's tokens are runs of letters and digits, with ASCII letters lower-cased, and runs of other
characters. Two views of them are hashed: the tokens themselves in runs of one and two, and their
shapes (case, digits, length, whether the word before is the same) in runs of one to three. A
feature's value is its share of the runs of its view, so long and short texts compare.

The model is fitted in numpy on a bounded sample of labelled rows: each example moves the
coordinates that it has by the FTRL-proximal rule, whose learning rates are per coordinate and
whose weights stay at zero until the evidence exceeds ``lasso``. It is one weight per bucket,
whatever the size of the corpus. A score is a sparse dot product, made in the tasks that read the
texts; long texts are summed over pieces of a few megabytes.

Defined results
* null text counts as empty. A text without a token scores what the model says without features.
* a label other than 0 and 1 is none. Several labels of one document count with their mean; rows
  with a ``doc_id`` that has a label are examples each. Null ids are neither learned nor held out.
* no learnable row: every score is 0.5. Labels of one kind: scores near that kind.
* repeated rows are scored one by one; an empty table gives an empty table; other columns are never
  looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.words import PLAIN, SPACE, hashed, lowered, mix, slices, text_bytes


@dataclass(frozen=True)
class Options:
    """``sample``: labelled rows at most that the model is fitted on, drawn by a hash, and
    ``tokens`` of each at most, from a drawn place on. ``least``: the score from which a document
    is predicted to be good."""

    buckets: int = 1 << 18
    sample: int = 4096
    tokens: int = 1024
    epochs: int = 4
    rate: float = 1.0
    smooth: float = 0.1
    lasso: float = 0.002
    ridge: float = 0.0
    scale: float = 10.0
    least: float = 0.3
    seed: int = 5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


# Runs of tokens and of shapes that are features.
_WORD_RUNS, _SHAPE_RUNS = 2, 3
_ODD = np.uint64(0xA0761D6478BD642F)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _counted(marks: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(marks)))
    return sums[stops] - sums[starts]


class Grams:
    """Feature buckets of some rows: ``buckets[k]`` is of row ``row[k]`` and view ``view[k]``.

    ``first[i]:first[i + 1]`` are the tokens of row i.
    """

    def __init__(self, column: pa.Array, buckets: int):
        data, offsets = text_bytes(column)
        kind = np.where(SPACE[data], 0, np.where(PLAIN[data], 1, 2)).astype(np.int8)
        heads = np.zeros(len(data) + 1, bool)
        heads[offsets] = True
        heads = heads[: len(data)]
        begins = heads.copy()
        begins[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(begins)
        ends = np.concatenate((at[1:], [len(data)])).astype(np.int64)
        solid = kind[at] > 0 if len(at) else np.zeros(0, bool)
        self.starts, self.stops = at[solid], ends[solid]
        self.first = np.searchsorted(self.starts, offsets)
        self.bits = int(buckets).bit_length() - 1
        token = hashed(lowered(data), self.starts, self.stops)
        self.words, self.shapes = token, self._shape(data, token, kind)

    def _shape(self, data: np.ndarray, token: np.ndarray, kind: np.ndarray) -> np.ndarray:
        a, b = self.starts, self.stops
        if not len(a):
            return token
        upper, lower, digits = (_counted(x[data], a, b) for x in (_UPPER, _LOWER, _DIGIT))
        size = b - a
        first = _UPPER[data[a]]
        case = np.select([digits == size, digits > 0, (upper > 1) & (lower == 0), first & (upper == 1), upper > 0], [1, 2, 3, 4, 5], 0)
        long = np.searchsorted([2, 3, 5, 9, 14, 24], size, "right")
        # The word before, whatever stands between.
        words = np.flatnonzero(kind[a] == 1)
        same = np.zeros(len(a), np.int64)
        row = np.searchsorted(self.first, words, "right")
        same[words[1:]] = (token[words[1:]] == token[words[:-1]]) & (row[1:] == row[:-1])
        shape = mix((case + 8 * long + 64 * same + 128).astype(np.uint64))
        return np.where(kind[a] == 1, shape, token)

    def rows(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values of the features of the tokens from ``low`` to ``high``."""
        found, share = [], []
        for view, (values, most) in enumerate(((self.words, _WORD_RUNS), (self.shapes, _SHAPE_RUNS))):
            runs = [x for _, x in self._runs(values[low:high], view, most)]
            many = sum(map(len, runs))
            found += runs
            share += [np.full(len(x), 1 / many) for x in runs]
        return np.concatenate(found), np.concatenate(share)

    def _runs(self, values: np.ndarray, view: int, most: int):
        state = np.full(len(values), view + 1, np.uint64)
        for n in range(1, most + 1):
            if len(values) < n:
                return
            state = mix(state[: len(values) - n + 1] * _ODD + values[n - 1 :])
            yield n, (state >> np.uint64(64 - self.bits)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The dot product of each row's features with the weights."""
        rows = len(self.first) - 1
        of = np.repeat(np.arange(rows), np.diff(self.first))
        left = self.first[1:][of] - np.arange(len(of))
        out = np.zeros(rows)
        for view, (values, most) in enumerate(((self.words, _WORD_RUNS), (self.shapes, _SHAPE_RUNS))):
            total, count = np.zeros(rows), np.zeros(rows)
            for n, found in self._runs(values, view, most):
                # Runs end with their row.
                inside = left[: len(found)] >= n
                row = of[: len(found)][inside]
                total += np.bincount(row, weights[found[inside]], minlength=rows)
                count += np.bincount(row, minlength=rows)
            out += total / np.maximum(count, 1)
        return out


def raw_scores(column: pa.Array, model: Model, scale: float) -> np.ndarray:
    out = np.zeros(len(column))
    for a, b in slices(column):
        out[a:b] = Grams(column.slice(a, b - a), len(model.weights)).scores(model.weights)
    return out * scale + model.bias


def score_of(text: Column, model: Model, options: Options) -> Column:
    """The probability of label 1 for a text column."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-raw_scores(column, model, options.scale))))

    return scored(F.coalesce(text, F.lit("")))


def _examples(options: Options):
    """Features of labelled texts as bytes: buckets and values, the values of equal buckets added."""

    @F.arrow_udf("struct<buckets:binary,values:binary>")
    def examples(column: pa.Array, draw: pa.Array) -> pa.Array:
        drawn = draw.to_numpy(zero_copy_only=False)
        buckets, values = [], []
        for a, b in slices(column):
            grams = Grams(column.slice(a, b - a), options.buckets)
            for i in range(b - a):
                low, high = int(grams.first[i]), int(grams.first[i + 1])
                if high - low > options.tokens:
                    low += int(drawn[a + i]) % (high - low - options.tokens + 1)
                    high = low + options.tokens
                found, share = grams.rows(low, high) if high > low else (np.empty(0, np.int64), np.empty(0))
                found, where = np.unique(found, return_inverse=True)
                buckets.append(found.astype(np.uint32).tobytes())
                values.append(np.bincount(where, share, minlength=len(found)).astype(np.float32).tobytes())
        return pa.StructArray.from_arrays([pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], ["buckets", "values"])

    return examples


def sample(rows: DataFrame, options: Options = Options()) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Buckets, values and target of the drawn examples; ``rows`` has ``key, text, target``."""
    many = rows.count()
    if not many:
        return []
    rows = rows.withColumn("draw", F.xxhash64(F.lit(options.seed), "key", "text"))
    share = min(1.0, 2 * options.sample / many)
    rows = rows.where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20))
    found = rows.select("draw", "target", _examples(options)(F.coalesce("text", F.lit("")), F.pmod("draw", F.lit(1 << 40))).alias("x"))
    found = found.select("draw", "target", "x.buckets", "x.values").orderBy("draw", "target", "buckets").limit(options.sample)
    return [(np.frombuffer(r["buckets"], np.uint32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(np.float64), r["target"]) for r in found.collect()]


def fit(examples: list[tuple[np.ndarray, np.ndarray, float]], options: Options = Options()) -> Model:
    """FTRL-proximal over the examples; the last coordinate is the bias, which no lasso holds back."""
    size = options.buckets + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    random = np.random.default_rng(options.seed)
    ready = [(np.append(at, options.buckets), np.append(x * options.scale, 1.0), y) for at, x, y in examples]
    for _ in range(options.epochs):
        for k in random.permutation(len(ready)):
            at, x, y = ready[k]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35)))
            g = (p - y) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            after = np.sqrt(n[at])
            z[at] += g - (after - root) / options.rate * w[at]
            held = np.full(len(at), options.lasso)
            held[-1] = 0.0
            kept = np.sign(z[at]) * np.maximum(np.abs(z[at]) - held, 0)
            w[at] = -kept / ((options.smooth + after) / options.rate + options.ridge)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def held_out(key: Column) -> Column:
    """The fold whose labels are never learned: crc32 of the key as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, text, target`` of the labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("key")).agg(F.avg("quality").alias("target"))
    return docs.select(F.col("doc_id").alias("key"), "text").join(known, "key")


def train(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    return fit(sample(learnable(docs, labels), options), options)


def judge(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, options)
    scored = docs.select("doc_id", score_of(F.col("text"), model, options).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= options.least, 1).otherwise(0).alias("predicted"))
