"""Language identification with averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 2 to 4 bytes of a text in which ASCII letters are lower-cased and all
other ASCII bytes are one space; a run may begin or end with a space and has none inside. Each is
hashed to a bucket with an embedding; the mean of a text's embeddings goes through a linear
softmax. Training is stochastic gradient descent in numpy on a bounded sample; the fitted model is
folded into one row of class scores per bucket, whatever the size of the corpus.

Defined results
* null text, or a text without a letter: language ``und``, score 0, rejected.
* no learnable row at all: every text is ``und``, score 0, rejected.
* one learnable language: that language with score 1.
* equal scores: the language that sorts first.
* repeated rows are judged one by one; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.words import slices, text_bytes
from marquee.session import stored

UNKNOWN = "und"
RESULT = "struct<lang:string,score:double,rejected:boolean>"

# Bytes looked at together; longer texts are summed over several pieces.
_PIECE = 1 << 20
_SIZES = (2, 3, 4)


@dataclass(frozen=True)
class Options:
    """Bounds and settings of the training.

    Every value of ``lang`` is learned. ``per_language`` text pieces of each are expected in the sample,
    and never more than twice as many for all of them together. ``lengths`` are the words of a piece; short
    ones are there so that scores of short texts are learned as well. The rejection bound is the
    lowest score at which at most ``errors`` of the accepted held-back pieces are wrong, but never
    so high that more than ``lost`` of the held-back pieces are rejected. Where no more than
    ``errors`` are wrong without a bound, or no bound is enough, ``lost`` alone sets it. It is never
    above ``1 - errors``.
    """

    buckets: int = 1 << 14
    size: int = 16
    per_language: int = 1200
    lengths: tuple[int, ...] = (3, 8, 24, 64)
    epochs: int = 6
    batch: int = 32
    rate: float = 2.0
    errors: float = 0.02
    lost: float = 0.002
    seed: int = 11


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages: embedding times output weights
    bias: np.ndarray
    temperature: float
    bound: float  # a calibrated score below it is rejected


_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of some folded bytes, and the position where each begins."""
    blank = data == 32
    wide = data.astype(np.uint32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    key, inner = wide, np.zeros(len(data), bool)
    found, places = [], []
    for n in range(2, max(_SIZES) + 1):
        if len(data) < n:
            break
        m = len(data) - n + 1
        key = (key[:m] << np.uint32(8)) | wide[n - 1 :]
        inner = inner[:m] | blank[n - 2 : n - 2 + m] if n > 2 else np.zeros(m, bool)
        at = np.flatnonzero(~inner & ~(blank[:m] & blank[n - 1 :])) if n == 2 else np.flatnonzero(~inner)
        hashed = (key[at] + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        found.append((hashed * np.uint32(0x85EBCA77)) >> shift)
        places.append(at)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(places)


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate(([32], _FOLD[data], [32])).astype(np.uint8)


def raw_scores(column: pa.Array, model: Model) -> np.ndarray:
    """Mean score of every row and language before the bias; long texts in pieces."""
    out = np.zeros((len(column), len(model.languages)))
    buckets = len(model.scores)
    for start, stop in slices(column, _PIECE // 4):
        data, offsets = text_bytes(column.slice(start, stop - start))
        total, count = np.zeros((stop - start, out.shape[1])), np.zeros(stop - start)
        if stop - start == 1 and len(data) > 2 * _PIECE:
            padded = _padded(data)
            for a in range(0, len(padded) - 1, _PIECE):
                # The last three bytes are read ahead, so that no subword is missed or met twice.
                found, at = subwords(padded[a : a + _PIECE + max(_SIZES) - 1], buckets)
                found = found[at < _PIECE]
                total[0] += model.scores[found].sum(0, dtype=np.float64)
                count[0] += len(found)
        else:
            # One blank in front of each row and one at the end part the rows.
            rows = np.arange(len(data)) + np.repeat(np.arange(stop - start), np.diff(offsets)) + 1
            spread = np.full(len(data) + stop - start + 1, 32, np.uint8)
            spread[rows] = _FOLD[data]
            found, at = subwords(spread, buckets)
            # A subword that begins at the blank in front of a row is of that row.
            row = np.searchsorted(offsets[:-1] + np.arange(stop - start), at, "right") - 1
            count += np.bincount(row, minlength=stop - start)
            for k in range(out.shape[1]):
                total[:, k] += np.bincount(row, model.scores[found, k], minlength=stop - start)
        out[start:stop] = total / np.maximum(count, 1)[:, None]
    return out


def probabilities(raw: np.ndarray, model: Model) -> np.ndarray:
    z = (raw + model.bias) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def language_of(text: Column, model: Model) -> Column:
    """A struct ``lang, score, rejected`` for a text column."""

    @F.arrow_udf(RESULT)
    def judged(column: pa.Array) -> pa.Array:
        p = probabilities(raw_scores(column, model), model)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        names = pa.array(model.languages, pa.string()).take(pa.array(best))
        parts = [names, pa.array(score, pa.float64()), pa.array(score < model.bound)]
        return pa.StructArray.from_arrays(parts, ["lang", "score", "rejected"])

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if not model.languages:
        return unknown
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), judged(text)).otherwise(unknown)


def sample(rows: DataFrame, options: Options = Options()) -> tuple[list[str], list[int], list[str]]:
    """Pieces of labelled texts: the languages, and a language number and a text per piece.

    ``rows`` has ``key, text, lang``. Which rows and which words are taken follows from a hash of
    the key and the text alone. A row gives one piece of a drawn length at a drawn place.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    share = F.least(F.lit(1.0), F.lit(options.per_language) / F.count(F.lit(1)))
    shares = stored(rows.groupBy("lang").agg(share.alias("share")), "languages")
    languages = sorted(r["lang"] for r in shares.select("lang").collect())
    if not languages:
        return [], [], []
    draw = F.xxhash64(F.lit(options.seed), "key", "text")
    rows = rows.withColumn("draw", draw).join(shares, "lang").where(F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    words = F.split("text", r"[\x20\x09-\x0D]+")
    lengths = F.array(*[F.lit(n) for n in options.lengths])
    taken = rows.select(
        "lang",
        "draw",
        words.alias("words"),
        F.element_at(lengths, (F.pmod(F.shiftright("draw", 20), F.lit(len(options.lengths))) + 1).cast("int")).alias("n"),
    ).select(
        "lang",
        "draw",
        F.concat_ws(
            " ",
            F.slice(
                "words",
                (F.pmod(F.shiftright("draw", 28), F.greatest(F.size("words") - F.col("n") + 1, F.lit(1))) + 1).cast("int"),
                F.col("n"),
            ),
        ).alias("piece"),
    )
    most = 2 * options.per_language * len(languages)
    found = taken.orderBy("draw", "lang", "piece").limit(most).collect()
    number = {name: k for k, name in enumerate(languages)}
    return languages, [number[r["lang"]] for r in found], [r["piece"] for r in found]


def fit(languages: list[str], labels: list[int], pieces: list[str], options: Options = Options()) -> Model:
    """Train on the pieces; every fifth is held back for temperature and rejection bound."""
    k = len(languages)
    if k < 2:
        return Model(languages, np.zeros((options.buckets, k), np.float32), np.zeros(k), 1.0, 0.0)
    grams = [subwords(_padded(np.frombuffer(x.encode(), np.uint8)), options.buckets)[0] for x in pieces]
    label = np.array(labels)
    held = np.arange(len(pieces)) % 5 == 4
    random = np.random.default_rng(options.seed)
    embed = random.normal(0, 0.1, (options.buckets, options.size)).astype(np.float32)
    weight = random.normal(0, 0.1, (options.size, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    # Rare languages count as much as frequent ones.
    per = np.bincount(label[~held], minlength=k)
    weigh = (per.sum() / np.maximum(per, 1) / max((per > 0).sum(), 1)).astype(np.float32)
    train = np.flatnonzero(~held)
    steps = max(1, options.epochs * -(-len(train) // options.batch))
    step = 0
    for _ in range(options.epochs):
        random.shuffle(train)
        for a in range(0, len(train), options.batch):
            rows = [r for r in train[a : a + options.batch] if len(grams[r])]
            step += 1
            if not rows:
                continue
            flat = np.concatenate([grams[r] for r in rows])
            used, flat = np.unique(flat, return_inverse=True)
            of = np.repeat(np.arange(len(rows)), [len(grams[r]) for r in rows])
            x = np.bincount(of * len(used) + flat, minlength=len(rows) * len(used)).reshape(len(rows), -1)
            x = (x / x.sum(1, keepdims=True)).astype(np.float32)
            hidden = x @ embed[used]
            z = hidden @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = label[rows]
            p[np.arange(len(rows)), y] -= 1
            p *= weigh[y][:, None] / len(rows)
            rate = np.float32(options.rate * (1 - (step - 1) / steps))
            back = p @ weight.T
            weight -= rate * (hidden.T @ p)
            bias -= rate * p.sum(0)
            # Few of a batch's buckets are used, and each gets a small share of the mean.
            embed[used] -= rate * 25 * (x.T @ back)
    folded = (embed @ weight).astype(np.float32)
    model = Model(languages, folded, bias.astype(np.float64), 1.0, 0.0)
    rows = [r for r in np.flatnonzero(held) if len(grams[r])]
    if not rows:
        return model
    raw = np.array([folded[grams[r]].mean(0, dtype=np.float64) for r in rows])
    y = label[rows]

    def loss(t: float) -> float:
        p = probabilities(raw, Model(languages, folded, model.bias, t, 0.0))
        return float(-(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)) * weigh[y]).mean())

    best = min(np.geomspace(0.05, 5.0, 60), key=loss)
    p = probabilities(raw, Model(languages, folded, model.bias, best, 0.0))
    score, wrong = p.max(1), p.argmax(1) != y
    order = np.argsort(score)
    # Wrong among the pieces from each score upwards.
    share = wrong[order][::-1].cumsum()[::-1] / np.arange(len(order), 0, -1)
    fit_at = np.flatnonzero(share <= options.errors)
    least = score[order[fit_at[0]]] if len(fit_at) and fit_at[0] else np.inf
    # A score from 1 - errors on is right often enough, however sure the model is of all pieces.
    bound = min(float(least), float(np.quantile(score, options.lost, method="lower")), 1 - options.errors)
    return Model(languages, folded, model.bias, float(best), bound)


def train(rows: DataFrame, options: Options = Options()) -> Model:
    """Sample and fit; ``rows`` has ``key, text, lang``."""
    return fit(*sample(rows, options), options)


def held_out(key: Column) -> Column:
    """The fold that is never learned from: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """``key, text, lang`` of the labelled documents outside the held-out fold."""
    rows = docs.select(F.col("doc_id").alias("key"), "text", "lang")
    return rows.where(~held_out(F.col("key")) & F.col("lang").isNotNull())


def predict(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Language of every document: ``doc_id, held_out, lang_pred, score, rejected``."""
    model = train(learnable(docs), options)
    judged = docs.select("doc_id", language_of(F.col("text"), model).alias("found"))
    return judged.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.rejected").alias("rejected"),
    )


def keep(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """The documents whose language is accepted, with all their columns."""
    model = train(learnable(docs), options)
    return docs.where(~language_of(F.col("text"), model).getField("rejected"))
