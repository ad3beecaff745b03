"""Removal of long repeated word sequences by recompression.

Each document is rewritten in rounds. The first round names runs of one word; each further round
splits all symbols into left and right ones by a hash of their names and names every pair of a left
and a right one. A name is a hash of what it stands for, so equal names are given everywhere at
once, and equal sequences get equal symbols except near their ends. Where a symbol can depend on
what lies outside, it is left out: at the ends of a run, a right symbol at the beginning, a left
symbol at the end. What remains of a window is a function of its words alone.

1. The window's anchor is the least of its remaining symbols by hash, together with the words beside it
   on the side where the window has more room: half of the words that the symbol leaves to a window,
   so that phrases of few words do not bring documents together. Windows in a row that share an
   anchor are one stretch; a stretch is known by its anchor and 128 bits of all its words.
2. Anchors that occur once in all documents settle their windows: they are unique.
3. Stretches that occur twice settle theirs: they are repeated. Copied documents end here.
4. Only what is left, stretches alike in their anchor and different further out, that is the ends
   of repeats, are compared window by window, in 128 bits. Of equal stretches one speaks for all.
5. Words in repeated windows are removed.

Groups are only counted, so a sequence that a third of the documents share is one row per task.

Defined results
* null text: no words, as empty text. Both give the digest of the empty text.
* fewer words than a window: nothing is removed.
* a window that leaves no symbol, such as one word again and again: it is its own anchor.
* repeated rows: each repeats the other, also where the ``doc_id`` is null or shared.
* an empty table gives an empty table; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.scratch import drop, release
from marquee.llm.words import Words, mix, slices
from marquee.session import stored


@dataclass(frozen=True)
class Options:
    """``window``: words of a sequence. ``rounds``: pair rounds; a symbol is up to 2**rounds words
    long, without runs, and a window should be twice as long. ``passes``: shares of the windows that
    are compared one after the other, each with that share of the room."""

    window: int = 35
    rounds: int = 4
    passes: int = 2


_BASE = 0xD1342543DE82EF95
# The key of the second half of 128-bit hashes.
_SECOND = 0x2545F4914F6CDD1D


class Runs:
    """128-bit hashes of runs of words, from hashes of runs of 1, 2, 4, ... words.

    A run of any length is covered by two of the largest such runs in it. Every step goes through
    ``mix``, so no arithmetic of the words themselves makes hashes meet.
    """

    def __init__(self, words: Words):
        self.levels = [(words.hashes, words.hashed(_SECOND))]

    def _level(self, k: int) -> tuple[np.ndarray, ...]:
        while len(self.levels) <= k:
            half = 1 << len(self.levels) - 1
            self.levels.append(tuple(mix(x[:-half] * np.uint64(_BASE) + x[half:] + np.uint64(i)) for i, x in enumerate(self.levels[-1])))
        return self.levels[k]

    def hashed(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the hashes of the words from ``low`` up to ``high``, which are no empty runs."""
        size = high - low
        out = np.empty(len(low), np.uint64), np.empty(len(low), np.uint64)
        # The exponent of the largest power of two in each length.
        power = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(power).tolist():
            here = np.flatnonzero(power == k)
            a, b, n = low[here], high[here] - (1 << k), size[here].astype(np.uint64)
            for half, x in zip(out, self._level(k), strict=True):
                half[here] = mix(mix(x[a] + n) * np.uint64(_BASE) + x[b])
        return out


class Stretches:
    """Windows of the rows of a slice, in stretches that share an anchor.

    Stretch k is of row ``row[k]``; its windows begin at words ``low[k]`` to ``high[k]`` of the
    slice. ``symbol[k]`` names its anchor and the words on one side of it, ``name[k]`` and
    ``more[k]`` all its words in 128 bits.
    """

    def __init__(self, words: Words, options: Options):
        self.words, self.window = words, options.window
        w = self.window
        counts = words.counts()
        # The first word of every window, in order.
        per_row = np.maximum(counts - w + 1, 0)
        of = np.repeat(np.arange(len(counts)), per_row)
        at = np.arange(len(of)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + words.first[:-1][of]
        empty = np.empty(0, np.int64)
        if not len(at):
            self.row, self.low, self.high = empty, empty, empty
            self.symbol = self.name = self.more = np.empty(0, np.uint64)
            return
        runs = Runs(words)
        anchor, edges = self._anchors(at, options)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]) | (anchor[1:] < 0)))
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:], [len(at)])) - 1
        low, high, anchor = at[begin], at[end], anchor[begin]
        # The anchor's words are a to b. Windows up to ``turn`` have no less room on its left, the
        # others on its right, and all of either kind hold ``room`` words on that side.
        lone = anchor < 0
        a, b = edges[np.where(lone, 0, anchor)], edges[np.where(lone, 0, anchor) + 1]
        turn = np.where(lone, high, (a + b - w) >> 1)
        room = (w - (b - a) + 1) >> 1
        sides = [np.stack(x, 1).ravel() for x in ((low, np.maximum(low, turn + 1)), (np.minimum(high, turn), high), (a - room, a), (b, b + room))]
        some = np.flatnonzero(sides[0] <= sides[1])
        self.low, self.high, a, b = (x[some] for x in sides)
        self.row = of[begin][some >> 1]
        self.name, self.more = runs.hashed(self.low, self.high + w)
        lone = lone[some >> 1]
        near, _ = runs.hashed(np.where(lone, self.low, a), np.where(lone, self.low + w, b))
        self.symbol = np.where(lone, self.name, mix(near + (some & 1).astype(np.uint64)))

    def _anchors(self, at: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray]:
        """The place of each window's anchor among the last round's symbols, or -1, and the words at
        which these symbols begin, with the end of the last."""
        h, first = self.words.hashes, self.words.first
        heads = np.zeros(len(h) + 1, bool)
        heads[first] = True
        heads = heads[: len(h)]
        # Runs of one word.
        begins = heads.copy()
        begins[1:] |= h[1:] != h[:-1]
        begins[0] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.concatenate((start, [len(h)]))).astype(np.uint64)
        symbol = np.where(length > 1, mix(h[start] + length * np.uint64(_BASE)), h[start])
        head = heads[start]
        run = np.cumsum(begins) - 1
        low, high = run[at] + 1, run[at + options.window - 1] - 1
        # Few windows differ in what remains of them; the rest is worked out once each.
        change = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        which = np.cumsum(change) - 1
        low, high = low[change], high[change]
        for turn in range(options.rounds):
            right = mix(symbol ^ np.uint64((turn + 1) * _BASE & (1 << 64) - 1)) >> np.uint64(63) == 1
            pair = np.zeros(len(symbol), bool)
            pair[:-1] = ~right[:-1] & right[1:] & ~head[1:]
            second = np.concatenate(([False], pair[:-1]))
            named = symbol.copy()
            i = np.flatnonzero(pair)
            named[i] = mix(symbol[i] * np.uint64(0x9FB21C651E98DF25) + mix(symbol[i + 1] + np.uint64(turn + 1)))
            some = low <= high
            a, b = np.where(some, low, 0), np.where(some, high, 0)
            low, high = low + (some & right[a]), high - (some & ~right[b])
            place = np.cumsum(~second) - 1
            some = low <= high
            low = np.where(some, place[np.where(some, low, 0)], 1)
            high = np.where(some, place[np.where(some, high, 0)], 0)
            symbol, head, start = named[~second], head[~second], start[~second]
        # The least hash of each range, the first of equal ones, from ranges of 1, 2, 4, ... symbols.
        rank = mix(symbol ^ np.uint64(_BASE))
        size = np.maximum(high - low + 1, 0)
        out = np.full(len(low), -1, np.int64)
        least, span = np.arange(len(symbol)), 1
        while True:
            here = np.flatnonzero((size >= span) & (size < 2 * span))
            if len(here):
                x, y = least[low[here]], least[high[here] - span + 1]
                out[here] = np.where(rank[x] <= rank[y], x, y)
            if not (size >= 2 * span).any():
                break
            x, y = least[: len(least) - span], least[span:]
            least, span = np.where(rank[x] <= rank[y], x, y), 2 * span
        return out[which], np.append(start, len(h))


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _row_bytes(words: Words, row: int) -> bytes:
    return words.data[words.offsets[row] : words.offsets[row + 1]].tobytes()


def _parsed(options: Options):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 20):
                part = batch.slice(a, b - a)
                words = Words(part.column(2))
                found = Stretches(words, options)
                ends = np.searchsorted(found.row, np.arange(b - a + 1)).astype(np.int32)
                spans = (found.low - words.first[:-1][found.row]) * options.window + found.high - found.low
                digests = [_digest(_row_bytes(words, i).split()) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(words.counts(), pa.int64()),
                        pa.array(digests),
                        pa.ListArray.from_arrays(ends, pa.array(spans, pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(found.symbol.view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(found.name.view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(found.more.view(np.int64))),
                    ],
                    ["key", "doc_id", "n_words", "digest", "spans", "symbols", "names", "mores"],
                )

    return parse


def _marked(marks: pa.Array, words: Words, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each marked stretch the row, the words at which its first and last window begin, and its marks.

    A span is the first word in its row times the words of a window, and the number of further windows.
    """
    flat = marks.flatten()
    row = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
    low, further = np.divmod(flat.field(0).to_numpy(), options.window)
    low += words.first[:-1][row]
    return row, low, low + further, *(flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))


def _windows(options: Options, share: int, asked_only: bool):
    """One share of the 128-bit hashes of the windows of marked stretches; ``asked`` where the answer is not known yet.

    With ``asked_only`` these alone, with their row and place.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                words = Words(part.column(1))
                row, low, high, settled, speaks = _marked(part.column(2), words, options)
                if asked_only:
                    speaks = speaks & ~settled
                if not speaks.any():
                    continue
                row, low, high, asked = row[speaks], low[speaks], high[speaks], ~settled[speaks]
                many = high - low + 1
                inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = np.repeat(low, many) + inner
                row, asked = np.repeat(row, many), np.repeat(asked, many)
                halves = Runs(words).hashed(at, at + options.window)
                mine = halves[0] % np.uint64(options.passes) == share
                at, row, asked = at[mine], row[mine], asked[mine]
                hashes = [pa.array(x[mine].view(np.int64)) for x in halves]
                if not asked_only:
                    yield pa.RecordBatch.from_arrays([*hashes, pa.array(asked)], ["hash", "more", "asked"])
                    continue
                keys = part.column(0).take(pa.array(row))
                place = at - words.first[:-1][row]
                yield pa.RecordBatch.from_arrays([*hashes, keys, pa.array(place.astype(np.int32))], ["hash", "more", "key", "place"])

    return emit


def _removed(options: Options):
    """Words left after the removal of settled stretches and of the windows found repeated."""
    w = options.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                words = Words(part.column(1))
                edge = np.zeros(words.first[-1] + 1, np.int64)
                _, low, high, settled, _ = _marked(part.column(2), words, options)
                np.add.at(edge, low[settled], 1)
                np.add.at(edge, high[settled] + w, -1)
                places = part.column(3)
                row = np.repeat(np.arange(b - a), np.diff(places.offsets.to_numpy()))
                at = words.first[:-1][row] + places.flatten().to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + w, -1)
                left = np.cumsum(edge)[:-1] == 0
                gone, digests, texts = [], [], []
                for i in range(b - a):
                    own = left[words.first[i] : words.first[i + 1]]
                    kept = list(compress(_row_bytes(words, i).split(), own.tolist()))
                    gone.append(int((~own).sum()))
                    digests.append(_digest(kept))
                    texts.append(b" ".join(kept))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(gone, pa.int64()), pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["key", "n_removed", "kept_sha256", "kept"],
                )

    return cut


MARKS = "array<struct<span:long,settled:boolean,speaks:boolean>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a 128-bit key of their id and text; null and empty texts are alike."""
    content = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.select(F.unhex(F.md5(content)).alias("key"), "doc_id", "text")


def removals(docs: DataFrame, options: Options = Options(), texts_too: bool = True) -> tuple[DataFrame, DataFrame]:
    """All rows with their counts, and the changed texts.

    The first frame has ``key, doc_id, n_words, digest, whole``: ``whole`` where every word is
    removed. The second has ``key, n_removed, kept_sha256`` and, if asked for, the text ``kept`` for
    rows that may lose a part.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    schema = "key binary, doc_id long, n_words long, digest string, spans array<long>, symbols array<long>, names array<long>, mores array<long>"
    parsed = stored(keyed.mapInArrow(_parsed(options), schema), "parsed")
    found = parsed.select("key", F.explode(F.arrays_zip("spans", "symbols", "names", "mores")).alias("x"))
    found = found.select("key", F.col("x.spans").alias("span"), F.col("x.symbols").alias("symbol"), F.col("x.names").alias("name"), F.col("x.mores").alias("more"))
    twice = found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol")
    twice = stored(twice, "symbols")
    release(spark)
    shared = stored(found.join(twice, "symbol", "left_semi"), "shared")
    release(spark)
    alike = shared.groupBy("symbol", "name", "more").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("speaker"))
    alike = alike_stored = stored(alike, "stretches")
    # Anchors with a stretch that is alone and another one that it may overlap.
    unsure = alike.groupBy("symbol").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 and kinds > 1")
    alike = alike.join(unsure.select("symbol", F.lit(True).alias("unsure")), "symbol", "left")
    marks = shared.join(alike, ["symbol", "name", "more"]).select(
        "key",
        "span",
        (F.col("n") > 1).alias("settled"),
        (F.coalesce("unsure", F.lit(False)) & (F.col("key") == F.col("speaker"))).alias("speaks"),
    )
    marks = marks.where("settled or speaks").distinct()
    marks = marks.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("span", "settled", "speaks"))).cast(MARKS).alias("marks"),
        F.count_if("settled").alias("settled"),
        F.max("speaks").alias("speaks"),
    )
    marks = stored(marks, "marks")
    rows = parsed.select("key", "doc_id", "n_words", "digest", F.size("symbols").alias("stretches"))
    rows = rows.join(marks.select("key", "settled"), "key", "left")
    whole = (F.col("stretches") > 0) & (F.coalesce("settled", F.lit(0)) >= F.col("stretches"))
    rows = rows.select("key", "doc_id", "n_words", "digest", whole.alias("whole"))
    rows = stored(rows, "rows")
    drop(parsed, shared, twice, alike_stored)
    release(spark)
    # Texts are needed where part of one is removed or where one speaks for others.
    part = marks.join(rows.where("whole").select("key").distinct(), "key", "left_anti").select("key", "marks", F.lit(True).alias("part"))
    speak = marks.where("speaks").join(rows.where("whole").select("key").distinct(), "key", "left_semi").select("key", "marks", F.lit(False).alias("part"))
    # A repeated row is settled as a whole, so that its windows may well be counted twice.
    texts = keyed.select("key", "text").join(part.union(speak), "key")
    texts = stored(texts, "texts")
    release(spark)
    drop(marks)
    source = texts.where(F.exists("marks", lambda x: x["speaks"])).select("key", "text", "marks")
    repeated = []
    for share in range(options.passes):
        windows = source.mapInArrow(_windows(options, share, False), "hash long, more long, asked boolean")
        again = windows.groupBy("hash", "more").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("asked")).where("n > 1 and asked")
        again = stored(again.select("hash", "more"), "repeated")
        release(spark)
        # The windows are made a second time; that takes less room than to keep them.
        unsettled = source.where(F.exists("marks", lambda x: x["speaks"] & ~x["settled"]))
        asked = unsettled.mapInArrow(_windows(options, share, True), "hash long, more long, key binary, place int")
        asked = asked.join(again, ["hash", "more"], "left_semi").select("key", "place")
        repeated.append(stored(asked, "places"))
        drop(again)
        release(spark)
    places = reduce(DataFrame.union, repeated).groupBy("key").agg(F.collect_list("place").alias("places"))
    left = texts.where("part").join(places, "key", "left")
    left = left.select("key", "text", "marks", F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    left = left.mapInArrow(_removed(options), "key binary, n_removed long, kept_sha256 string, kept string")
    left = stored(left if texts_too else left.drop("kept"), "kept")
    drop(texts, *repeated)
    release(spark)
    return rows, left


EMPTY = hashlib.sha256(b"").hexdigest()


def report(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    rows, left = removals(docs, options, False)
    out = rows.join(left, "key", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )


def shortened(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``doc_id, text``: texts with something removed are their kept words joined by one space,
    the others are as they were."""
    rows, left = removals(docs, options)
    keyed = _keyed(docs)
    gone = rows.where("whole").select("key", F.lit(True).alias("whole")).distinct()
    out = keyed.join(gone, "key", "left").join(left.select("key", "kept", "n_removed"), "key", "left")
    kept = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.select("doc_id", F.when(F.col("whole"), F.lit("")).otherwise(kept).alias("text"))
