"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the TF-IDF weights.
2. A randomised SVD of TF-IDF passages gives the latent space: the product of the passages' Gram
   matrix with a random matrix is summed over tasks, orthonormalised, and rotated to the singular
   vectors. The passages are all benchmark items and all passages of all documents, each of these
   once, however often it is repeated. Every window of every document is searched.
3. Each benchmark item of ``short_words`` words or more belongs to a window length somewhat above its own. All windows of that
   length, half a window apart, are compared with the item by cosine in the latent space.
4. Runs of three words that an item has lead to it as well, whatever the cosine. Where at most a
   quarter of an item's words, of nine or more, is replaced or left out, three in a row remain: such
   copies are never missed, and the cosine is left with paraphrases and copies with insertions.
5. Around a window that is near enough, or a place that such a run points to, words that the item has are counted, and where there are
   enough of them, the longest common subsequence with the item is computed. Most of the item's
   words in order is a copy. Fewer are a paraphrase, which counts if the item's answer, its last
   sentence or else its last third, is there as well.

Words are runs of letters and digits, ASCII lower-cased; punctuation plays no part.

Defined results
* null or empty text, or text without words: clean.
* null or empty items, and items below ``least_words`` words: never found.
* items below ``short_words`` words are found only as a run of all their words, compared at every
  word of every document; the latent space has no part in it.
* an empty benchmark, or none but such items: nothing is found.
* repeated items and repeated documents are found each; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.scratch import drop, release
from marquee.llm.words import PLAIN, Words, shingled, slices
from marquee.session import stored

FOUND = "array<struct<item_id:long,kind:string,common:double,cosine:double,first_word:long,words:long>>"
_BLOCK = 8  # words summed before windows are put together
_BATCH = 1 << 16  # words projected at a time
_PIECE = 32  # items whose bytes are fetched at once; NumPy takes rows of 32 bytes fast
_RUN = 3  # words of the runs that lead to an item
_ROWS = 32  # passages that are one matrix; with more of them a word's share of its cells grows
_TASKS = 64  # tasks whose sums are added at once


@dataclass(frozen=True)
class Options:
    """``sample``: bound on the documents' passages that shape the latent space, for trials; all of
    them do where it is None. ``items``: bound on the benchmark items that are searched in one pass,
    and sent to the tasks."""

    buckets: int = 1 << 14
    rank: int = 64
    sample: int | None = None
    passage: int = 48
    items: int = 2048
    near: float = 0.30
    copy: float = 0.75
    paraphrase: float = 0.55
    answer: float = 0.6
    least_words: int = 4
    short_words: int = 10
    seed: int = 5


@dataclass(frozen=True)
class Item:
    item_id: int
    hashes: list[int]
    answer: int  # words of the answer, at the end
    window: int  # in blocks


@dataclass(frozen=True)
class Index:
    options: Options
    weights: np.ndarray  # buckets x rank: IDF times singular vectors
    items: list[Item] = field(default_factory=list)
    vectors: np.ndarray | None = None  # items x rank, of length 1
    has: np.ndarray | None = None  # items x buckets: how many of the item's words are in the bucket


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (n - 1).bit_length())).astype(np.int64)


def document_frequencies(docs: DataFrame, options: Options = Options()) -> tuple[int, np.ndarray]:
    """Documents with words, and how many of them have a word of each bucket."""
    size = options.buckets

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20):
                words = Words(batch.column(0).slice(a, b - a), True, PLAIN)
                for c in range(0, b - a, 512):
                    d = min(c + 512, b - a)
                    low, high = words.first[c], words.first[d]
                    row = np.repeat(np.arange(d - c), np.diff(words.first[c : d + 1]))
                    seen = np.zeros((d - c, size), bool)
                    seen[row, _buckets(words.hashes[low:high], size)] = True
                    total += seen.sum(0)
                rows += int((words.counts() > 0).sum())
        at = np.flatnonzero(total)
        ids, counts = np.concatenate(([-1], at)), np.concatenate(([rows], total[at]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(counts, pa.int64())], ["bucket", "n"])

    parts = docs.select("text").mapInArrow(counted, "bucket int, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 1, np.int64)
    out[found["bucket"].to_numpy() + 1] = found["n"].to_numpy()
    return int(out[0]), out[1:]


def _passages(docs: DataFrame, benchmark: DataFrame, options: Options) -> DataFrame:
    """Bucket lists of all items, and of the documents' passages; each of these counts once, however
    often it is repeated."""
    size, length = options.buckets, options.passage
    short = size <= 1 << 15
    kind, layout = (np.int16, "buckets array<short>") if short else (np.int32, "buckets array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                words = Words(batch.column(0).slice(a, b - a), True, PLAIN)
                found = _buckets(words.hashes, size).astype(kind)
                # The passages of all rows lie one behind the other; none holds words of two rows.
                count = -(-words.counts() // length)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begin = np.repeat(words.first[:-1], count) + nth * length
                offsets = pa.array(np.concatenate((begin, [len(found)])), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(found))], ["buckets"])

    texts = docs.where("text is not null")
    if options.sample is None:
        taken = texts.select("text").mapInArrow(cut, layout).distinct()
    else:
        # One draw per text decides which documents take part. The limit only ends a long sample.
        share = min(1.0, options.sample / 4 / max(texts.count(), 1))
        draw = F.pmod(F.xxhash64(F.lit(options.seed), "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
        taken = texts.where(draw).select("text").mapInArrow(cut, layout).distinct()
        taken = taken.orderBy(F.xxhash64("buckets"), "buckets").limit(options.sample)
    own = benchmark.where("text is not null").select("text").mapInArrow(cut, layout)
    return stored(taken.union(own), "passages")


def latent_space(passages: DataFrame, idf: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of the TF-IDF passages, ``buckets x rank``, and the squares
    of their singular values."""
    size, rank = options.buckets, options.rank
    parts = 64

    def product(right: np.ndarray, gram: bool) -> np.ndarray:
        """Sum over passages of a (a R), or of (a R)' (a R), where a is a passage's TF-IDF row."""
        height, width = size if gram is False else right.shape[1], right.shape[1]
        step = -(-height // parts)
        # Rows hold counts of words; their weights are in the factors beside them.
        weighted, square = idf[:, None] * right, idf * idf

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            mark, place = np.zeros(size, bool), np.zeros(size, np.int64)
            for batch in batches:
                lists = batch.column(0)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                ends = ends - ends[0]
                for a in range(0, len(lists), _ROWS):
                    own = ends[a : a + _ROWS + 1]
                    bucket = flat[own[0] : own[-1]]
                    mark[bucket] = True
                    used = np.flatnonzero(mark)
                    mark[used] = False
                    place[used] = np.arange(len(used))
                    row = np.repeat(np.arange(len(own) - 1) * len(used), np.diff(own))
                    x = np.bincount(row + place[bucket], minlength=(len(own) - 1) * len(used))
                    x = x.astype(np.float64).reshape(len(own) - 1, -1)
                    length = np.maximum((x * x) @ square[used], 1e-24)
                    y = x @ weighted.take(used, axis=0)
                    scaled = y / length[:, None]
                    if gram:
                        total += y.T @ scaled
                    else:
                        total[used] += x.T @ scaled
            if not gram:
                total *= idf[:, None]
            task = TaskContext.get().partitionId() // _TASKS
            blocks = [total[i * step : (i + 1) * step].tobytes() for i in range(parts)]
            columns = [pa.array(range(parts), pa.int32()), pa.array([task] * parts, pa.int32()), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "task", "block"])

        def added(table: pa.Table) -> pa.Table:
            blocks = table.column("block")
            total = np.zeros(len(blocks[0].as_py()) // 8)
            for block in blocks:
                total += np.frombuffer(block.as_buffer())
            return table.slice(0, 1).set_column(2, "block", pa.array([total.tobytes()], pa.binary()))

        # One block of each task, added for some tasks and then for all, so that no group grows with
        # the passages.
        layout = "part int, task int, block binary"
        summed = passages.mapInArrow(partial, layout).groupBy("part", "task").applyInArrow(added, layout)
        summed = summed.groupBy("part").applyInArrow(added, layout)
        rows = sorted((r["part"], bytes(r["block"])) for r in summed.collect())
        return np.concatenate([np.frombuffer(block).reshape(-1, width) for _, block in rows])

    random = np.random.default_rng(options.seed).normal(size=(size, rank))
    base, _ = np.linalg.qr(product(random, False))
    strength, turn = np.linalg.eigh(product(base, True))
    return base @ turn[:, ::-1], np.maximum(strength[::-1], 0.0)


def _answer(words: Words, text: str) -> int:
    """Words of the last sentence, or of the last third where that is the whole text."""
    total = len(words.hashes)
    body = text.rstrip().rstrip(".!?")
    cut = max(body.rfind(". "), body.rfind("! "), body.rfind("? "), body.rfind("\n"))
    if cut >= 0:
        last = len(Words(pa.array([body[cut + 1 :]]), True, PLAIN).hashes)
        if 3 <= last <= total // 2:
            return last
    return max(1, total // 3)


def _windows_for(length: int) -> int:
    """Blocks of the windows that an item of so many words is compared with: 2, 3, 4, 6, 8, 12, ..."""
    need, size = 1.25 * length / _BLOCK, 2
    while size < need:
        size = size * 3 // 2 if size & (size - 1) == 0 else size // 3 * 4
    return size


def with_items(index: Index, rows: list[tuple[int, str]]) -> Index:
    """The index with a block of benchmark items."""
    options = index.options
    items, vectors, has = [], [], []
    for item_id, text in rows:
        words = Words(pa.array([text], pa.string()), True, PLAIN)
        n = len(words.hashes)
        if item_id is None or n < options.least_words:
            continue
        bucket = _buckets(words.hashes, options.buckets)
        vector = index.weights[bucket].sum(0, dtype=np.float64)
        vectors.append(vector / max(np.linalg.norm(vector), 1e-12))
        has.append(np.minimum(np.bincount(bucket, minlength=options.buckets), 65535).astype(np.uint16))
        items.append(Item(item_id, words.hashes.tolist(), _answer(words, text), _windows_for(n)))
    if not items:
        return index
    return Index(options, index.weights, items, np.array(vectors, np.float32), np.array(has))


def common(word_masks: dict[int, int], length: int, window: list[int]) -> int:
    """Words of the longest common subsequence of an item and a window, bit-parallel."""
    full = (1 << length) - 1
    left = full
    for word in window:
        mask = word_masks.get(word)
        if mask:
            hit = left & mask
            left = ((left + hit) | (left - hit)) & full
    return length - left.bit_count()


def _masks(hashes: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(hashes):
        out[word] = out.get(word, 0) | 1 << i
    return out


class _Runs:
    """Runs of ``length`` words of some items, and where texts have them."""

    def __init__(self, length: int, found: list[tuple[np.ndarray, int]]):
        """``found``: hashes of the runs of an item in their order, and the item."""
        self.length = length
        run = np.concatenate([runs for runs, _ in found])
        item = np.repeat([i for _, i in found], [len(runs) for runs, _ in found])
        offset = np.concatenate([np.arange(len(runs)) for runs, _ in found])
        order = np.argsort(run, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.keys, self.first, self.many = np.unique(run[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of runs, the items that have them, and the word of the item that the run begins at."""
        runs = shingled(hashes, self.length)
        at = np.flatnonzero(self.maybe[runs >> np.uint64(44)])
        key = np.minimum(np.searchsorted(self.keys, runs[at]), len(self.keys) - 1)
        same = self.keys[key] == runs[at]
        at, key = at[same], key[same]
        ends = np.cumsum(self.many[key])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _BATCH, "right")))
            many = self.many[key[a:b]]
            one = np.arange(many.sum()) + np.repeat(self.first[key[a:b]] - np.cumsum(many) + many, many)
            yield np.repeat(at[a:b], many), self.item[one], self.offset[one]
            a = b


class _Search:
    """One task's search; candidates come from the latent space and from runs of the items' words,
    and are checked word by word."""

    def __init__(self, index: Index):
        self.index, self.o = index, index.options
        self.masks = [_masks(x.hashes) for x in index.items]
        self.tails = [_masks(x.hashes[-x.answer :]) for x in index.items]
        self.length = np.array([len(x.hashes) for x in index.items])
        self.has = (index.has > 0).ravel()
        self.weights = np.pad(index.weights, ((0, 1), (0, 0)))  # with an empty bucket
        self.by_window: dict[int, np.ndarray] = {}
        self.has_by_window: dict[int, np.ndarray] = {}  # pieces x buckets and an empty one x items
        long = np.flatnonzero(self.length >= self.o.short_words)
        short = np.flatnonzero(self.length < self.o.short_words)
        for size in sorted({index.items[i].window for i in long}):
            self.by_window[size] = np.array([i for i in long if index.items[i].window == size])
            has = (index.has[self.by_window[size]] > 0).T.astype(np.uint8)
            has = np.pad(has, ((0, 1), (0, -has.shape[1] % _PIECE)))
            self.has_by_window[size] = np.ascontiguousarray(has.reshape(len(has), -1, _PIECE).swapaxes(0, 1))
        self.runs = self.runs_of(long)
        # Short items begin with their runs; the words behind a run are compared one by one.
        self.starts = self.runs_of(short, 1)
        self.short_words = np.zeros((len(index.items) if len(short) else 0, max(self.length[short], default=0)), np.uint64)
        for i in short:
            self.short_words[i, : self.length[i]] = index.items[i].hashes

    def runs_of(self, items: np.ndarray, most: int | None = None) -> list[_Runs]:
        """The runs of some items, or the first ``most`` of each."""
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i in items:
            hashes = np.array(self.index.items[i].hashes, np.uint64)
            length = min(_RUN, len(hashes))
            found.setdefault(length, []).append((shingled(hashes, length)[:most], i))
        return [_Runs(length, rows) for length, rows in found.items()]

    def check(self, item: int, window: list[int]) -> tuple[str, float] | None:
        o, x = self.o, self.index.items[item]
        n = len(x.hashes)
        share = common(self.masks[item], n, window) / n
        if share >= o.copy:
            return "copy", share
        if share >= o.paraphrase and common(self.tails[item], x.answer, window) >= o.answer * x.answer:
            return "paraphrase", share
        return None

    def rows(self, words: Words, low: int, high: int) -> Iterator[tuple[int, int, tuple]]:
        """Findings of rows low to high: row, item, details."""
        o = self.o
        first = words.first[low : high + 1]
        start, stop = first[0], first[-1]
        if start == stop:
            return
        bucket = _buckets(words.hashes[start:stop], o.buckets)
        # Blocks of each row; none holds words of two rows.
        blocks = -(-np.diff(first) // _BLOCK)
        block_at = np.concatenate(([0], np.cumsum(blocks)))
        of = np.repeat(np.arange(len(blocks)), blocks)
        begin = (np.arange(block_at[-1]) - block_at[:-1][of]) * _BLOCK + first[:-1][of] - start
        sums = np.empty((len(begin) + 1, o.rank))
        sums[0] = 0
        # The first words of all blocks, the second ones, and so on; o.buckets where there is none.
        nth = np.full((_BLOCK, len(begin)), o.buckets)
        size = np.diff(begin, append=len(bucket))
        nth[np.arange(len(bucket)) - np.repeat(begin, size), np.repeat(np.arange(len(begin)), size)] = bucket
        for a in range(0, len(begin), _BATCH // _BLOCK):
            b = min(a + _BATCH // _BLOCK, len(begin))
            total = self.weights.take(nth[1, a:b], axis=0)
            for k in range(2, _BLOCK):
                total += self.weights.take(nth[k, a:b], axis=0)
            sums[a + 1 : b + 1] = self.weights.take(nth[0, a:b], axis=0) + total
        np.cumsum(sums, axis=0, out=sums)
        for size, items in self.by_window.items():
            step = max(1, size // 2)
            count = np.maximum(1, -(-(blocks - size) // step) + 1) * (blocks > 0)
            row = np.repeat(np.arange(len(blocks)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            a = block_at[:-1][row] + k * step
            b = np.minimum(a + size, block_at[1:][row])
            for c in range(0, len(row), 8192):
                x = (sums[b[c : c + 8192]] - sums[a[c : c + 8192]]).astype(np.float32)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12))
                cosine = x @ self.index.vectors[items].T
                w, i = np.nonzero(cosine >= o.near)
                # Where the words of all blocks of a window and half an item on either side hold too
                # few of the item's, no words among them can hold enough.
                held = self.held(size, nth, i, a[c + w])
                enough = held / self.length[items[i]] >= o.paraphrase
                w, i = w[enough], i[enough]
                # Half an item's length on either side holds what a shifted window has missed.
                own, half, after = row[c + w], self.length[items[i]] // 2, b[c + w]
                lo = np.maximum(begin[a[c + w]] + start - half, first[own])
                hi = np.minimum(np.where(after < len(begin), begin[np.minimum(after, len(begin) - 1)] + start, stop) + half, first[own + 1])
                yield from self.checked(words, bucket, low, first, own, lo, hi, items[i], cosine[w, i])
        for runs in self.runs:
            for row, at, item, offset in self.hits(runs, words, first):
                yield from self.led(words, bucket, low, first, row, at, item, offset)
        for runs in self.starts:
            for row, at, item, _ in self.hits(runs, words, first):
                yield from self.short(words, bucket, low, first, row, at, item)

    def held(self, size: int, nth: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the words in a window and half an item on either side an item has, each time one
        stands there. Words of other rows may be among them, but none is left out.

        ``item`` counts the items of the window length; the windows begin at blocks ``at``, ascending.
        """
        has = self.has_by_window[size]
        width = has.shape[0] * _PIECE
        around = -(-int(self.length[self.by_window[size]].max() // 2) // _BLOCK)
        span = size + 2 * around
        kind = np.uint8 if span * _BLOCK < 1 << 8 else np.uint32
        out = np.empty(len(item), np.int64)
        start = 0
        while start < len(item):
            stop = int(np.searchsorted(at, at[start] + max(1, _BATCH * 16 // width)))
            base, many = int(at[start]) - around, int(at[stop - 1] - at[start]) + span
            a, b = max(0, base), min(nth.shape[1], base + many)
            blocks = np.zeros((len(has), many, _PIECE), kind)
            for piece, own in zip(has, blocks[:, a - base : b - base], strict=True):
                for words in nth[:, a:b]:
                    own += piece.take(words, axis=0)
            # Sums of so many blocks in a row, put together from sums of 1, 2, 4, ... blocks.
            rows = many - span + 1
            total, length, power, double = np.zeros((len(has), rows, _PIECE), kind), 0, 1, blocks
            while True:
                if span & power:
                    total += double[:, length : length + rows]
                    length += power
                if length == span:
                    break
                double, power = double[:, :-power] + double[:, power:], power * 2
            piece, inner = np.divmod(item[start:stop], _PIECE)
            out[start:stop] = total.ravel().take((piece * rows + at[start:stop] - at[start]) * _PIECE + inner)
            start = stop
        return out

    def short(self, words, bucket, low, first, row, at, item) -> Iterator[tuple[int, int, tuple]]:
        """Short items all of whose words are there in one run: the first place in each row."""
        n = self.length[item]
        same = at + n <= first[row + 1]
        for k in range(self.short_words.shape[1]):
            same &= (k >= n) | (words.hashes[np.minimum(at + k, len(words.hashes) - 1)] == self.short_words[item, k])
        row, at, item = row[same], at[same], item[same]
        _, once = np.unique(row * len(self.length) + item, return_index=True)
        for r, p, i in zip(row[once].tolist(), at[once].tolist(), item[once].tolist(), strict=True):
            count = int(self.length[i])
            near = self.cosine(i, bucket[p - first[0] : p - first[0] + count])
            yield low + r, i, ("copy", 1.0, near, int(p - first[r]), count)

    def hits(self, runs: _Runs, words: Words, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and places of runs, and of which word of which item on they are."""
        for at, item, offset in runs.hits(words.hashes[first[0] : first[-1]]):
            at += first[0]
            row = np.searchsorted(first, at, "right") - 1
            own = at + runs.length <= first[row + 1]  # no run of two rows
            if own.any():
                yield row[own], at[own], item[own], offset[own]

    def led(self, words, bucket, low, first, row, at, item, offset) -> Iterator[tuple[int, int, tuple]]:
        """Findings at places that runs of the items' words point to."""
        # Where the item would begin, in steps of a quarter of it; the runs of a copy share a place.
        place = np.stack((row, item, (at - offset - first[row]) // np.maximum(1, self.length[item] // 4)), 1)
        row, item, place = np.unique(place, axis=0).T
        n = self.length[item]
        step = np.maximum(1, n // 4)
        lo = np.maximum(first[row] + place * step - n // 2, first[row])
        hi = np.minimum(first[row] + (place + 1) * step + n + n // 2, first[row + 1])
        yield from self.checked(words, bucket, low, first, row, lo, hi, item, None)

    def cosine(self, item: int, bucket: np.ndarray) -> float:
        vector = self.index.weights[bucket].sum(0, dtype=np.float64)
        return float(vector @ self.index.vectors[item] / max(np.linalg.norm(vector), 1e-12))

    def checked(self, words, bucket, low, first, row, lo, hi, item, cosine) -> Iterator[tuple[int, int, tuple]]:
        """Candidates whose words lo to hi hold enough of the item's words, then the subsequence."""
        # Shares are divided as in check, so that none at the very bound is lost to rounding.
        n = self.length[item]
        for c in range(0, len(item), 4096):
            own, begin_at = item[c : c + 4096], lo[c : c + 4096]
            span = hi[c : c + 4096] - begin_at
            ends = np.cumsum(span)
            at = np.arange(ends[-1]) + np.repeat(begin_at - first[0] - ends + span, span)
            cell = np.repeat(own * self.o.buckets, span) + bucket[at]
            has = self.has.take(cell)
            # No window is empty, so each candidate has a part of its own in the sums.
            rough = np.add.reduceat(has.view(np.uint8), ends - span, dtype=np.int64) / n[c : c + 4096] >= self.o.paraphrase
            hits = np.zeros(len(span), np.int64)
            if rough.any():
                # Of each word no more can be common than either side has.
                owner = np.repeat(np.arange(len(span)), span)
                held = np.flatnonzero(has & rough[owner])
                pair, many = np.unique(owner[held] * self.o.buckets + bucket[at[held]], return_counts=True)
                who = pair // self.o.buckets
                many = np.minimum(many, self.index.has[own[who], pair % self.o.buckets])
                hits = np.bincount(who, many, minlength=len(span))
            for j in np.flatnonzero(hits / n[c : c + 4096] >= self.o.paraphrase) + c:
                found = self.check(int(item[j]), words.hashes[lo[j] : hi[j]].tolist())
                if found:
                    where = int(lo[j] - first[row[j]]), int(hi[j] - lo[j])
                    near = self.cosine(int(item[j]), bucket[lo[j] - first[0] : hi[j] - first[0]]) if cosine is None else float(cosine[j])
                    yield low + int(row[j]), int(item[j]), (*found, near, *where)


def leaks_in(text: Column, index: Index) -> Column:
    """An array of findings for a text column: one per benchmark item, the best window of each."""

    @F.arrow_udf(FOUND)
    def found(column: pa.Array) -> pa.Array:
        search = _Search(index)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for a, b in slices(column):
            words = Words(column.slice(a, b - a), True, PLAIN)
            best: dict[tuple[int, int], tuple] = {}
            # Rows of about a megabyte of words at a time; a long row is alone.
            low = 0
            while low < b - a:
                high = max(low + 1, int(np.searchsorted(words.first, words.first[low] + (1 << 17), "right")) - 1)
                high = min(high, b - a)
                for row, item, seen in search.rows(words, low, high):
                    old = best.get((row, item))
                    if old is None or (seen[1], seen[2], -seen[3]) > (old[1], old[2], -old[3]):
                        best[row, item] = seen
                low = high
            for (row, item), (kind, share, cosine, first, count) in sorted(best.items()):
                own = {"item_id": index.items[item].item_id, "kind": kind, "common": share, "cosine": cosine}
                out[a + row].append(own | {"first_word": first, "words": count})
        kind = pa.struct([("item_id", pa.int64()), ("kind", pa.string()), ("common", pa.float64()), ("cosine", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())])
        return pa.array(out, pa.list_(kind))

    if not index.items:
        return F.array().cast(FOUND)
    return found(text)


def fitted(docs: DataFrame, benchmark: DataFrame, options: Options = Options()) -> Index:
    """The weights and the latent space, without items."""
    rows, seen = document_frequencies(docs, options)
    idf = np.log((rows + 1) / (seen + 1)) + 1e-3
    passages = _passages(docs, benchmark, options)
    space, strength = latent_space(passages, idf, options)
    drop(passages)
    release(docs.sparkSession)
    # Divided by the singular values: what all passages of a language have in common would else
    # make any two of them near. Equal words still have equal vectors, whatever their directions.
    scale = 1 / np.sqrt(np.maximum(strength, 1e-3 * max(strength.max(), 1e-12)))
    return Index(options, (idf[:, None] * space * scale).astype(np.float32))


def blocks(benchmark: DataFrame, options: Options = Options()) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most ``items`` rows, fetched one after the other."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    parts = max(1, -(-rows.count() // (options.items * 3 // 4)))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        for a in range(0, len(own), options.items):
            yield [(r["item_id"], r["text"]) for r in own[a : a + options.items]]


def leaks(docs: DataFrame, benchmark: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per document row and benchmark item found in it."""
    index = fitted(docs, benchmark, options)
    out = None
    for rows in blocks(benchmark, options):
        part = docs.select("doc_id", F.explode(leaks_in(F.col("text"), with_items(index, rows))).alias("x")).select("doc_id", "x.*")
        out = part if out is None else stored(out, "leaks").union(part)
    if out is None:
        out = docs.select("doc_id", F.explode(F.array().cast(FOUND)).alias("x")).select("doc_id", "x.*")
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, options: Options = Options()) -> DataFrame:
    """The documents without benchmark items, with all their columns."""
    index = fitted(docs, benchmark, options)
    out = docs
    for rows in blocks(benchmark, options):
        out = out.where(F.size(leaks_in(F.col("text"), with_items(index, rows))) == 0)
    return out
