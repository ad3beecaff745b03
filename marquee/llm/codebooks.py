"""Compression of vectors by product codes, with an equal-average search for the nearest entry.

Components become whole numbers. A vector is cut into parts, each part position has a codebook, and
a part is coded as the number of its nearest entry. By the Cauchy-Schwarz inequality the squared
distance of two parts is at least the squared difference of their component sums over the number of
components. So the entries are sorted by sum, and a part looks at entries outward from its own sum
until the squared gap over the dimension strictly exceeds the best distance found; entries at the
bound itself are still looked at, so that ties go to the lower number.

Codebooks are fitted on all rows: each round assigns every part and moves the entries to the means.
Tasks add up their parts' entries, so a round shuffles one row per task and entry, however many rows
fall to one entry. Only the codebooks, whose size is a parameter, go through the driver.

Defined results
* vectors that are null or hold null or non-finite components are left out. Rows without an id stay,
  but start no entry. Of rows with one id, the first by components starts an entry; all are rows.
* vectors of each length have their own codebooks. A length that the parts don't divide is filled
  up with zeros; an empty vector has empty parts, which are all alike.
* fewer than 256 ids: as many entries. No id at all for a length: ``code`` and ``error`` are null.
* vectors whose length times squared largest component (after scaling) reaches 2**60 could leave the
  range of longs: they stay as rows with null ``code`` and ``error`` and don't shape the codebooks.
* ``label_error`` is null where it would leave the range of longs, and where all its errors are null.
* repeated rows are rows each. An empty table gives an empty table; other columns are never looked
  at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.grid import matrix
from marquee.llm.scratch import drop
from marquee.session import stored


@dataclass(frozen=True)
class Options:
    """``scale``: what a component is multiplied by before it is rounded down."""

    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4


# The codebook of each part position, entries by components, for each length of vectors.
Books = dict[int, list[np.ndarray]]

# Vectors searched at a time.
_ROWS = 4096
_NONE = np.iinfo(np.int64).max


def whole(vectors: DataFrame, options: Options) -> DataFrame:
    """``id, label, length, vector`` with whole components (as doubles) of the rows that take part;
    ``vector`` is null where numbers are too large for sums in longs."""
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    floors = F.transform(values, lambda x: F.floor(x * float(options.scale)).cast("double"))
    # Beyond that a floor is not a long, and the vector is too large anyway.
    small = F.forall(values, lambda x: F.abs(x) < float(1 << 40))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("id"), "label", F.when(small, floors).alias("vector"), F.size(values).alias("length"))
    most = F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    return rows.select("id", "label", "length", F.when(F.col("length") * most * most < float(1 << 60), F.col("vector")).alias("vector"))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each part's nearest entry, ties to the lower number."""
    n, width = parts.shape
    total = book.sum(1)
    order = np.lexsort((np.arange(len(book)), total))
    entries, total = book[order], total[order]
    own = parts.sum(1)
    best = np.full(n, _NONE)
    number = np.full(n, len(book))
    middle = np.searchsorted(total, own)
    # Parts whose search goes on to smaller and to larger sums, with the place to look at next.
    sides = [(np.arange(n), middle - 1, -1), (np.arange(n), middle, 1)]
    while any(len(row) for row, _, _ in sides):
        ahead = []
        for row, at, step in sides:
            inside = (at >= 0) & (at < len(book))
            row, at = row[inside], at[inside]
            gap = (own[row] - total[at]).astype(np.float64)
            # Rounding must not close a side at the bound itself.
            near = gap * gap * (1 - 1e-12) <= best[row].astype(np.float64) * width
            row, at = row[near], at[near]
            apart = parts[row] - entries[at]
            distance = (apart * apart).sum(1)
            here = order[at]
            better = (distance < best[row]) | ((distance == best[row]) & (here < number[row]))
            best[row[better]], number[row[better]] = distance[better], here[better]
            ahead.append((row, at + step, step))
        sides = ahead
    return number, best


def _cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    """The parts of equally long vectors, filled up with zeros where needed."""
    width = -(-vectors.shape[1] // parts)
    filled = np.zeros((len(vectors), width * parts), np.int64)
    filled[:, : vectors.shape[1]] = vectors
    return [filled[:, p * width : (p + 1) * width] for p in range(parts)]


def _coded(batch: pa.RecordBatch, books: Books, options: Options) -> Iterator[tuple[np.ndarray, int, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of one length at a time: their places, the length, the parts and what they are nearest to."""
    lengths = np.where(batch.column("vector").is_valid().to_numpy(zero_copy_only=False), batch.column("length").to_numpy(), -1)
    for length in np.unique(lengths).tolist():
        if length not in books:
            continue
        places = np.flatnonzero(lengths == length)
        for a in range(0, len(places), _ROWS):
            some = places[a : a + _ROWS]
            parts = _cut(matrix(batch.column("vector").take(pa.array(some))).astype(np.int64), options.parts)
            yield some, length, parts, [nearest(x, book) for x, book in zip(parts, books[length], strict=True)]


SUMS = "length int, part int, entry int, n long, sums array<long>"


def _summed(books: Books, options: Options):
    """The parts of each entry, counted and added up over a whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: np.zeros((len(v), len(v[0])), np.int64) for k, v in books.items()}
        sums = {k: np.zeros((len(v), *v[0].shape), np.int64) for k, v in books.items()}
        for batch in batches:
            for _, length, parts, found in _coded(batch, books, options):
                for p, (x, (number, _)) in enumerate(zip(parts, found, strict=True)):
                    counts[length][p] += np.bincount(number, minlength=counts[length].shape[1])
                    np.add.at(sums[length][p], number, x)
        for length, n in counts.items():
            part, entry = np.nonzero(n)
            columns = [pa.array(x, pa.int32()) for x in (np.full(len(part), length), part, entry)]
            columns += [pa.array(n[part, entry]), pa.array(sums[length][part, entry].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["length", "part", "entry", "n", "sums"])

    return run


def _encoded(books: Books, options: Options):
    """Rows with their code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for places, _, _, found in _coded(batch, books, options):
                numbers = np.stack([number for number, _ in found], 1)
                codes[places] = ["".join(f"{x:02x}" for x in row) for row in numbers.tolist()]
                errors[places] = sum(distance for _, distance in found).tolist()
            kept = [batch.column(c) for c in ("id", "label", "length")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "length", "code", "error"])

    return run


def _first(rows: DataFrame, options: Options) -> Books:
    """The parts of the vectors with the smallest ids of each length."""
    named = rows.where("id is not null and vector is not null")
    order = Window.partitionBy("length").orderBy("id")
    ids = named.select("length", "id").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= options.entries)
    starts = named.join(ids, ["length", "id"]).groupBy("length", "place").agg(F.min("vector").alias("vector"))
    found: dict[int, list] = {}
    for r in sorted(starts.collect(), key=lambda r: (r["length"], r["place"])):
        found.setdefault(r["length"], []).append(r["vector"])
    return {length: _cut(np.array(x, np.float64).reshape(len(x), length).astype(np.int64), options.parts) for length, x in found.items()}


def fit(rows: DataFrame, options: Options = Options()) -> Books:
    """Codebooks of all ``rows``, as ``whole`` gives them."""
    books = _first(rows, options)
    width = max((x.shape[1] for parts in books.values() for x in parts), default=0)
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    for _ in range(options.rounds if books else 0):
        partial = rows.mapInArrow(_summed(books, options), SUMS)
        moved = partial.groupBy("length", "part", "entry").agg(F.sum("n").alias("n"), *totals).collect()
        books = {length: [x.copy() for x in parts] for length, parts in books.items()}
        for r in moved:
            book = books[r["length"]][r["part"]]
            book[r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(book.shape[1])]
    return books


def fingerprint(parts: list[np.ndarray]) -> str:
    """Digest of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in parts for x in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, options: Options = Options()) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that takes part."""
    rows = stored(whole(vectors, options), "vectors")
    books = fit(rows, options)
    kind = rows.schema["label"].dataType.simpleString()
    coded = stored(rows.mapInArrow(_encoded(books, options), f"id long, label {kind}, length int, code string, error long"), "codes")
    drop(rows)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    digest = F.lit(None).cast("string")
    for length, parts in books.items():
        digest = F.when(F.col("length") == length, F.lit(fingerprint(parts))).otherwise(digest)
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))
