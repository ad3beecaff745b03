"""Token rows of a fixed length, packed best fit first.

A document's ids and an end mark are one segment. A longer one than a row is cut into whole rows
and a remainder; nothing is lost or repeated. Remainders and short documents, longest first, go to
the fullest row that still has room, which a segment tree over the free lengths finds, or to a new
row. Rows are packed block by block, a bounded number of ids at a time and without a shuffle.

A packed row has ``ids`` (a row of the id matrix, little-endian, filled up with the end mark),
``ends`` (cumulative segment lengths, from 0), ``resets`` (where positions start again at 0) and
``parts`` (document and offset of each segment).

Defined results
* null text: no segment. Empty text: the end mark alone. Null ``doc_id``: a segment like any other.
* segments of one length go in the order of the table; repeated rows are packed each.
* an empty table gives no rows; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.tokens import VOCABULARY, Tokens, read
from marquee.llm.words import slices


@dataclass(frozen=True)
class Options:
    """``length``: ids of a row. ``block``: ids packed together, apart from one long document."""

    length: int = 2048
    block: int = 1 << 22
    vocabulary: str = VOCABULARY


PACKED = "block long, row int, used int, ids binary, ends array<int>, resets array<int>, parts array<struct<doc_id:long,offset:long>>"
_PARTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64())]))


class Room:
    """Free lengths 0 to ``size`` with the rows that have them, in a segment tree of counts."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, free: int, by: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._change(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, and its room; it leaves the tree."""
        node = need + self.leaves
        if not self.count[node]:
            # Up to the first subtree on the right with any row, then down to its first leaf.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._change(free, -1)
        return self.rows[free].pop(), free


def packed_rows(lengths: list[int], size: int) -> list[list[int]]:
    """Segments (their numbers) of each row, by best fit decreasing; none is longer than ``size``."""
    room, rows = Room(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = room.take(lengths[k])
        if found is None:
            rows.append([])
            found = len(rows) - 1, size
        row, free = found
        rows[row].append(k)
        if free > lengths[k]:
            room.put(free - lengths[k], row)
    return rows


def _packer(file: bytes, options: Options):
    size = options.length

    def flush(number: int, held: list, tokens: Tokens) -> pa.RecordBatch:
        """``held``: document, offset, ids of every segment."""
        rows = packed_rows([len(ids) for _, _, ids in held], size)
        width = tokens.dtype.itemsize
        matrix, ends, parts = [], [], []
        for own in rows:
            segments = [held[k] for k in own]
            ends.append(np.concatenate(([0], np.cumsum([len(x[2]) for x in segments]))).tolist())
            fill = np.full(size - ends[-1][-1], tokens.end, tokens.dtype)
            matrix.append(np.concatenate([*(x[2] for x in segments), fill]).tobytes())
            parts.append([{"doc_id": d, "offset": o} for d, o, _ in segments])
        assert all(len(x) == size * width for x in matrix)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * len(rows), pa.int64()),
                pa.array(range(len(rows)), pa.int32()),
                pa.array([x[-1] for x in ends], pa.int32()),
                pa.array(matrix, pa.binary()),
                pa.array(ends, pa.list_(pa.int32())),
                pa.array([x[:-1] for x in ends], pa.list_(pa.int32())),
                pa.array(parts, _PARTS),
            ],
            ["block", "row", "used", "ids", "ends", "resets", "parts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = Tokens(file)
        end = np.array([tokens.end], tokens.dtype)
        number = TaskContext.get().partitionId() << 32
        held, amount = [], 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text is None:
                        continue
                    ids = np.concatenate((np.frombuffer(tokens.encode(text), tokens.dtype), end))
                    held += [(doc, o, ids[o : o + size]) for o in range(0, len(ids), size)]
                    amount += len(ids)
                    if amount >= options.block:
                        yield flush(number, held, tokens)
                        held, amount, number = [], 0, number + 1
        if held:
            yield flush(number, held, tokens)

    return run


def pack(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Packed rows of all texts."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packer(read(options.vocabulary), options), PACKED)


def write(docs: DataFrame, path: str, options: Options = Options()) -> None:
    """Packed rows as Parquet files; read again, the ``ids`` of a file are its id matrix."""
    pack(docs, options).write.parquet(path)


def unpack(packed: DataFrame, options: Options = Options()) -> DataFrame:
    """``doc_id, offset, ids``: the segments of packed rows, for checks and for other layouts."""
    width = Tokens(read(options.vocabulary)).dtype.itemsize
    row = packed.select("ids", "ends", F.posexplode("parts").alias("k", "part"))
    low, high = F.element_at("ends", F.col("k") + 1), F.element_at("ends", F.col("k") + 2)
    ids = F.substring("ids", low * width + 1, (high - low) * width)
    return row.select("part.doc_id", "part.offset", ids.alias("ids"))


def report(packed: DataFrame) -> DataFrame:
    """Packed rows with a digest of the ids instead of the ids."""
    return packed.select(
        "block",
        "row",
        "used",
        F.size("parts").alias("segments"),
        F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("parts", lambda x: x["offset"]).alias("offsets"),
        "ends",
        "resets",
        F.sha2("ids", 256).alias("ids_sha256"),
    )
