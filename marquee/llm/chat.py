r"""Chat formatting in windows of a token budget.

The tokens of a conversation's turns are added up in order. A window is the longest run of whole
turns that fits into the budget together with what it repeats: the conversation's leading system
turn, and those turns before it that begin at most ``history`` tokens earlier. No window exceeds the
budget: of the system turn at most ``system`` tokens are repeated, and a turn that would not fit next
to system turn and history is cut into pieces, which fill windows as turns do and are joined again
within one. A piece that goes on with a turn of an earlier window has a + after its role. Only
assistant text that a window has first is trained on: the loss mask covers it, and never repeated text.

Windows begin anew at every multiple of ``stretch`` budgets of a conversation's tokens, so a stretch
is of bounded size and all stretches are worked on at once, however long the conversation. What a
stretch repeats from the one before is sent to both. New turns take at least half of what windows
leave for them, in the mean, so the output grows with the input.

A turn is written as ``### Role: text``, a line end, ``</turn>`` and a line end. Roles other than
user, assistant, system and tool are written as @ and the hex digits of their bytes. In texts, a
backslash goes before each ``### `` and ``</turn>`` and the backslashes in front of it; taking one
away again gives the text back, whatever it holds.

Sums are made per range of rows and then over the ranges, so a conversation that holds a third of
all rows is spread over many tasks. Reading back passes a conversation's windows through one task
in order, as its digests need, and holds one window at a time.

Defined results
* turns go by ``turn``, nulls first; equal numbers by role, then text. Repeated rows are turns each.
* null text and null role count as empty. Null ``conv_id`` is one conversation.
* the tokens of a turn are those of its escaped text, ``extra``, and those of the name of another role.
  Such a name is never cut: with one longer than the budget, and only then, a window is too.
* an empty table gives no rows; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.tokens import VOCABULARY, Tokens, read
from marquee.session import stored


@dataclass(frozen=True)
class Options:
    """``system``: the most tokens repeated of a system turn, by default an eighth of the budget.
    ``extra``: tokens that a turn takes besides those of its text. ``stretch``: budgets in a stretch."""

    budget: int = 1024
    history: int = 192
    system: int | None = None
    extra: int = 8
    stretch: int = 64
    vocabulary: str = VOCABULARY

    def __post_init__(self):
        if min(self.kept, self.room) < self.least:
            raise ValueError("budget too small for history, system turn and a piece of a turn")

    @property
    def least(self) -> int:
        """Room for any code point and its escapes."""
        return self.extra + 16

    @property
    def kept(self) -> int:
        return self.budget // 8 if self.system is None else self.system

    @property
    def room(self) -> int:
        """What is left for new turns whatever is repeated."""
        return self.budget - self.history - self.kept


ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
END = "\n</turn>\n"
_ESCAPE = r"(\\*(?:### |</turn>))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\" + _ESCAPE, r"\1", text)


def _heading(role: Column, again: Column) -> Column:
    name = F.concat(F.lit("@"), F.hex(F.encode(role, "UTF-8")))
    for known, title in ROLES.items():
        name = F.when(role == known, F.lit(title)).otherwise(name)
    return F.concat(F.lit("### "), name, F.when(again, "+").otherwise(""), F.lit(": "))


def _cutter(options: Options, conv: str):
    """Turns as pieces with their tokens and those of the same turn before them."""
    file = read(options.vocabulary)
    names = ["conv_id", "role", "text", "done", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(file)

        def halves(text: str, extra: int, most: int) -> Iterator[tuple[str, int]]:
            size = tokens.count(re.sub(_ESCAPE, r"\\\1", text)) + extra
            if size <= most or len(text) < 2:
                yield text, size
            else:
                middle = len(text) // 2
                yield from halves(text[:middle], extra, most)
                yield from halves(text[middle:], extra, most)

        def pieces(role: str, text: str) -> Iterator[tuple[str, int]]:
            extra = options.extra + (0 if role in ROLES else tokens.count(role.encode().hex()))
            whole, share = (options.kept, 4) if role == "system" else (options.room, 8)
            most = max(whole // share, options.least)
            # Texts this long are cut in any case; a code point has a byte at least.
            if len(text) <= 64 * whole:
                size = tokens.count(re.sub(_ESCAPE, r"\\\1", text)) + extra
                if size <= whole:
                    yield text, size
                    return
            for at in range(0, len(text), 4 * most):
                yield from halves(text[at : at + 4 * most], extra, most)

        for batch in batches:
            rows = []
            kinds = [batch.schema.field("conv_id").type, pa.string(), pa.string(), pa.int64(), pa.int64()]
            for i in range(batch.num_rows):
                key, role, text = (batch.column(n)[i].as_py() for n in names[:3])
                done = 0
                for piece, size in pieces(role, text):
                    rows.append((key, role, piece, done, size))
                    done += size
                if len(rows) >= 4096 or i + 1 == batch.num_rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                    rows = []

    return run, f"conv_id {conv}, role string, text string, done long, tokens long"


def _summed(turns: DataFrame, options: Options) -> DataFrame:
    """Pieces of turns in order with the tokens before each in its conversation."""
    text = F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(*_cutter(options, turns.schema["conv_id"].dataType.simpleString()))
    # Other ranges could be drawn the next time, so the rows are written with their places.
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "turns")
    rows = rows.withColumn("part", F.shiftright("place", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("earlier"))
    here = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", F.coalesce(F.sum("tokens").over(here), F.lit(0)).alias("inside"))
    same = inside["conv_id"].eqNullSafe(parts["conv_id"]) & (inside["part"] == parts["part"])
    columns = [inside["conv_id"], "place", "role", "text", "done", "tokens", (F.col("inside") + F.col("earlier")).alias("before")]
    return stored(inside.join(parts, same).select(*columns), "sums")


# Stretches of one conversation that one row is multiplied into by one task.
_BLOCK = 1024


def _dealt(rows: DataFrame, options: Options) -> DataFrame:
    """Pieces with their stretch; ``kind`` 0 and 1 are system turn and history from stretches before."""
    wide = options.stretch * options.budget
    rows = rows.withColumn("stretch", F.floor(F.col("before") / wide))
    columns = ["conv_id", "stretch", "kind", "place", "role", "text", (F.col("done") > 0).alias("again"), "before", "tokens"]
    own = rows.withColumn("kind", F.lit(2))
    tail = rows.where(F.col("before") >= (F.col("stretch") + 1) * wide - options.history)
    tail = tail.withColumn("kind", F.lit(1)).withColumn("stretch", F.col("stretch") + 1)
    head = rows.where((F.col("role") == "system") & (F.col("before") == F.col("done")) & (F.col("before") + F.col("tokens") <= options.kept))
    last = rows.groupBy(F.col("conv_id").alias("c")).agg(F.max("stretch").alias("last"))
    head = head.drop("stretch").withColumn("kind", F.lit(0)).join(last, F.col("conv_id").eqNullSafe(F.col("c")))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / _BLOCK)))
    head = head.withColumn("block", block).repartition("conv_id", "block")
    first = F.col("block") * _BLOCK
    head = head.withColumn("stretch", F.explode(F.sequence(first, F.least("last", first + _BLOCK - 1))))
    return own.select(*columns).union(tail.select(*columns)).union(head.select(*columns))


def _filler(options: Options, conv: str):
    """Windows of stretches whose rows come one after the other."""

    def filled(rows: list[dict]) -> Iterator[tuple[int, int, list[dict]]]:
        head = [r for r in rows if r["kind"] == 0]
        rows = [r for r in rows if r["kind"] > 0]
        at = sum(r["kind"] == 1 for r in rows)
        while at < len(rows):
            first = rows[at]
            system = [r for r in head if r["place"] < first["place"]]
            since = system[-1]["place"] if system else -1
            low = at
            while low and rows[low - 1]["before"] >= first["before"] - options.history and rows[low - 1]["place"] > since:
                low -= 1
            used = sum(r["tokens"] for r in system) + first["before"] - rows[low]["before"] + first["tokens"]
            end = at + 1
            while end < len(rows) and used + rows[end]["tokens"] <= options.budget:
                used += rows[end]["tokens"]
                end += 1
            out: list[dict] = []
            for kind, part in enumerate([system, rows[low:at], rows[at:end]]):
                for r in part:
                    if out and r["again"] and out[-1]["kind"] == kind:
                        out[-1]["texts"].append(r["text"])
                    else:
                        out.append({"kind": kind, "role": r["role"], "again": r["again"], "texts": [r["text"]]})
            yield first["before"], used, [{**x, "text": "".join(x["texts"])} for x in out]
            at = end

    turn = pa.struct([("kind", pa.int32()), ("role", pa.string()), ("again", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def written(kind: pa.DataType) -> pa.RecordBatch:
            starts, sizes, turns = zip(*filled(rows), strict=True) if any(r["kind"] == 2 for r in rows) else ((), (), ())
            arrays = [pa.array([key[0]] * len(starts), kind), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(turns, pa.list_(turn))], ["conv_id", "start", "tokens", "turns"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                now = (row["conv_id"], row["stretch"])
                if now != key:
                    if rows:
                        yield written(kind)
                    key, rows = now, []
                rows.append(row)
        if rows:
            yield written(kind)

    turns = "array<struct<kind:int,role:string,again:boolean,text:string>>"
    return run, f"conv_id {conv}, start long, tokens long, turns {turns}"


def windows(turns: DataFrame, options: Options = Options()) -> DataFrame:
    """``conv_id, start, tokens, text, repeated, loss`` of every window.

    ``start`` is the tokens before the window's own turns and puts the windows in order, ``tokens``
    what the window takes of the budget, ``repeated`` the number of leading turns that earlier windows
    have, and ``loss`` the ranges of code points (end exclusive) that are trained on.
    """
    rows = _dealt(_summed(turns, options), options)
    rows = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "kind", "place")
    filled = rows.mapInArrow(*_filler(options, turns.schema["conv_id"].dataType.simpleString()))
    shown = F.transform(
        "turns",
        lambda x: F.struct(
            x["kind"].alias("kind"), x["role"].alias("role"), _heading(x["role"], x["again"]).alias("heading"), escaped(x["text"]).alias("body")
        ),
    )
    shaped = filled.select("conv_id", "start", "tokens", shown.alias("turns"))
    written = F.transform("turns", lambda x: F.concat(x["heading"], x["body"], F.lit(END)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def add(done: Column, x: Column) -> Column:
        low = done["at"] + F.length(x["heading"])
        high = low + F.length(x["body"])
        hit = (x["kind"] == 2) & (x["role"] == "assistant")
        loss = F.when(hit, F.concat(done["loss"], F.array(F.struct(low.alias("start"), high.alias("end"))))).otherwise(done["loss"])
        return F.struct((high + len(END)).alias("at"), loss.alias("loss"))

    loss = F.aggregate("turns", begin, add, lambda done: done["loss"])
    repeated = F.size(F.filter("turns", lambda x: x["kind"] < 2))
    return shaped.select("conv_id", "start", "tokens", F.array_join(written, "").alias("text"), repeated.alias("repeated"), loss.alias("loss"))


def entries(text: str) -> list[tuple[str, str, bool]]:
    """Roles and texts of a formatted window, and whether they go on with a turn begun earlier."""
    titles = {title: role for role, title in ROLES.items()}
    out = []
    for part in text.split(END)[:-1]:
        name, body = part.removeprefix("### ").split(": ", 1)
        again, name = name.endswith("+"), name.removesuffix("+")
        role = bytes.fromhex(name[1:]).decode() if name.startswith("@") else titles[name]
        out.append((role, unescaped(body), again))
    return out


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    return [(role, body) for role, body, _ in entries(text)]


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, windows long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose windows come one after the other; a window at a time."""

    def row(s: dict) -> pa.RecordBatch:
        s["all"].update(b"\n")  # the last turn's end; a conversation has a turn
        values = [s["id"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["written"], s["windows"]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "windows"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def fresh(conv: int | None) -> dict:
        return {"id": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "written": 0, "windows": 0}

    now = None
    for batch in batches:
        for i in range(batch.num_rows):
            conv, text, repeated, loss = (batch.column(n)[i].as_py() for n in ("conv_id", "text", "repeated", "loss"))
            if now is None or now["id"] != conv:
                if now is not None:
                    yield row(now)
                now = fresh(conv)
            for role, body, again in entries(text)[repeated:]:
                if not again:
                    now["all"].update(f"{chr(10) if now['turns'] else ''}{role}\n".encode())
                    now["turns"] += 1
                now["all"].update(body.encode())
            for span in loss:
                body = unescaped(text[span["start"] : span["end"]])
                now["chars"] += len(body)
                now["loss"].update(body.encode())
            now["written"] += len(text)
            now["windows"] += 1
    if now is not None:
        yield row(now)


def report(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted windows finds in each conversation."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return rows.mapInArrow(_reader, READ)
