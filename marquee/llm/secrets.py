"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings stand alone: an assignment to a secret's name with a long value, an access key id,
a long run of hex digits. Weak ones are reported only where parts that complete each other meet
within one scope, that is, with at most ``scope`` code points between them in one text:

* ``weak_secret``, an assignment with a short value: where an identifier is in its scope;
* ``weak_access``, an access key id that is too short, and ``login``, an assignment to a user's
  name: where a secret (strong or weak) is in its scope;
* ``endpoint``, a URL or an assignment to a host's name: where both are in its scope.

Positions come from the texts between matches, whose lengths are summed in order. Parts meet in an
equi-join on text and position bin followed by the exact distance, so that a text with many parts
makes pairs of neighbours only.

Defined results
* null text counts as empty, and neither has spans.
* repeated rows are scanned each; a row is told apart by its own number and not by its ``doc_id``,
  which may be null. Other columns are never looked at, whatever their names.
* spans that begin together are listed in the order of ``KINDS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import stored

KINDS = ["assign", "access", "hex", "weak_secret", "weak_access", "login", "endpoint"]
BASE = KINDS[:3]

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LOGIN = r"""(?i)\b(user|username|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)"""
ENDPOINT = r"""(?i)\b(?:(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?:host|hostname|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]+)"""


@dataclass(frozen=True)
class Options:
    """``scope``: code points between parts of one credential. Lengths are those of the values."""

    scope: int = 200
    strong: int = 12
    weak: int = 6
    access: int = 18


def _measured(docs: DataFrame) -> DataFrame:
    """Lengths of the matches and of the texts between them, for each row and pattern."""
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "login": LOGIN, "endpoint": ENDPOINT}
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        text.alias("text"),
        *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(name) for name, p in patterns.items()],
    )
    out = ["row", "doc_id"]
    for name, pattern in patterns.items():
        between = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
        value = (lambda x: F.length(F.regexp_extract(x, ASSIGN, 2))) if name == "assign" else F.length
        parts = F.arrays_zip(
            F.transform(name, lambda x: F.length(x)).alias("length"),
            F.slice(between, 1, F.size(name)).alias("before"),
            F.transform(name, value).alias("value"),
        )
        out.append(F.when(F.size(name) > 0, parts).alias(name))
    return found.select(*out)


def _placed(measured: DataFrame, name: str) -> DataFrame:
    """Start and end of every match of one pattern."""
    rows = measured.where(F.col(name).isNotNull()).select("row", F.posexplode(name).alias("at", "part"))
    so_far = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part.before") + F.col("part.length")).over(so_far)
    rows = rows.select("row", end.alias("end"), F.col("part.length").alias("length"), F.col("part.value").alias("value"))
    return rows.select("row", (F.col("end") - F.col("length")).alias("start"), "end", "value")


def _parts(measured: DataFrame, options: Options) -> DataFrame:
    """All strong and weak parts with their kind and what they are part of."""
    value = F.col("value")
    rules = {
        "assign": [("assign", "secret", value >= options.strong), ("weak_secret", "secret", (value >= options.weak) & (value < options.strong))],
        "access": [("access", "identifier", value >= options.access), ("weak_access", "identifier", value < options.access)],
        "hex": [("hex", "secret", F.lit(True))],
        "login": [("login", "identifier", F.lit(True))],
        "endpoint": [("endpoint", "endpoint", F.lit(True))],
    }
    out = None
    for name, cases in rules.items():
        kind = role = F.lit(None).cast("string")
        for each, part, test in reversed(cases):
            kind = F.when(test, F.lit(each)).otherwise(kind)
            role = F.when(test, F.lit(part)).otherwise(role)
        rows = _placed(measured, name).select("row", "start", "end", kind.alias("kind"), role.alias("role"))
        out = rows if out is None else out.union(rows)
    return out.where("kind is not null")


def _linked(parts: DataFrame, options: Options) -> DataFrame:
    """The weak parts whose scope holds what completes them."""
    scope, width = options.scope, 2 * options.scope

    def bins(margin: int) -> Column:
        low, high = F.floor((F.col("start") - margin) / width), F.floor((F.col("end") + margin) / width)
        return F.explode(F.sequence(low, high)).alias("bin")

    weak = parts.where(~F.col("kind").isin(*BASE)).select("*", bins(scope))
    others = parts.where("role <> 'endpoint'")
    others = others.select("row", F.col("start").alias("from"), F.col("end").alias("to"), F.col("role").alias("other"), bins(0))
    near = (F.col("from") <= F.col("end") + scope) & (F.col("to") >= F.col("start") - scope) & (F.col("role") != F.col("other"))
    seen = weak.join(others, ["row", "bin"]).where(near).groupBy("row", "start", "end", "kind", "role")
    seen = seen.agg(F.count_distinct("other").alias("met"))
    return seen.where("met = 2 or role <> 'endpoint'").select("row", "start", "end", "kind")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``row, doc_id, spans`` of every row: an array of ``start, number, end, kind`` in order."""
    measured = stored(_measured(docs), "secrets")
    parts = stored(_parts(measured, options), "parts")
    strong = parts.where(F.col("kind").isin(*BASE)).select("row", "start", "end", "kind")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = strong.union(_linked(parts, options)).select("row", F.struct("start", number.alias("number"), "end", "kind").alias("span"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,number:bigint,end:bigint,kind:string>>")
    return measured.select("row", "doc_id").join(spans, "row", "left").select("row", "doc_id", F.coalesce("spans", none).alias("spans"))


def report(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``doc_id``, the strong findings by kind, a digest of them, and all spans as text."""
    found = find(docs, options)
    base = F.filter("spans", lambda x: x["number"] <= len(BASE))

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, options: Options = Options(), mask: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mask``; ``n_chars``, where there is one, follows.

    Overlapping spans become one mask. Other columns stay as they are.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    numbered = stored(numbered, "documents")
    texts = numbered.select("row", F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    spans = find(texts, options).where(F.size("spans") > 0).select(F.col("doc_id").alias("row"), "spans")
    # Spans in order; each adds the text since the last end, and a mask unless it overlaps.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        between = F.substring(F.col("doc.text"), (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        parts = F.when(fresh, F.concat(done["parts"], F.array(between, F.lit(mask)))).otherwise(done["parts"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), parts.alias("parts"))

    def join(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring(F.col("doc.text"), (done["at"] + 1).cast("int"), F.length("doc.text")))

    cleaned = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(F.aggregate("spans", start, add, join))
    out = numbered.join(spans, "row", "left").select("doc", F.col("spans").isNotNull().alias("changed"), cleaned.alias("text"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            kind = docs.schema["n_chars"].dataType
            columns.append(F.when(F.col("changed"), F.length("text")).otherwise(F.col("doc.n_chars")).cast(kind).alias(name))
        else:
            columns.append(F.col("doc").getField(name).alias(name))
    return out.select(*columns)
