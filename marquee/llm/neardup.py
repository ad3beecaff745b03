"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

Every shingle of a document draws, in steps j = 0, 1, ..., one slot of a random permutation and the
rank j plus a uniform number; a slot keeps its least rank. The slots of one shingle exclude each
other, which makes the estimate less scattered than independent minima, and a document is finished
as soon as every slot holds a rank below the next step. Runs of slots are hashed to bands.

Documents with equal sets are one class and only its smallest document goes on. Within a band
bucket, classes are compared with leaders and not with each other: first with the smallest, then,
where the bucket still holds several components, with more and more others. In large groups the
shingles that nobody else has bound what two members can share, so that members with many changes
of their own are not compared with all others in vain. So large groups of near copies cost a row
per member, and yet every pair of a bucket is either compared, in one component already, or known
to be too different. Comparisons are made on whole sets.

Defined results
* null or blank text: empty set, linked with nothing; the document is its own component.
* fewer words than a shingle: the whole sequence is the only shingle.
* rows with one ``doc_id``: one node, with the links of all its texts; all its rows are ``kept`` or
  none. ``drop_copies`` keeps one row of each group of alike texts, whatever their ids.
* null ``doc_id``: never linked, ``component_id`` null, kept.
* an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.components import components
from marquee.llm.scratch import drop, release
from marquee.llm.words import Shingles, mix, slices
from marquee.session import stored

_SIGNED = "struct<n:long,digest:binary,bands:array<long>>"
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Options:
    """``percent``: link where 100 * intersection >= percent * union. ``miss``: the chance that a
    pair exactly at the threshold shares no band; it sets the number of bands."""

    shingle: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    seed: int = 1

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows))))


def superminhash(values: np.ndarray, first: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """A row of ``slots`` ranks per set; ``values[first[i]:first[i + 1]]`` is set i.

    A rank is the step in the upper and the uniform number in the lower 32 bits. Empty sets keep
    free slots.
    """
    sets = len(first) - 1
    ranks = np.full(sets * slots, _FREE, np.uint64)
    row = np.repeat(np.arange(sets), np.diff(first))
    state = mix(values ^ mix(np.array([seed], np.uint64)))
    order = None
    for j in range(slots):
        if not len(row):
            break
        drawn = mix(state + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        # Upper bits choose the slot among those left, lower bits are the uniform number.
        k = j + ((drawn >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
        if order is None:
            place = k
        else:
            each = np.arange(len(row))
            place = order[each, k]
            order[each, k] = order[:, j]
        rank = (np.uint64(j) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF))
        np.minimum.at(ranks, row * slots + place, rank)
        going = (ranks.reshape(sets, slots) == _FREE).any(1)[row]
        if order is None:
            row, state, k = row[going], state[going], k[going]
            order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(row), slots)).copy()
            order[np.arange(len(row)), k] = 0
        elif not going.all():
            row, state, order = row[going], state[going], order[going]
    return ranks.reshape(sets, slots)


def signatures(column: pa.Array, options: Options) -> pa.Array:
    """Size, digest of the whole set, and band keys of each text."""
    bands, width = options.bands, options.rows
    sizes, digests, found = [], [], []
    for a, b in slices(column, _SLICE):
        sets = Shingles(column.slice(a, b - a), options.shingle)
        ranks = superminhash(sets.values, sets.first, bands * width, options.seed)
        keys = np.zeros((b - a, bands), np.uint64)
        for r in range(width):
            keys = mix(keys * _STEP + ranks[:, r::width] + np.arange(1, bands + 1, dtype=np.uint64))
        count = np.diff(sets.first)
        sizes.append(count)
        digests += [xxhash.xxh3_128_digest(sets.of(i).tobytes()) for i in range(b - a)]
        found.append(keys.view(np.int64))
    n = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    keys = np.concatenate(found) if found else np.empty((0, bands), np.int64)
    lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], ["n", "digest", "bands"])


def _signature(options: Options):
    @F.arrow_udf(_SIGNED)
    def signed(column: pa.Array) -> pa.Array:
        return signatures(column, options)

    return signed


def _verified(options: Options):
    """Streams rows sorted by leader and chunk, the leader's text first, and holds one leader's set.

    Of large groups it also gives a member's shingles that its leader hasn't, and a mask of 128
    bits of the leader's shingles that the member hasn't.
    """
    percent, width = options.percent, options.shingle

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leading = None, []
        for batch in batches:
            us, vs, linked, own_only, missing = [], [], [], [], []
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                sets = Shingles(part.column("text"), width)
                keys = zip(*(part.column(c).to_pylist() for c in ("leader", "chunk", "member", "node", "large")), strict=True)
                for i, (leader, chunk, member, node, large) in enumerate(keys):
                    if at != (leader, chunk):
                        at, leading = (leader, chunk), []
                    own = sets.of(i)
                    if not member:
                        leading.append(own.copy())
                        continue
                    alike = False
                    for other in leading:
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        alike |= both and 100 * both >= percent * (len(own) + len(other) - both)
                    us.append(leader)
                    vs.append(node)
                    linked.append(bool(alike))
                    if large and len(leading) == 1:
                        own_only.append(np.setdiff1d(own, leading[0], assume_unique=True).view(np.int64))
                        bits = np.zeros(128, np.uint8)
                        bits[(np.setdiff1d(leading[0], own, assume_unique=True) >> np.uint64(57)).astype(np.int64)] = 1
                        missing.append(np.packbits(bits).view(np.int64).tolist())
                    else:
                        own_only.append(None)
                        missing.append([None, None])
            columns = [pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(linked, pa.bool_()), pa.array(own_only, pa.list_(pa.int64()))]
            columns += [pa.array([x[k] for x in missing], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "linked", "rest", "low", "high"])

    return verify


# Bytes of text that are signed together; each of their shingles holds a permutation of the slots,
# two bytes each, and a copy of it while finished texts are taken out.
_SLICE = 1 << 18
# Members that one copy of a leader's text is compared with.
_CHUNK = 64
# Members from which on a group's differences from its leader are worth keeping.
_LARGE = 16
# Leaders of a bucket in the second and each later round, times the same number each time.
_LEADERS = 64


def _compare(pairs: DataFrame, texts: DataFrame, options: Options, rest: bool) -> DataFrame:
    """Exact comparison of the pairs ``leader, node``: ``u, v, linked``, and of large groups ``rest,
    low, high``."""
    # Only large groups are looked up, so that this join is with a short table.
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("group")).where(F.col("group") > _LARGE)
    large = F.lit(rest) & F.col("group").isNotNull()
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("group", F.lit(1)) / F.lit(_CHUNK)))
    pairs = pairs.join(sizes, "leader", "left").select("leader", "node", chunk.alias("chunk"), large.alias("large"))
    pairs = stored(pairs, "chunks")
    members = pairs.join(texts, "node").select("leader", "chunk", F.lit(True).alias("member"), "node", "large", "text")
    leaders = pairs.select("leader", "chunk").distinct().withColumn("node", F.col("leader"))
    leaders = leaders.join(texts, "node").select("leader", "chunk", F.lit(False).alias("member"), "node", F.lit(False).alias("large"), "text")
    rows = leaders.union(members).repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "member")
    return rows.mapInArrow(_verified(options), "u long, v long, linked boolean, rest array<long>, low long, high long")


def _fits(n: str, m: str, percent: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


# What is known of a member from the comparison with its bucket's first leader.
KNOWN = ["size", "own", "shared", "low", "high"]


def _can_meet(percent: int) -> Column:
    """Two members of a bucket, ``x`` and ``y``, can be linked as far as what is known tells.

    Their intersection holds no more than the first leader's shingles that neither lacks, and of
    their other shingles no more than either has that anyone else has as well.
    """
    lacking = F.bit_count(F.col("x.low").bitwiseOR(F.col("y.low"))) + F.bit_count(F.col("x.high").bitwiseOR(F.col("y.high")))
    most = F.col("x.size") - lacking + F.least("x.shared", "y.shared")
    most = F.least(most, F.col("n") - F.col("x.own"), F.col("m") - F.col("y.own"))
    known = F.col("x.size").isNotNull() & F.col("y.size").isNotNull()
    return ~known | (most * (100 + percent) >= (F.col("n") + F.col("m")) * percent)


def _known(compared: DataFrame) -> DataFrame:
    """``leader, node`` and ``KNOWN`` without the leader's ``size``, of large groups.

    ``own``: shingles of the node that nobody else in its leader's group has; ``shared``: those that
    others have, but not the leader. Nodes with several texts are left out.
    """
    rows = compared.where("rest is not null").select(F.col("u").alias("leader"), F.col("v").alias("node"), "rest", "low", "high")
    key = F.xxhash64("leader", "shingle")
    each = rows.select("leader", "node", F.explode("rest").alias("shingle")).select(key.alias("key"), "leader", "node")
    own = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("leader").alias("leader"), F.min("node").alias("node")).where("n = 1")
    own = own.groupBy("leader", "node").agg(F.count(F.lit(1)).alias("own"))
    once = rows.groupBy("leader", "node").agg(
        F.count(F.lit(1)).alias("texts"), F.max(F.size("rest")).alias("rest"), F.max("low").alias("low"), F.max("high").alias("high")
    )
    out = once.where("texts = 1").join(own, ["leader", "node"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return out.select("leader", "node", "own", (F.col("rest") - F.col("own")).alias("shared"), "low", "high")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _linked(classes: DataFrame, members: DataFrame, texts: DataFrame, held: DataFrame, options: Options) -> DataFrame:
    """``node, component`` of the classes, by rounds of comparisons with leaders."""
    spark = classes.sparkSession
    percent = options.percent
    # First round: everyone of a bucket with the smallest node.
    first = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("x"))
    first = stored(first.select("bucket", F.col("x.node").alias("leader"), F.col("x.n").alias("m")), "leaders")
    pairs = members.join(first, "bucket").where((F.col("node") != F.col("leader")) & _fits("n", "m", percent))
    pairs = stored(pairs.select("leader", "node").distinct(), "pairs")
    compared = stored(_compare(pairs, texts, options, True), "compared")
    drop(pairs)
    release(spark)
    labels = components(compared.where("linked").select("u", "v").union(held))
    # Members that are left, with what they share where it is known.
    members = members.join(first, "bucket").where("node <> leader").join(_known(compared), ["leader", "node"], "left")
    size = F.when(F.col("own").isNotNull(), F.col("m")).alias("size")
    members = members.select("bucket", "node", "n", F.struct(size, *KNOWN[1:]).alias("x"))
    members = stored(members, "buckets")
    drop(compared, first)
    most = _LEADERS
    while True:
        now = _labelled(members, labels)
        state = now.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
        now = stored(now.join(state.select("bucket"), "bucket", "left_semi"), "open")
        drop(members)
        release(spark)
        order = Window.partitionBy("bucket").orderBy(F.xxhash64("node", F.lit(most)), "node")
        leaders = now.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        leaders = leaders.select("bucket", F.col("node").alias("leader"), F.col("n").alias("m"), F.col("x").alias("y"), F.col("label").alias("other"))
        leaders = stored(leaders, "leaders")
        # Nodes and leaders meet once; where both lead, the smaller one is the leader of the pair.
        members = now.join(leaders.select("bucket", F.col("leader").alias("node"), F.lit(True).alias("leads")), ["bucket", "node"], "left")
        fits = (F.col("label") != F.col("other")) & _fits("n", "m", percent) & _can_meet(percent)
        pairs = members.join(leaders, "bucket").where(fits & (F.col("leads").isNull() | (F.col("leader") < F.col("node"))))
        pairs = stored(pairs.select("leader", "node").distinct(), "pairs")
        if not pairs.isEmpty():
            compared = stored(_compare(pairs, texts, options, False), "compared")
            labels = components(compared.where("linked").select("u", "v").union(labels.toDF("u", "v")))
            drop(compared)
        # A leader has met everyone in its bucket.
        members = stored(members.where("leads is null").select("bucket", "node", "n", "x"), "buckets")
        drop(now, leaders, pairs)
        if members.isEmpty():
            return labels
        most *= _LEADERS


def _grouped(docs: DataFrame, options: Options, apart: bool) -> DataFrame:
    """``doc_id, n, digest, node, component`` of every row.

    The node of a row is its id. With ``apart``, rows of one id whose sets differ are nodes of their
    own, named by a hash.
    """
    found = docs.select("doc_id", _signature(options)(F.col("text")).alias("s"))
    signed = stored(found.select("doc_id", "s.*"), "signatures")
    linked = signed.where("n > 0 and doc_id is not null")
    several = linked.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    several = stored(several.select("doc_id"), "several")
    own = F.xxhash64("doc_id", "digest")
    if apart:
        marked = linked.join(several.withColumn("several", F.lit(True)), "doc_id", "left")
        linked = marked.withColumn("node", F.when(F.col("several"), own).otherwise(F.col("doc_id"))).drop("several")
    else:
        linked = linked.withColumn("node", F.col("doc_id"))
    classes = linked.groupBy("digest").agg(F.min("node").alias("node"), F.max("n").alias("n"), F.any_value("bands").alias("bands"))
    classes = stored(classes, "classes")
    keyed = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = stored(keyed.join(shared, "bucket", "left_semi"), "buckets")
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    if apart:
        again = docs.join(several, "doc_id", "left_semi").select("doc_id", "text", _signature(options)(F.col("text")).getField("digest").alias("digest"))
        texts = texts.union(again.select(own.alias("node"), "text"))
    texts = stored(texts.join(members.select("node").distinct(), "node", "left_semi"), "texts")
    release(docs.sparkSession)
    # A document with several texts holds their classes together.
    both = linked.join(several, "doc_id", "left_semi").join(classes.select("digest", F.col("node").alias("v")), "digest")
    held = both.select(F.col("node").alias("u"), "v")
    labels = _linked(classes, members, texts, held, options)
    drop(texts)
    named = _labelled(classes.select("digest", "node"), labels).select("digest", F.col("label").alias("component"))
    out = linked.join(named, "digest").select("doc_id", "n", "digest", "node", "component")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "n", "digest", F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    return out.union(alone)


def group(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    out = _grouped(docs, options, False)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def drop_copies(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """One row of each group of near duplicates, with all its columns; rows without an id stay."""
    out = stored(_grouped(docs.select("doc_id", "text"), options, True), "groups").where("doc_id is not null")
    kept = out.where("node = component").select("doc_id", "digest").distinct()
    # Ids whose rows have more than one set need the set to tell which of them stay.
    mixed = out.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    mixed = stored(mixed, "mixed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.where("doc_id is not null").select("doc_id", row)
    plain = named.join(kept.join(mixed, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    odd = named.join(mixed, "doc_id", "left_semi")
    odd = odd.withColumn("digest", _signature(options)(F.col("row.text")).getField("digest"))
    odd = odd.join(kept, ["doc_id", "digest"], "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.xxhash64("row.text")))
    one = plain.withColumn("digest", F.lit(None).cast("binary")).union(odd.select("doc_id", "row", "digest"))
    return one.withColumn("place", place).where("place = 1").select("row.*").unionByName(docs.where("doc_id is null"))
