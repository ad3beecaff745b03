"""Sampled SentencePiece segmentations without replacement, and their decoding.

The probability of a segmentation is proportional to the product of its pieces' weights. All
segmentations of a text form a tree, one piece per level. A subtree's largest Gumbel-perturbed log
probability has a known law given that of its parent, so a best-first (A*) search that always opens
the subtree with the largest bound meets the k largest leaves in order, and these are a sample of k
distinct segmentations without replacement. The bounds are exact, so the search walks straight to
each leaf; what it leaves aside on its way are the subtrees that differ from the leaf first at one
of its pieces, and those are its open list.

The lattice is cut at blanks, since no piece has a blank inside: forward sums are computed once per
distinct word and kept in a bounded cache, which stays with the most frequent words when it makes room,
and the walks of all texts of a slice are made together.
Every draw is a hash of the row's key and its place, so results don't depend on partitions.

Characters outside the vocabulary are their UTF-8 bytes, and so is U+2581 in a text, which would
otherwise read as a blank. Decoding gives back every text exactly.

Defined results
* null text: no segmentation, one row of rank 1 with null ``ids``.
* empty text: the one segmentation of a lone blank mark, which decodes to the empty text.
* fewer than k segmentations: all of them, with inclusion 1.
* null key: as any other key. Repeated rows get equal samples, as do equal keys with equal texts.
* other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.words import mix, slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_GOLD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


@dataclass(frozen=True)
class Options:
    """``samples``: k. ``power``: exponent on the pieces' weights; 0 makes all segmentations alike.
    ``nodes``: bound on the lattice nodes of the words that a worker keeps."""

    model: str = MODEL
    samples: int = 2
    power: float = 0.5
    nodes: int = 600_000
    seed: int = 3


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log weights; byte pieces and pieces of several blanks take no part in lattices."""

    pieces: list[str]
    weights: np.ndarray  # nan: not in lattices
    bytes_at: int  # id of the piece of byte 0


def vocabulary(options: Options = Options()) -> Vocabulary:
    """Pieces of the model file, read on the driver. Files of merges rank pieces and give no
    probability; a piece of rank r then weighs 1 / (r + 10), as ranked words do."""
    model = sentencepiece.SentencePieceProcessor(model_file=options.model)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    weights = np.full(len(pieces), np.nan)
    for i, piece in enumerate(pieces):
        special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        if not special and BLANK not in piece[1:]:
            weights[i] = -options.power * np.log(10 - min(model.get_score(i), 0))
    return Vocabulary(pieces, weights, pieces.index("<0x00>"))


class Lattices:
    """Lattices of distinct words with forward sums. A node is a place in a word; its edges are the
    pieces that fit there, longest first, with their probability given that the node is passed.

    Nodes and edges lie in the order of the words' numbers, in arrays with room for more."""

    def __init__(self, words: Vocabulary, options: Options):
        self.v, self.o = words, options
        taking = np.flatnonzero(~np.isnan(words.weights))
        self.unknown = float(np.nanmin(words.weights)) - 5.0
        self.weight = np.append(np.where(np.isnan(words.weights), self.unknown, words.weights), self.unknown)
        # Open addressing over hashes of all pieces and their beginnings. The value of a piece is twice
        # its id, and one more where longer ones begin with it; -1 is a beginning only, -2 is nothing.
        texts = [words.pieces[i] for i in taking]
        marks = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at, h, ids = np.cumsum(sizes) - sizes, np.zeros(len(texts), np.uint64), taking
        self.longest = int(sizes.max())
        hashes, values = [], []
        for n in range(1, self.longest + 1):
            h = _hashed_on(h, marks[at + n - 1])
            whole = sizes == n
            hashes += [h[whole], h[~whole]]
            values += [2 * ids[whole], np.full(len(h) - whole.sum(), -1)]
            at, h, ids, sizes = at[~whole], h[~whole], ids[~whole], sizes[~whole]
        hashes, values = np.concatenate(hashes), np.concatenate(values)
        keys, which = np.unique(hashes, return_inverse=True)
        value, longer = np.full(len(keys), -1), np.zeros(len(keys), bool)
        value[which[values >= 0]] = values[values >= 0]
        longer[which[values < 0]] = True
        value += longer & (value >= 0)
        self.bits = max(16, len(keys).bit_length() + 2)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int32)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.values[at[left]] == -2]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.values[at[free]] = keys[free], value[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.first = np.zeros(1, np.int64)
        self.base, self.size, self.uses = (np.empty(0, np.int64) for _ in range(3))
        self.cum, self.log = np.empty(0, np.float32), np.empty(0, np.float32)
        self.piece, self.step = np.empty(0, np.int32), np.empty(0, np.int16)
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())  # by number
        self.rare: dict[str, int] = {}  # characters of several bytes
        self.nodes = self.edges = 0

    def _room(self, names: tuple[str, ...], most: int) -> None:
        for name in names:
            was = getattr(self, name)
            if len(was) < most:
                now = np.empty(max(most, len(was) * 3 // 2), was.dtype)
                now[: len(was)] = was
                setattr(self, name, now)

    def _look(self, hashes: np.ndarray) -> np.ndarray:
        """The values of beginnings of pieces."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values.take(at)
        going = np.flatnonzero((out != -2) & (self.keys.take(at) != hashes))
        while len(going):
            at[going] = (at[going] + 1) & ((1 << self.bits) - 1)
            out[going] = self.values[at[going]]
            going = going[(out[going] != -2) & (self.keys[at[going]] != hashes[going])]
        return out

    def add(self, words: pa.Array) -> None:
        """Lattices of words that are not there yet."""
        chars = np.frombuffer(text_bytes(words)[0].tobytes().decode().encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        end = np.cumsum(sizes)
        stop = np.repeat(end, sizes)
        marks, inside = np.full(end[-1], ord(BLANK), np.uint64), np.ones(end[-1], bool)
        inside[end - sizes] = False
        # A blank mark that a word itself contains is not a blank.
        marks[inside] = np.where(chars == ord(BLANK), np.uint32(0xFFFFFFFF), chars)
        at, h = np.arange(len(marks)), np.zeros(len(marks), np.uint64)
        found = []
        many = np.ones(len(marks), np.int64)  # every node has an edge of one character
        for n in range(1, self.longest + 1):
            value = self._look(h := _hashed_on(h, marks.take(at + (n - 1))))
            hit = np.flatnonzero(value >= 0)
            src, piece = at.take(hit), value.take(hit) >> 1
            if n > 1:
                many[src] += 1
                found.append((n, src, piece))
            else:
                single = np.full(len(marks), -1, np.int32)
                single[src] = piece
                lost = np.flatnonzero(single < 0)
                single[lost] = self._spelled(marks[lost])
            on = np.flatnonzero((value & 1 == 1) & (at + n < stop.take(at)))
            at, h = at.take(on), h.take(on)
            if not len(at):
                break
        # Edges by node, the longest first.
        first = np.concatenate(([0], np.cumsum(many)))
        piece, length = np.empty(first[-1], np.int32), np.ones(first[-1], np.int16)
        put = first[:-1].copy()
        for n, src, own in found[::-1]:
            to = put.take(src)
            piece[to], length[to] = own, n
            put[src] = to + 1
        piece[put] = single
        # An edge to an end leads to the sum behind all nodes, which stays 0.
        weight = self.weight.take(np.maximum(piece, -1), mode="wrap")
        to = np.repeat(np.arange(len(marks)), many) + length
        to[to == np.repeat(stop, many)] = len(marks)
        # Sums from the ends of the words backwards.
        left = (stop - np.arange(len(marks))).astype(np.int32)
        nodes = np.argsort(left.astype(np.int16) if left.max() < 1 << 15 else left, kind="stable")
        many_left = many[nodes]
        starts = np.concatenate(([0], np.cumsum(many_left)))
        by_left = np.arange(len(to)) + np.repeat(first[nodes] - starts[:-1], many_left)
        total = np.zeros(len(marks) + 1)
        w, goal = weight.take(by_left), to.take(by_left)
        bounds = np.searchsorted(left[nodes], np.arange(1, left.max() + 2))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            a, b = starts[x], starts[y]
            value = w[a:b] + total.take(goal[a:b])
            cut = starts[x:y] - a
            most = np.maximum.reduceat(value, cut)
            value -= np.repeat(most, many_left[x:y])
            total[nodes[x:y]] = most + np.log(np.add.reduceat(np.exp(value, out=value), cut))
        log = weight + total.take(to)
        log -= np.repeat(total[:-1], many)
        cum = np.cumsum(np.exp(log))
        cum -= np.repeat(np.concatenate(([0.0], cum)).take(first[:-1]), many)
        cum[first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        a, b, n = self.nodes, self.edges, len(self.words)
        self.nodes, self.edges = a + len(marks), b + len(to)
        self._room(("first",), self.nodes + 1)
        self._room(("cum", "log", "piece", "step"), self.edges)
        self._room(("base", "size", "uses"), n + len(words))
        self.first[a : self.nodes + 1] = first + b
        self.cum[b : self.edges], self.log[b : self.edges] = cum, np.minimum(log, 0.0)
        self.piece[b : self.edges], self.step[b : self.edges] = piece, length
        self.base[n : n + len(words)], self.size[n : n + len(words)] = end - sizes + a, sizes
        self.uses[n : n + len(words)] = 0
        self.words = pa.concat_arrays([self.words, words])

    def _spelled(self, marks: np.ndarray) -> np.ndarray:
        """Byte pieces of characters that no piece has; several bytes are a number below 0."""
        out = np.empty(len(marks), np.int32)
        plain = marks < 128
        out[plain] = self.v.bytes_at + marks[plain].astype(np.int64)
        chars, which = np.unique(marks[~plain], return_inverse=True)
        named = [BLANK if x == 0xFFFFFFFF else chr(x) for x in chars.tolist()]
        out[~plain] = np.array([-1 - self.rare.setdefault(x, len(self.rare)) for x in named], np.int32)[which]
        return out

    def spelled(self) -> list[list[int]]:
        """The byte pieces that the numbers below 0 stand for, from -1 downwards."""
        return [[self.v.bytes_at + b for b in x.encode("utf-8", "surrogatepass")] for x in self.rare]

    def _forget(self) -> None:
        """Keeps the words met most often, in half of the nodes; older meetings count less."""
        n = len(self.words)
        size, uses = self.size[:n], self.uses[:n]
        order = np.argsort(-uses, kind="stable")
        held = np.zeros(n, bool)
        held[order[: np.searchsorted(np.cumsum(size[order]), self.o.nodes // 2, "right")]] = True
        held &= uses > 1
        if len(self.rare) > self.o.nodes // 10:
            held[:] = False
            self.rare = {}
        many = np.diff(self.first[: self.nodes + 1])
        node = np.repeat(held, size)
        edge = np.flatnonzero(np.repeat(node, many))
        for name in ("cum", "log", "piece", "step"):
            kept = getattr(self, name).take(edge)
            if self.nodes > 2 * self.o.nodes:  # the room that a very long text has taken goes as well
                setattr(self, name, kept)
            else:
                getattr(self, name)[: len(edge)] = kept
        size, uses, many = size[held], uses[held], many[node]
        self.nodes, self.edges = len(many), len(edge)
        self.first[1 : self.nodes + 1] = np.cumsum(many)
        self.base[: len(size)], self.size[: len(size)] = np.cumsum(size) - size, size
        self.uses[: len(size)] = uses // 2
        self.words = self.words.filter(pa.array(held))

    def numbers(self, words: pa.Array, times: np.ndarray) -> np.ndarray:
        """The lattice numbers of distinct words that are met some times each, most of them known."""

        def known() -> np.ndarray:
            return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

        out = known()
        if self.nodes > self.o.nodes and (out < 0).any():
            self._forget()
            out = known()
        missing = np.flatnonzero(out < 0)
        if len(missing):
            out[missing] = np.arange(len(missing)) + len(self.words)
            self.add(words.take(pa.array(missing)))
        self.uses[out] += times
        return out


def _hashed_on(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Hashes of texts with one more character."""
    out = (hashes + marks + np.uint64(1)) * np.uint64(_GOLD)
    out ^= out >> np.uint64(29)
    return out


def _uniform(keys: np.ndarray) -> np.ndarray:
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _walk(t: Lattices, node: np.ndarray, stop: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples from nodes to the ends of their words: number of edges per start, and the edges."""
    count = np.zeros(len(node), np.int64)
    active, steps = np.flatnonzero(node < stop), []
    j = 0
    at, end, key = node[active], stop[active], keys[active]
    while len(active):
        edge = t.first.take(at)
        u = _uniform(key + np.uint64(j * 0xD1B54A32D192ED03 & _M64))
        more = np.flatnonzero(u >= t.cum.take(edge))
        v = u[more]
        while len(more):
            edge[more] = further = edge[more] + 1
            over = np.flatnonzero(v >= t.cum.take(further))
            more, v = more[over], v[over]
        steps.append((active, edge))
        count[active] += 1
        at += t.step.take(edge)
        on = np.flatnonzero(at < end)
        active, at, end, key = active[on], at[on], end[on], key[on]
        j += 1
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for j, (who, edge) in enumerate(steps):
        out[begin[who] + j] = edge
    return count, out


def _gumbel_below(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of log masses, given that they lie below ``top``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = mass - np.log(np.exp(mass - top) - np.log(u))
    return np.where(np.isneginf(mass), -np.inf, out)


@dataclass
class _Path:
    """One found segmentation of each text: its edges, and the open subtrees beside it, which part from it
    at some of them. A place with one edge parts nowhere, and places up to the path's own parting belong to
    the path that it left."""

    first: np.ndarray  # texts + 1
    edge: np.ndarray
    ends: np.ndarray  # words + 1, where the edges of the words begin
    open_first: np.ndarray  # texts + 1
    at: np.ndarray  # where the open subtrees part, in ``edge``
    before: np.ndarray  # log probability of the edges before
    open: np.ndarray  # perturbed bounds
    log: np.ndarray  # per text
    top: np.ndarray  # per text, the path's own perturbed value
    there: np.ndarray  # per text


def _opened(t: Lattices, first, edge, ends, since, log0, top, there, keys) -> _Path:
    log = t.log.take(edge)
    run = np.cumsum(log, dtype=np.float64)
    ran = np.concatenate(([0.0], run))
    begin, end = ran[first[:-1]], ran[first[1:]]
    # The only edge of a node has log 0.
    at = np.flatnonzero(log < 0)
    text = np.repeat(np.arange(len(first) - 1), np.diff(np.searchsorted(at, first)))
    place = at - first.take(text)
    if (since >= 0).any():
        later = place > since.take(text)
        at, text, place = at[later], text[later], place[later]
    own = log.take(at).astype(np.float64)
    before = run.take(at)
    before -= own
    before -= begin.take(text)
    mass = before + np.log(-np.expm1(own))
    place = place.astype(np.uint64)
    place += np.uint64(1)
    place *= np.uint64(0x8CB92BA72F3D8DD7)
    place += keys.take(text)
    bound = _gumbel_below(mass, top.take(text), _uniform(place))
    open_first = np.searchsorted(text, np.arange(len(first)))
    return _Path(first, edge, ends, open_first, at, before, bound, np.where(there, end - begin, log0), top, there)


def _best(path: _Path) -> tuple[np.ndarray, np.ndarray]:
    """The largest open bound of each text, and its place among the open ones."""
    rows = len(path.first) - 1
    value, at = np.full(rows, -np.inf), np.zeros(rows, np.int64)
    many = np.diff(path.open_first)
    full = np.flatnonzero(many)
    if len(full):
        most = np.maximum.reduceat(path.open, path.open_first[:-1][full])
        value[full] = most
        where = np.flatnonzero(path.open == np.repeat(most, many[full]))
        text = np.searchsorted(path.open_first, where, "right") - 1
        at[text[::-1]] = where[::-1]
    return value, at


def _words_of(texts: pa.Array | list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text, distinct words, and which of them every word is."""
    column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    parts = pc.split_pattern(column, " ")
    words = parts.flatten().dictionary_encode()
    return pc.list_value_length(parts).to_numpy().astype(np.int64), words.dictionary, words.indices.to_numpy()


def sampled(t: Lattices, texts: pa.Array | list[str], keys: np.ndarray) -> tuple[list[_Path], np.ndarray]:
    """The paths of rank 1 to k, and each text's largest bound beyond them."""
    k = t.o.samples
    many, words, which = _words_of(texts)
    first_word = np.concatenate(([0], np.cumsum(many)))
    number = t.numbers(words, np.bincount(which, minlength=len(words))).take(which)
    start = t.base.take(number)
    stop = start + t.size.take(number)
    of = np.repeat(np.arange(len(texts)), many)
    nth = (np.arange(len(number)) - first_word[of]).astype(np.uint64)

    def word_keys(rank: int) -> np.ndarray:
        return mix(keys + np.uint64(rank * _GOLD & _M64))[of] + nth * np.uint64(0xA24BAED4963EE407)

    def text_keys(rank: int, use: int) -> np.ndarray:
        return mix(keys + np.uint64((rank * 16 + use + 1) * 0xE7037ED1A0B428DB & _M64))

    everywhere = np.ones(len(texts), bool)
    count, edge = _walk(t, start, stop, word_keys(0))
    top = -np.log(-np.log(_uniform(text_keys(0, 0))))
    ends = np.concatenate(([0], np.cumsum(count)))
    none = np.full(len(texts), -1)
    paths = [_opened(t, ends[first_word], edge, ends, none, np.zeros(len(texts)), top, everywhere, text_keys(0, 1))]
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # path, place, edge of each round
    for rank in range(1, k):
        found = [_best(p) for p in paths]
        values = np.array([value for value, _ in found])
        parent = values.argmax(0)
        top = values.max(0)
        there = top > -np.inf
        place = np.array([at for _, at in found])[parent, np.arange(len(texts))]
        rows = np.flatnonzero(there)
        if not len(rows):
            break
        # The parting, a place of its parent: another edge of the node, none that the node has already given.
        old = np.zeros(len(texts), np.int64)
        at_word = np.zeros(len(texts), np.int64)
        prefix = np.zeros(len(texts), np.int64)
        for i, p in enumerate(paths):
            own = rows[parent[rows] == i]
            at = p.at[place[own]]
            old[own], prefix[own] = p.edge[at], at - p.first[own]
            at_word[own] = np.searchsorted(p.ends, at, "right") - 1
        node = np.searchsorted(t.first[: t.nodes + 1], old[rows], "right") - 1
        barred = [old[rows]]
        for was, where, gave in taken:
            same = (was[rows] == parent[rows]) & (where[rows] == place[rows])
            barred.append(np.where(same, gave[rows], -1))
        begin, end = t.first[node], t.first[node + 1]
        left = np.zeros(len(rows))
        widest = int((end - begin).max())
        for pick in (False, True):
            if pick:
                goal = _uniform(text_keys(rank, 2))[rows] * left
                left, new = np.zeros(len(rows)), np.full(len(rows), -1, np.int64)
            for j in range(widest):
                e = np.minimum(begin + j, end - 1)
                free = (begin + j < end) & ~np.any([e == b for b in barred], axis=0)
                left = left + np.where(free, np.exp(t.log[e]), 0.0)
                if pick:
                    new = np.where(free & ((new < 0) | (goal >= left - np.exp(t.log[e]))), e, new)
        gave, at_node = np.full(len(texts), -1, np.int64), np.zeros(len(texts), np.int64)
        gave[rows], at_node[rows] = new, node
        # What the node still holds stays open below the new leaf.
        rest = np.zeros(len(rows))
        for j in range(widest):
            e = np.minimum(begin + j, end - 1)
            free = (begin + j < end) & ~np.any([e == b for b in [*barred, new]], axis=0)
            rest += np.where(free, np.exp(t.log[e]), 0.0)
        u = _uniform(text_keys(rank, 3))[rows]
        for i, p in enumerate(paths):
            own = parent[rows] == i
            with np.errstate(divide="ignore"):
                mass = p.before[place[rows[own]]] + np.log(rest[own])
            p.open[place[rows[own]]] = _gumbel_below(mass, top[rows[own]], u[own])
        taken.append((np.where(there, parent, -1), place, gave))
        # Fresh walks for the rest of the word and for all words after it.
        from_word = np.where(there, at_word, first_word[1:])
        again = np.flatnonzero(np.arange(len(number)) >= from_word[of])
        begin_at = start[again].copy()
        held = again == at_word[of[again]]
        held_text = of[again][held]
        begin_at[held] = at_node[held_text] + t.step[gave[held_text]]
        count, fresh = _walk(t, begin_at, stop[again], word_keys(rank)[again])
        count_of = np.zeros(len(number), np.int64)
        for i, p in enumerate(paths):
            own = np.flatnonzero((there & (parent == i))[of] & (np.arange(len(number)) <= at_word[of]))
            count_of[own] = p.ends[own + 1] - p.ends[own]
        for i, p in enumerate(paths):
            own = rows[parent[rows] == i]
            count_of[at_word[own]] = p.first[own] + prefix[own] + 1 - p.ends[at_word[own]]
        count_of[again] += count
        ends = np.concatenate(([0], np.cumsum(count_of)))
        first = ends[first_word]
        # The parent's edges up to the parting, the new edge, the fresh ones.
        sizes = np.stack((prefix, there, np.diff(first) - prefix - there), 1)
        kind = np.repeat(np.stack((parent + 2, 0 * parent, 0 * parent + 1), 1).astype(np.int16).ravel(), sizes.ravel())
        edge = np.empty(first[-1], np.int64)
        edge[kind == 0], edge[kind == 1] = new, fresh
        for i, p in enumerate(paths):
            n = np.where(there & (parent == i), prefix, 0)
            kept = np.repeat(np.tile([True, False], len(texts)), np.stack((n, np.diff(p.first) - n), 1).ravel())
            edge[kind == i + 2] = p.edge[kept]
        paths.append(_opened(t, first, edge, ends, prefix, np.full(len(texts), -np.inf), top, there, text_keys(rank, 1)))
    bound = np.max([_best(p)[0] for p in paths], axis=0)
    return paths, bound


def _ids(t: Lattices, edges: np.ndarray) -> np.ndarray:
    return _ids_of(t, edges, np.array([0, len(edges)]))[0]


def _ids_of(t: Lattices, edges: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the edges of texts, and where the texts begin among them."""
    ids = t.piece.take(edges)
    low = np.flatnonzero(ids < 0)
    if not len(low):
        return ids, first
    spelled = t.spelled()
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    table = np.zeros((len(spelled), 4), np.int32)
    table[np.arange(4) < sizes[:, None]] = [x for own in spelled for x in own]
    char = -1 - ids[low]
    many = np.ones(len(ids), np.int64)
    many[low] = sizes[char]
    begin = np.concatenate(([0], np.cumsum(many)))
    ids = np.repeat(ids, many)
    for j in range(4):
        on = sizes[char] > j
        ids[begin[low[on]] + j] = table[char[on], j]
    return ids, begin[first]


SAMPLED = "doc_id long, rank int, ids binary, n_pieces long, log_prob double, perturbed double, inclusion double, log_inclusion double"


DIGESTS = "doc_id long, rank int, ids_sha256 string, text_sha256 string, n_pieces long, log_prob double, perturbed double, inclusion double, log_inclusion double"


def _decoder(words: Vocabulary):
    table = [x.replace(BLANK, " ").encode() for x in words.pieces]
    table[words.bytes_at : words.bytes_at + 256] = [bytes([b]) for b in range(256)]
    table = pa.array(table, pa.large_binary())

    def decode(column: pa.Array) -> list[memoryview | None]:
        """Texts of a column of ids; the blank before the first word goes."""
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        first = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 4 if len(column) else np.zeros(1, np.int64)
        ids = np.frombuffer(data, "<i4", first[-1])[first[0] :] if data else np.empty(0, np.int32)
        _, offsets, data = table.take(pa.array(ids, pa.int32())).buffers()
        marks = memoryview(data) if data else memoryview(b"")
        at = np.frombuffer(offsets, np.int64)[first - first[0]].tolist()
        return [marks[a + 1 : b] if x else None for x, a, b in zip(column.is_valid().to_pylist(), at[:-1], at[1:], strict=True)]

    return decode


# Bytes of text whose lattices are in memory together.
_SLICE = 1 << 18


def sample(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Up to k distinct segmentations of every text, by falling perturbed log probability.

    ``ids`` are little-endian 4-byte numbers. ``inclusion`` is the probability that a segmentation
    is above the first bound left out; one over it weighs the sample. Of long texts it may be too
    small for a number, so its logarithm is given as well.
    """
    words = vocabulary(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(words, options)
        for batch in batches:
            for a, b in slices(batch.column(1), _SLICE):
                yield _sampled_rows(lattices, batch.slice(a, b - a), options)

    return docs.select("doc_id", "text").mapInArrow(run, SAMPLED)


def _sampled_rows(t: Lattices, batch: pa.RecordBatch, options: Options) -> pa.RecordBatch:
    valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    there, lost = np.flatnonzero(valid), np.flatnonzero(~valid)
    row, rank, ids = [lost], [np.ones(len(lost), np.int32)], [None] * len(lost)
    figures = [np.zeros((5, len(lost)))]  # pieces, log_prob, perturbed, inclusion, log_inclusion
    if len(there):
        doc = batch.column(0).to_pylist()
        keys = np.array([xxhash.xxh3_64_intdigest(repr(doc[i]), seed=options.seed) for i in there.tolist()], np.uint64)
        paths, bound = sampled(t, batch.column(1).drop_null(), keys)
        for n, p in enumerate(paths, 1):
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                share = np.where(np.isneginf(bound), 1.0, -np.expm1(-np.exp(p.log - bound)))
                log_share = np.where(p.log - bound < -30, p.log - bound, np.log(share))
            own, first = _ids_of(t, p.edge, p.first)
            own, on = own.astype("<i4", copy=False), np.flatnonzero(p.there)
            ids += [own[a:b].tobytes() for a, b in zip(first[on].tolist(), first[on + 1].tolist(), strict=True)]
            row.append(there[on])
            rank.append(np.full(len(on), n, np.int32))
            figures.append(np.stack((np.diff(first), p.log, p.top, share, log_share))[:, on])
    row, rank, figures = np.concatenate(row), np.concatenate(rank), np.concatenate(figures, 1)
    order = np.lexsort((rank, row))
    row, figures = row[order], figures[:, order]
    columns = [
        batch.column(0).take(pa.array(row)).cast(pa.int64()),
        pa.array(rank[order], pa.int32()),
        pa.array([ids[i] for i in order.tolist()], pa.binary()),
        pa.array(figures[0].astype(np.int64)),
        *(pa.array(x, pa.float64(), mask=~valid[row]) for x in figures[1:]),
    ]
    names = ["doc_id", "rank", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "log_inclusion"]
    return pa.RecordBatch.from_arrays(columns, names)


def decoded(ids: Column, options: Options = Options()) -> Column:
    """The texts of id columns as ``sample`` gives them; null stays null."""
    decode = _decoder(vocabulary(options))

    @F.arrow_udf("string")
    def read(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else str(x, "utf-8", "replace") for x in decode(column)], pa.string())

    return read(ids)


def encoded(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """The samples with digests of the ids and of the text that they decode to, made where the ids
    are, so that only the digests leave the workers."""
    words = vocabulary(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, decode = Lattices(words, options), _decoder(words)
        for batch in batches:
            for a, b in slices(batch.column(1), _SLICE):
                rows = _sampled_rows(lattices, batch.slice(a, b - a), options)
                ids = [x.as_buffer() for x in rows.column(2)]
                digests = [None if x is None else hashlib.sha256(x).hexdigest() for x in ids]
                texts = [None if x is None else hashlib.sha256(x).hexdigest() for x in decode(rows.column(2))]
                columns = [rows.column(0), rows.column(1), pa.array(digests, pa.string()), pa.array(texts, pa.string()), *rows.columns[3:]]
                names = ["doc_id", "rank", "ids_sha256", "text_sha256", *rows.schema.names[3:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
