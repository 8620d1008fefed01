"""Near copies of records (problem 3).

A record is the set of its distinct word runs. Its fingerprint has 128 slots: the smallest value of the set
under each of 128 hash functions. Two sets with Jaccard similarity s agree in a slot with probability s.

The index over the fingerprints is a hierarchy. Its uppermost nodes are the bit patterns under fixed masks, each of a few whole
slots (``layout``); a pair is looked for wherever it shares such a pattern. Inside a node the fingerprints,
narrowed to four bits a slot, stand in the order of their Gray rank, which brings similar ones together.
Runs of neighbours form a node that holds the bits common to all below it, and a search adds up the
differences from node to node and leaves a whole group as soon as they exceed the bound.

What the search finds is checked exactly on the sets of word runs. Copies with the same set
are one class and take part once.

Misses: masks and bound follow from the threshold, so that a pair at the threshold shares no pattern or exceeds the
bound of differences with probability ``miss`` at most, by the exact binomials; both fall quickly above it. At 0.8 and
1e-6 these are 32 patterns of four slots and the bound that ``layout`` finds.

Defined results: null texts and texts with fewer words than a run have no neighbours; all pairs of a class
of equal sets come out, unless ``expand`` asks for larger classes to be linked to their smallest member only; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage, spread
from ..operators.components import connected_components
from .numtext import mix64, slices
from .spans import _emit, _ROWS, _shared

SLOTS = 128
#: Children of a node; nodes with no more rows are compared directly.
LEAF = 8
#: Runs of words that are hashed at once, and characters of the texts that are taken together.
RUNS, BLOCK = 20_000, 250_000
#: UTF-16 units up to which words are hashed in columns; longer ones are hashed one by one.
LONG = 128
_WORD = re.compile(r"[^\W_]+")
#: Bits of a number that the first 0 … 4 units of it fill.
_FILL = np.array([(1 << 16 * k) - 1 for k in range(5)], np.uint64)
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 32, SLOTS, np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SLOTS, np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each UTF-16 unit is a code point that belongs to words, as ``_WORD`` has it."""
    out = np.zeros(0x10000, bool)
    for m in _WORD.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and how many words each text has.

    Words are found in UTF-16 units and hashed four units at a time, all words of one length together.
    """
    parts = [((t or "").lower() + "\n").encode("utf-16-le", "surrogatepass") for t in texts]
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) >> 1
    data = b"".join(parts) + bytes(8)
    n = (len(data) >> 1) - 4
    units = np.frombuffer(data, "<u2", n)
    inside = np.zeros(n + 1, bool)
    np.take(_letters(), units, out=inside[1:], mode="clip")
    high = np.flatnonzero(units & np.uint16(0xFC00) == 0xD800)
    high = high[units[high + 1] & np.uint16(0xFC00) == 0xDC00]
    if len(high):
        point, at = np.unique(0x10000 + ((units[high].astype(np.int64) & 0x3FF) << 10) + (units[high + 1] & np.uint16(0x3FF)), return_inverse=True)
        inside[high + 1] = inside[high + 2] = np.array([bool(_WORD.match(chr(c))) for c in point.tolist()])[at]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, size = edges[::2], edges[1::2] - edges[::2]
    four = np.ndarray(n, "<u8", data, strides=(2,))
    h = mix64(four[begin] & _FILL[np.minimum(size, 4)])
    at, k = np.flatnonzero((size > 4) & (size <= LONG)), 4
    while len(at):
        h[at] = mix64(h[at] + (four[begin[at] + k] & _FILL[np.minimum(size[at] - k, 4)]))
        k += 4
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[2 * begin[i] : 2 * (begin[i] + size[i])])
    return h, np.diff(np.searchsorted(begin, stops), prepend=0)


class Shingler:
    """Texts to sorted arrays of the distinct 64-bit hashes of their word runs."""

    def __init__(self, words: int) -> None:
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets([text])[0]

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of all texts in a row, and where each begins (one entry more than texts)."""
        w, count = _words(texts)
        last = self.words - 1
        h = mix64(w[: max(0, len(w) - last)])
        with np.errstate(over="ignore"):
            for k in range(1, self.words):
                h = mix64(h + w[k : k + len(h)])
        owner = np.repeat(np.arange(len(texts)), count)
        # runs that lie in one text
        h = h[owner[: len(h)] == owner[last:]]
        starts = np.concatenate(([0], np.cumsum(np.maximum(count - last, 0))))
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            h[lo:hi].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[starts[:-1][starts[:-1] < len(h)]] = True
        return h[new], np.concatenate(([0], np.cumsum(new)))[starts]


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Smallest value of each set under each of the hash functions: uint32[sets, SLOTS]. The sets stand in a row and none is empty."""
    out = np.empty((len(starts) - 1, SLOTS), np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < len(out):
        # as many sets as stay in the cache, or one
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + RUNS, "right")) - 1)
        part, at = x[starts[lo] : starts[hi]], starts[lo:hi] - starts[lo]
        room = np.empty_like(part)
        for k in range(SLOTS):
            np.multiply(part, _MUL[k], out=room)
            room += _ADD[k]
            out[lo:hi, k] = np.minimum.reduceat(room, at)
        lo = hi
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """``signatures`` of one set (uint32[SLOTS])."""
    return signatures(shingles, np.array([0, len(shingles)]))[0]


def bits_tail(similarity: float) -> np.ndarray:
    """P(more than k of the narrowed bits differ) for k = 0 … 4 * SLOTS, at this similarity.

    A slot differs with 1 - similarity and then each of its four bits with one half.
    """
    slot = (1 - similarity) * np.array([math.comb(4, k) / 16 for k in range(5)])
    slot[0] += similarity
    p = np.ones(1)
    for _ in range(SLOTS):
        p = np.convolve(p, slot)
    return np.append(np.cumsum(p[::-1])[::-1][1:], 0.0)


def layout(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(slots of a mask, bound of differing bits): a pair at the threshold is missed with probability ``miss`` at most, half of it by each."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("the index is laid out for similarities from 0.5 to 1")
    fit = [k for k in range(1, SLOTS + 1) if (1 - threshold**k) ** (SLOTS // k) <= miss / 2]
    if not fit:
        raise ValueError(f"no masks over {SLOTS} slots miss only {miss} at similarity {threshold}")
    return max(fit), int(np.argmax(bits_tail(threshold) <= miss / 2))


def band_keys(sigs: np.ndarray, band: int) -> np.ndarray:
    """The patterns under the masks of the uppermost nodes, each of ``band`` slots: uint64[rows, SLOTS // band]."""
    bands = SLOTS // band
    h = np.zeros((len(sigs), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(band):
            h = mix64(h + sigs[:, k : bands * band : band].astype(np.uint64))
    return h


def narrow(sigs: np.ndarray) -> np.ndarray:
    """Four mixed bits of each slot, as uint64[rows, SLOTS * 4 / 64]."""
    with np.errstate(over="ignore"):
        bits = (mix64(sigs.astype(np.uint64)) >> np.uint64(60)).reshape(len(sigs), -1, 16)
        return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Order of the codes by their rank in the Gray sequence (each bit of the rank is the parity of the bits above it)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    carry = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        odd = rank[:, k] & np.uint64(1)
        rank[:, k] ^= np.where(carry == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        carry ^= odd
    return np.lexsort(rank.T[::-1])


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits set in each row of uint64[rows, words]."""
    n = np.bitwise_count(x)
    if n.shape[1] != 8:
        return n.sum(axis=1, dtype=np.int64)
    # eight counts of one byte are a number: added up in lanes of 16 bits, which the product sums
    n = np.ascontiguousarray(n).view(np.uint64)[:, 0]
    low = np.uint64(0x00FF00FF00FF00FF)
    with np.errstate(over="ignore"):
        return (((n & low) + ((n >> np.uint64(8)) & low)) * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


def gray_search(codes: np.ndarray, side: np.ndarray | None, bound: int, fan: int = LEAF, visits: list[int] | None = None, room: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that differ in at most ``bound`` bits; with ``side``, only those of different sides.

    Level 0 holds the codes in Gray order. The nodes of level 1 are its runs in which neighbours are within the bound, of at most ``fan`` squared
    codes, so that a stray between copies makes a node of its own; above, each node has ``fan`` children. A node holds the bits that its
    children agree on, and each child only those beyond its parent's, so that differences add up on the way down. Where the codes
    come in clusters, as in a node of many near copies, the groups of other clusters fall out at level 1; where nothing falls out, rows are compared directly. So many rows are searched for at
    once that their comparisons with all others are ``room`` at most. ``visits`` gets the number of comparisons at each level.
    """
    n = len(codes)
    if n < 2 or side is not None and (side == side[0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = gray_order(codes)
    sorted_ = codes[order]
    far = _bits(sorted_[1:] ^ sorted_[:-1]) > bound
    first = np.flatnonzero(np.concatenate(([True], far)))
    run = np.diff(np.concatenate((first, [n])))
    parts = -(-run // (fan * fan))
    first = np.repeat(first, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * fan * fan
    # of each level: value, mask, first child of every node with one end more, and the last row below it
    levels = [(sorted_, np.full_like(codes, 0xFFFFFFFFFFFFFFFF), None, np.arange(n))]
    at = first
    while True:
        value, mask, _, last = levels[-1]
        every, some = np.bitwise_and.reduceat(value, at), np.bitwise_or.reduceat(value, at)
        common = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
        child = np.concatenate((at, [len(value)]))
        levels.append((every & common, common, child, last[child[1:] - 1]))
        if len(at) <= fan:
            break
        at = np.arange(0, len(at), fan)
    beside = np.zeros(n, np.int64) if side is None else side[order]
    # rows that the rows of a side are compared with, and their codes by columns
    others = {s: np.arange(n) if side is None else np.flatnonzero(beside != s) for s in np.unique(beside).tolist()}
    direct = {s: (at, np.ascontiguousarray(sorted_[at].T)) for s, at in others.items()}
    found = [_descend(levels, beside, direct, bound, lo, min(n, lo + max(1, room // n)), visits) for lo in range(0, n, max(1, room // n))]
    a, b = (order[np.concatenate(x)] for x in zip(*found))
    return a, b


def _compare(codes: np.ndarray, side: np.ndarray, direct: dict, bound: int, lo: int, hi: int, first: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """What ``_descend`` finds, without the levels, and the number of comparisons: ``first`` words of all codes, then the other words of those within the bound so far."""
    query, node, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for q in range(lo, hi):
        rows, words = direct[int(side[q])]
        begin = int(np.searchsorted(rows, q, "right"))
        spent = np.zeros(len(rows) - begin, np.uint16)
        seen += len(spent)
        for w, x in zip(words[:first, begin:], codes[q]):
            spent += np.bitwise_count(w ^ x)
        at = np.flatnonzero(spent <= bound)
        if len(at):
            at = rows[at + begin]
            at = at[_bits(codes[at] ^ codes[q]) <= bound]
            query.append(np.full(len(at), q))
            node.append(at)
    return np.concatenate(query), np.concatenate(node), seen


def _descend(levels: list[tuple], side: np.ndarray, direct: dict, bound: int, lo: int, hi: int, visits: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows from ``lo`` to ``hi`` of the lowest level with rows after them, of another side where there are sides."""
    sorted_, top = levels[0][0], len(levels[-1][0])
    query, node = np.repeat(np.arange(lo, hi), top), np.tile(np.arange(top), hi - lo)
    parent = np.zeros((1, sorted_.shape[1]), np.uint64)
    above = np.zeros(len(query), np.int64)
    spent = np.zeros(len(query), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        value, mask, child, last = levels[depth]
        # only nodes with a row after the query's: each pair is looked at once
        keep = last[node] > query
        if not depth and len(direct) > 1:
            keep &= side[node] != side[query]
        query, node, above, spent = query[keep], node[keep], above[keep], spent[keep]
        if visits is not None:
            visits.append(len(query))
        apart = sorted_[query] ^ value[node]
        if depth:
            apart &= mask[node]
        apart &= ~parent[above]
        spent = spent + _bits(apart)
        keep = spent <= bound
        query, node, spent = query[keep], node[keep], spent[keep]
        if depth:
            parent, size = mask, child[node + 1] - child[node]
            if 2 * size.sum() > (hi - lo) * (len(sorted_) - lo):
                query, node, seen = _compare(sorted_, side, direct, bound, lo, hi)
                if visits is not None:
                    visits.append(seen)
                return query, node
            query, above, spent = np.repeat(query, size), np.repeat(node, size), np.repeat(spent, size)
            node = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(child[node], size)
    return query, node


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Parts of the values' bytes, from each start to the next."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _signatures(docs: DataFrame, words: int, band: int) -> DataFrame:
    """(doc_id, cls, n, code, keys): cls is a commutative hash of the set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo, hi in slices(texts, BLOCK):
                grams, starts = shingle.sets(texts[lo:hi])
                some = np.flatnonzero(np.diff(starts))
                if not len(some):
                    continue
                starts = np.append(starts[some], len(grams))
                with np.errstate(over="ignore"):
                    cls = np.add.reduceat(mix64(grams), starts[:-1])
                sigs = signatures(grams, starts)
                keys = band_keys(sigs, band)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:hi][some], pa.int64()),
                        pa.array(cls.view(np.int64)),
                        _binary(narrow(sigs), np.arange(len(some) + 1) * (SLOTS // 2)),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, SLOTS // band, dtype=np.int32), keys.ravel().view(np.int64)),
                    ],
                    names=["doc_id", "cls", "code", "keys"],
                )

    return spread(docs).mapInArrow(make, "doc_id long, cls long, code binary, keys array<long>")


def _band_rows(sigs: DataFrame) -> DataFrame:
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            # the patterns of a class are those of any of its records
            cls, at = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            keys = b.column(1).flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)[at]
            if (out := _emit(keys.ravel(), np.repeat(cls, keys.shape[1]), np.zeros(keys.size, np.int32))) is not None:
                yield out

    return sigs.select("cls", "keys").mapInArrow(flat, _ROWS)


def candidates(sigs: DataFrame, bound: int, block: int = 2000, deep: int = 32, most: int = 100_000) -> DataFrame:
    """Pairs (a, b) of classes, a < b, that share an upper node and differ in at most ``bound`` bits: all of them, however large the node.

    Nodes with more than ``block`` classes are cut into blocks, and each pair of blocks is a unit of work of its own. That copies a row as often as there
    are blocks; so nodes of more than ``deep`` blocks have ``deep`` larger ones instead, and more only where a block would hold more than ``most`` classes.
    """
    node = _shared(_band_rows(sigs)).select("h", F.col("doc_id").alias("cls")).distinct()
    code = sigs.groupBy("cls").agg(F.first("code").alias("code"))
    node = cut_lineage(node, "nodes")
    blocks = lambda n: F.greatest(F.least(F.ceil(n / block), F.lit(deep)), F.ceil(n / most))
    size = node.groupBy("h").agg(blocks(F.count("*")).cast("int").alias("nb"))
    rows = (
        node.join(size.where("nb > 1"), "h", "left")
        .withColumn("nb", F.coalesce("nb", F.lit(1)))
        .withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
        .join(code, "cls")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("h", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "cls", "blk", "code")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(cls, blk, code, one):
            codes = np.frombuffer(b"".join(code), np.uint64).reshape(len(code), -1)
            a, b = gray_search(codes, None if one else blk, bound)
            if len(a):
                lo, hi = np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])

        def leaves(cls, code, group):
            """Nodes of a few classes have no levels below: all of a batch are compared at once."""
            at = np.flatnonzero(group >= 0)
            if not len(at):
                return
            codes = np.frombuffer(b"".join(code[at]), np.uint64).reshape(len(at), -1)
            cls, group = cls[at], group[at]
            for step in range(1, LEAF):
                i = np.flatnonzero(group[step:] == group[:-step])
                i = i[np.bitwise_count(codes[i] ^ codes[i + step]).sum(axis=1, dtype=np.int64) <= bound]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[i + step])), pa.array(np.maximum(cls[i], cls[i + step]))], names=["a", "b"])

        held: list | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)] + [np.array(b.column(5).to_pylist(), object)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            h, x, y = cols[:3]
            edges = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True])))
            size = np.diff(edges[:-1])
            small = size <= LEAF
            yield from leaves(cols[3], cols[5], np.repeat(np.where(small & (size > 1), np.arange(len(size)), -1), size))
            for lo, hi in zip(edges[:-2][~small], edges[1:-1][~small]):
                yield from unit(cols[3][lo:hi], cols[4][lo:hi], cols[5][lo:hi], x[lo] == y[lo])
            held = [c[edges[-2] :] for c in cols]
        if held is not None and len(held[0]) > 1:
            yield from unit(held[3], held[4], held[5], held[1][0] == held[2][0])

    parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(search, "a long, b long").distinct()


def _similar(docs: DataFrame, pairs: DataFrame, member: DataFrame, words: int, threshold: float) -> DataFrame:
    """Of the candidate pairs those whose sets reach the threshold, with the exact similarity."""
    need = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    rep = member.join(need, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, BLOCK):
                found, starts = shingle.sets(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), _binary(found, starts * 8)], names=["cls", "grams"])

    grams = cut_lineage(docs.join(rep, "doc_id").select("cls", "text").mapInArrow(sets, "cls long, grams binary"), "grams")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = np.zeros(batch.num_rows)
            for i, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim[i] = both / (len(x) + len(y) - both)
            keep = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["a", "b", "similarity"]).filter(keep)

    return (
        pairs.join(grams.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
        .join(grams.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
        .select("a", "b", "ga", "gb")
        .mapInArrow(exact, "a long, b long, similarity double")
    )


class NearDuplicates:
    """The classes of equal sets and the pairs of similar ones; each is computed once and written down."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, miss: float = 1e-6) -> None:
        band, bound = layout(threshold, miss)
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        # repeated deliveries of an id are one record
        sigs = cut_lineage(_signatures(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), words, band), "signatures")
        self.member = sigs.select("cls", "doc_id").distinct()
        self.similar = cut_lineage(_similar(docs, cut_lineage(candidates(sigs, bound), "candidates"), self.member, words, threshold), "similar")
        self.docs = docs

    def pairs(self, expand: int | None = None) -> DataFrame:
        """(doc_id_1, doc_id_2, similarity) of all similar records, the smaller id first.

        With ``expand``, only the smallest member stands for a class of more members.
        """
        size = self.member.groupBy("cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"))
        touched = self.similar.select(F.col("a").alias("cls")).union(self.similar.select(F.col("b").alias("cls"))).distinct()
        few = self.member.join(size, "cls")
        whole = F.lit(True) if expand is None else F.col("n") <= expand
        # members that stand in for their class: all of a class, or the smallest of one over ``expand``
        stand = few.where(whole | (F.col("doc_id") == F.col("rep"))).join(touched, "cls", "left_semi").select("cls", "doc_id")
        across = (
            self.similar.join(stand.select(F.col("cls").alias("a"), F.col("doc_id").alias("p")), "a")
            .join(stand.select(F.col("cls").alias("b"), F.col("doc_id").alias("q")), "b")
            .select("p", "q", "similarity")
        )
        copies = few.where("n > 1")
        small = copies.where(whole).select("cls", "doc_id")
        inside = small.select("cls", F.col("doc_id").alias("p")).join(small.select("cls", F.col("doc_id").alias("q")), "cls").where("p < q")
        star = copies.where(~whole).where("doc_id <> rep").select(F.col("rep").alias("p"), F.col("doc_id").alias("q"))
        same = inside.select("p", "q").union(star).withColumn("similarity", F.lit(1.0))
        return across.union(same).select(F.least("p", "q").alias("doc_id_1"), F.greatest("p", "q").alias("doc_id_2"), "similarity")

    def groups(self) -> DataFrame:
        """One row a record: (doc_id, class_id, group_id, n_links).

        class_id is the smallest id with the same set, group_id the smallest id that can be reached over similar records,
        n_links the number of other classes that are similar. Records without words have themselves and 0.
        """
        size = self.member.groupBy("cls").agg(F.min("doc_id").alias("class_id"))
        ends = self.similar.select(F.col("a").alias("cls")).union(self.similar.select(F.col("b").alias("cls")))
        links = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
        rep = self.similar.join(size.withColumnsRenamed({"cls": "a", "class_id": "p"}), "a").join(size.withColumnsRenamed({"cls": "b", "class_id": "q"}), "b")
        comp = connected_components(rep.select("p", "q"), "p", "q").withColumnsRenamed({"node": "class_id", "component": "group_id"})
        known = self.member.join(size, "cls").join(links, "cls", "left").join(comp, "class_id", "left")
        all_ids = self.docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
        return all_ids.join(known, "doc_id", "left").select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("group_id", "class_id", "doc_id").alias("group_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        )
