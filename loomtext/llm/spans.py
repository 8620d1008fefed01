"""Long exact spans shared between records (problem 10).

Every fixed-length window of a text belongs to a Rabin-Karp hash, and windows that occur in two or more records merge
into maximal intervals. Windows count code points, so white space and case take part.

One row a window would shuffle some thirty-five times the input, so the windows are counted by runs, with the same outcome:

1. Of the shorter windows inside each window the one with the smallest hash is its anchor (winnowing). Equal windows have the same
   anchor, so a window whose anchor is in no other record is no case. Neighbouring windows with one anchor are a run, of
   no more windows than a window is long: its first and its last window together cover it.
2. A run is one row, under its anchor, with the hashes of its first and its last window and their distance. Where another record has
   the same, all windows of the run stand there as well.
3. Where the runs of an anchor differ, one of each sort is taken apart: into the shorter runs of a longer anchor, which are settled in the
   same way, and where these differ, into single windows, which are counted one by one.

What is frequent within a batch is settled there and travels as one row; an anchor that many records of a batch have in different runs is
spread over tasks by its runs, so that a passage held by a third of all records puts no load on one task.

Defined results: null and shorter texts have no spans; a text that repeats a passage only in itself has none;
repeated rows of one id count as one record; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage, spread
from .numtext import PrimeHash, RollingHash, code_points, mix64, sliding, slices

_ROWS = "h long, doc_id long, pos int, settled boolean"
_MARK = -(1 << 63)

#: Sorts of rows of runs: alone or for all of its sort in the batch, both under the anchor; settled; the first two under
#: the run, where the anchor is frequent; and the sign to the anchor that this is so.
PLAIN, SORT, SETTLED, HOT_PLAIN, HOT_SORT, HOT = range(6)
#: Sorts of runs of one anchor in a batch from which on they are spread.
MANY = 16
#: Code points that are hashed at once, and that make up a batch of rows.
BLOCK, BATCH = 200_000, 4_000_000


def _emit(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch | None:
    """Rows of one slice: those of a hash with two records or more are settled and leave one marker behind. Rows may be markers from the start."""
    if not len(h):
        return None
    order = np.lexsort((doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    last = np.concatenate((first[1:], [len(h)])) - 1
    many = doc[first] != doc[last]
    settled = np.repeat(many, last - first + 1)
    keep = (doc != _MARK) | ~settled & np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    h, doc, pos, settled, marks = h[keep], doc[keep], pos[keep], settled[keep], h[first[many]]
    n = len(marks)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((h, marks)).view(np.int64)),
            pa.array(np.concatenate((doc, np.full(n, _MARK, np.int64)))),
            pa.array(np.concatenate((pos, np.zeros(n, np.int32))).astype(np.int32)),
            pa.array(np.concatenate((settled, np.zeros(n, bool)))),
        ],
        names=["h", "doc_id", "pos", "settled"],
    )


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches as arrays, cut so that no value of the first column stands in two of them."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        held = [x[cut:] for x in cols]
        if cut:
            yield [x[:cut] for x in cols]
    if held is not None:
        yield held


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (h, doc_id, pos) whose hash stands in two records or more."""
    spread_key = F.when(F.col("settled"), F.xxhash64("doc_id", "pos")).otherwise(F.col("h"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc, pos, settled in _whole_groups(batches):
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            keep = (np.repeat(many, np.diff(np.concatenate((first, [len(h)])))) | settled) & (doc != _MARK)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(doc[keep]), pa.array(pos[keep])], names=["h", "doc_id", "pos"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, spread_key).sortWithinPartitions("h").mapInArrow(settle, "h long, doc_id long, pos int")


class Windows:
    """Runs of windows, and single windows, of the texts of a batch."""

    def __init__(self, min_length: int, gram: int, block: int = BLOCK) -> None:
        self.width, self.gram, self.block = min_length, gram, block
        self.roll, self.prime = RollingHash(), PrimeHash()

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, code points, where each text begins, text of each code point) of as many texts as make up a block."""
        for lo, hi in slices(texts, self.block):
            symbols, starts = code_points(texts[lo:hi])
            if len(symbols) >= self.width:
                yield lo, symbols, starts, np.repeat(np.arange(hi - lo), np.diff(starts))

    def runs(self, symbols: np.ndarray, starts: np.ndarray, owner: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(anchor, sort, text, place, windows, stand-in) of every run of the block, or of its windows that are ``wanted`` (1, or 2 as stand-ins)."""
        width, gram = self.width, self.gram
        low = sliding(np.minimum, self.roll.windows(self.roll.prefix(symbols), gram), width - gram + 1)
        inside = (owner[: len(low)] == owner[width - 1 :]) * (np.int8(1) if wanted is None else wanted[: len(low)])
        new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (inside[1:] != inside[:-1]) | (owner[1 : len(low)] != owner[: len(low) - 1]))))
        stop = np.concatenate((new[1:], [len(low)]))
        new, stop = new[inside[new] > 0], stop[inside[new] > 0]
        if len(new) and (stop - new).max() > width:
            # a repeated pattern keeps one anchor for long
            parts = -(-(stop - new) // width)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            new, end = np.repeat(new, parts) + k * width, np.repeat(stop, parts)
            stop = np.minimum(new + width, end)
        sums = self.prime.prefix(symbols)
        n = stop - new
        with np.errstate(over="ignore"):
            ends = mix64(self.prime.at(sums, new, width) + mix64(self.prime.at(sums, stop - 1, width) + n.astype(np.uint64)))
        return low[new], ends, owner[new], new - starts[owner[new]], n, inside[new] == 2

    def single(self, symbols: np.ndarray, starts: np.ndarray, text: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hash, text, place) of the windows from begin on and before stop of each run."""
        n = stop - begin
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        text = np.repeat(text, n)
        return self.prime.at(self.prime.prefix(symbols), at + starts[text], self.width), text, at


def _emit_runs(h: np.ndarray, e: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, stands: np.ndarray, frequent: int = MANY) -> pa.RecordBatch:
    """Rows of one batch. Runs that two records have are settled, and one stands for them under the anchor; ``stands`` says which do so from the start."""
    order = np.lexsort((doc, e, h))
    h, e, doc, pos, n, stands = (x[order] for x in (h, e, doc, pos, n, stands))
    change = np.concatenate(([True], (h[1:] != h[:-1]) | (e[1:] != e[:-1])))
    first = np.flatnonzero(change)
    size = np.diff(np.concatenate((first, [len(h)])))
    many = (doc[first] != doc[first + size - 1]) | np.maximum.reduceat(stands, first) if len(h) else np.zeros(0, bool)
    anchor = np.flatnonzero(np.concatenate(([True], h[first][1:] != h[first][:-1])))
    sorts = np.diff(np.concatenate((anchor, [len(first)])))
    hot = np.repeat(sorts >= frequent, sorts)
    kind = np.repeat(np.where(many, SETTLED, np.where(hot, HOT_PLAIN, PLAIN)), size)
    rep, sign = first[many], first[anchor[sorts >= frequent]]
    stay = ~stands
    done = (kind == SETTLED)[stay]  # their hashes aren't needed any more
    kinds = np.concatenate((kind[stay], np.where(hot[many], HOT_SORT, SORT), np.full(len(sign), HOT)))
    take = lambda x: np.concatenate((np.where(done, 0, x[stay]).astype(x.dtype), x[rep], x[sign])).view(np.int64)
    also = lambda x: np.concatenate((x[stay], x[rep], x[sign]))
    loc = also(pos).astype(np.int64) << 27 | also(n) << 3 | kinds
    return pa.RecordBatch.from_arrays(list(map(pa.array, (take(h), take(e), also(doc), loc))), names=["h", "e", "doc_id", "loc"])


def _judge(h: np.ndarray, e: np.ndarray, doc: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of whole anchors, sorted by anchor and run: which stand in another record, which are to be taken apart, and which of their sort are so as stand-ins."""
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (e[1:] != e[:-1]))))
    size = np.diff(np.concatenate((first, [len(h)])))
    real = kind != HOT
    low = np.minimum.reduceat(np.where(real, doc, np.iinfo(np.int64).max), first)
    high = np.maximum.reduceat(np.where(real, doc, np.iinfo(np.int64).min), first)
    sort = np.maximum.reduceat((kind == SORT) | (kind == HOT_SORT), first)
    many = (low < high) | sort
    there = np.maximum.reduceat(real, first)
    # by anchor: two records, or a sort of two; a run of one record only; frequent elsewhere
    anchor = np.flatnonzero(np.concatenate(([True], h[first][1:] != h[first][:-1])))
    span = np.diff(np.concatenate((anchor, [len(first)])))
    hot = np.maximum.reduceat(np.maximum.reduceat(kind >= HOT_PLAIN, first), anchor)
    shared = hot | np.maximum.reduceat(many, anchor) | (np.minimum.reduceat(low, anchor) < np.maximum.reduceat(high, anchor))
    mixed = hot | np.maximum.reduceat(there & ~many, anchor)
    each = lambda x: np.repeat(x, size)
    leads = np.zeros(len(h), bool)
    # the first real row of each run speaks for it
    at = np.flatnonzero(real)
    lead = at[np.concatenate(([True], each(np.arange(len(first)))[at][1:] != each(np.arange(len(first)))[at][:-1]))] if len(at) else at
    leads[lead] = True
    shared, mixed = each(np.repeat(shared, span)), each(np.repeat(mixed, span))
    found = real & each(many) & ((kind == PLAIN) | (kind == HOT_PLAIN))
    todo = real & shared & mixed
    return found, todo & ~each(many), todo & leads & each(many)


def shared_stretches(docs: DataFrame, min_length: int = 200, frequent: int = MANY, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """(doc_id, pos, stop): all windows that start from pos on and before stop stand in another record as well.

    docs: doc_id long, text string. frequent, block and batch bear on the work only, not on the result.
    """

    def gather(batches: Iterator[pa.RecordBatch], make, emit) -> Iterator[pa.RecordBatch]:
        """Columns that ``make`` yields for each block, put together to batches for ``emit``."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            for weight, cols in make(b):
                held.append(cols)
                size += weight
                if size >= batch:
                    yield emit(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield emit(*map(np.concatenate, zip(*held)))

    def ranges(b: pa.RecordBatch, lo: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, begin, stop, stand-in) of the windows that the lists of a block's rows name."""
        lists = [b.column(i).slice(lo, len(starts) - 1) for i in (2, 3, 4)]
        text = np.repeat(np.arange(len(lists[0])), pa.compute.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
        return text, *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)

    def of_runs(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
        win = Windows(min_length, gram, block)

        def make(b: pa.RecordBatch):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, symbols, starts, owner in win.blocks(b.column(1).to_pylist()):
                wanted = None
                if b.num_columns > 2:
                    text, begin, stop, stands = ranges(b, lo, starts)
                    edge = np.zeros(len(symbols) + 1, np.int8)
                    np.add.at(edge, begin + starts[text], 1 + stands)
                    np.add.at(edge, stop + starts[text], -1 - stands)
                    wanted = np.cumsum(edge, dtype=np.int8)
                h, e, text, pos, n, stands = win.runs(symbols, starts, owner, wanted)
                if len(h):
                    yield len(symbols), (h, e, ids[lo + text], pos, n, stands)

        yield from gather(batches, make, partial(_emit_runs, frequent=frequent))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc, loc, todo):
            pos, n = loc >> 27, loc >> 3 & 0xFFFFFF
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos.astype(np.int32)), pa.array((pos + n).astype(np.int32)), pa.array(np.full(len(doc), todo, np.int8))], names=["doc_id", "pos", "stop", "todo"])

        ready: list[pa.RecordBatch] = []

        def unsettled() -> Iterator[pa.RecordBatch]:
            for b in batches:
                doc, loc = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                done = loc & 7 == SETTLED
                if done.any():
                    ready.append(out(doc[done], loc[done], 0))
                    b = b.filter(pa.array(~done))
                yield b

        for h, e, doc, loc in _whole_groups(unsettled()):
            yield from ready
            ready.clear()
            for todo, which in enumerate(_judge(h, e, doc, loc & 7)):
                if which.any():
                    yield out(doc[which], loc[which], todo)
        yield from ready

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = Windows(min_length, min_length, block)

        def make(b: pa.RecordBatch):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, symbols, starts, _ in win.blocks(b.column(1).to_pylist()):
                text, begin, stop, stands = ranges(b, lo, starts)
                stands = np.repeat(stands, stop - begin)
                h, text, pos = win.single(symbols, starts, text, begin, stop)
                yield len(h), (h, np.where(stands, _MARK, ids[lo + text]), np.where(stands, 0, pos).astype(np.int32))

        yield from gather(batches, make, _emit)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def level(rows: DataFrame, gram: int) -> tuple[DataFrame, DataFrame]:
        """What stands elsewhere by runs of this anchor, and per text the lists of what is left to be taken apart."""
        rows = rows.mapInArrow(partial(of_runs, gram=gram), "h long, e long, doc_id long, loc long")
        kind = F.col("loc").bitwiseAND(7)
        to = F.when(kind == SETTLED, F.xxhash64("doc_id", "loc")).when(kind.isin(HOT_PLAIN, HOT_SORT), F.xxhash64("h", "e")).otherwise(F.col("h"))
        runs = cut_lineage(rows.repartition(parts, to).sortWithinPartitions("h", "e", "doc_id").mapInArrow(settle, "doc_id long, pos int, stop int, todo byte"), "runs")
        todo = runs.where("todo > 0").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "stop", (F.col("todo") == 2).alias("stands"))).alias("x")).select("doc_id", "x.pos", "x.stop", "x.stands")
        return runs.where("todo = 0").select("doc_id", "pos", "stop"), todo

    coarse, todo = level(spread(docs), max(1, min_length // 2))
    left = cut_lineage(docs.join(todo, "doc_id").select("doc_id", "text", "pos", "stop", "stands"), "spans")
    middle, todo = level(left, max(1, min_length * 22 // 25))
    fine = _shared(left.select("doc_id", "text").join(todo, "doc_id").mapInArrow(windows, _ROWS)).select("doc_id", "pos", (F.col("pos") + 1).alias("stop"))
    return coarse.union(middle).union(fine)


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 200, **work) -> DataFrame:
    """Maximal intervals (doc_id, span_start, span_end) of each record that stand verbatim in another one.

    Positions are code points from 0, the end exclusive. Intervals that overlap or touch are one. work: see ``shared_stretches``.
    """
    if min_length < 2:
        raise ValueError("min_length must be 2 or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= min_length)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, begin, end = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            d, p, q = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            q = q + (min_length - 1)
            if doc is not None:
                d, p, q = np.append(doc, d), np.append(begin, p), np.append(end, q)
            # the furthest end so far within each record: records are told apart by a step larger than any text
            far = np.cumsum(np.concatenate(([0], d[1:] != d[:-1]))) << 40
            reach = np.maximum.accumulate(q + far)
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] + far[1:] > reach[:-1]))))
            stop = np.concatenate((new[1:], [len(p)])) - 1
            owners, starts, ends = d[new], p[new], reach[stop] - far[stop]
            doc, begin, end = owners[-1], starts[-1], ends[-1]
            if len(owners) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in (owners, starts, ends)], names=["doc_id", "span_start", "span_end"])
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (doc, begin, end)], names=["doc_id", "span_start", "span_end"])

    rows = shared_stretches(docs, min_length, **work)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(merge, "doc_id long, span_start long, span_end long")


def shared_portion(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 200) -> DataFrame:
    """Per record: number of spans, shared characters, and their share of the text (0.0 for an empty or null text)."""
    spans = shared_spans(docs, id_col, text_col, min_length).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    base = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).cast("long").alias("n_chars"))
    return base.join(spans, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("shared_chars", F.lit(0).cast("long")).alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"),
    )
