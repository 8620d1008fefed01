"""Filling containers of fixed capacity (problem 8).

Shortest-pack-first over the histogram of lengths (Krell et al. 2021): lengths are placed longest first, each item into the open container
that is filled least, and a new one is opened where none takes it. Containers of one pattern are one entry with a count, and whole counts
move from pattern to pattern, never single items. The patterns depend on the histogram alone, which has at most as many entries
as the capacity; the items are joined back to them by their rank among the items of the same length.

Longer texts are cut into full containers and a rest, which is packed like any other item. Defined results: a
text without tokens (null, empty) takes no room and stands in container 0; a null id is kept; repeated rows are items of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .tokens import VOCABULARY, token_counts


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) and how many containers have each.

    ``room`` has the open patterns by what is left in them. For each length, longest first, one item goes into every container of
    the pattern with the most room, then of the next; the containers that aren't needed stay behind as they are.
    """
    Pattern = tuple  # (the pattern before, length, times), or () for nothing
    room: dict[int, list[tuple[Pattern, int]]] = {}
    lefts: list[int] = []  # rooms that hold patterns, ascending

    def put(pattern: Pattern, made: int, left: int) -> None:
        if not room.setdefault(left, []):
            insort(lefts, left)
        room[left].append((pattern, made))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        n = counts[length]
        while n:
            if not lefts or lefts[-1] < length:
                # none takes it: each new container is the only one with room until it has none
                times = min(capacity // length, n)
                made = n // times
                n -= made * times
                put(((), length, times), made, capacity - times * length)
                continue
            left = lefts[-1]
            old, have = room[left].pop()
            if not room[left]:
                lefts.pop()
            made = min(have, n)
            n -= made
            if made < have:
                put(old, have - made, left)
            grown = (old[0], length, old[2] + 1) if old[1] == length else (old, length, 1)
            put(grown, made, left - length)

    def unfold(pattern: Pattern) -> tuple[tuple[int, int], ...]:
        out = []
        while pattern:
            pattern, length, times = pattern
            out.append((length, times))
        return tuple(out[::-1])

    return [(unfold(p), made) for left in sorted(room) for p, made in room[left]]


def plan_rows(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first container and items a container of each pattern that uses it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for pattern, made in patterns:
        for length, times in pattern:
            out.setdefault(length, []).append((seen.get(length, 0), base, times))
            seen[length] = seen.get(length, 0) + made * times
        base += made
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def pack_items(sizes: DataFrame, limits: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(limit_name, capacity, id, piece, n_tokens, container) of every piece of every item.

    limits: limit_name string, capacity_tokens int; a table of a few rows, read by the driver. Pieces are range-partitioned in order of limit,
    length and id, so a frequent length is as many tasks' work as it needs; a piece's rank is its place in its partition and the
    count of its length in the partitions before. There are no more such counts than lengths and partitions.
    """
    spark = sizes.sparkSession
    caps = sorted({r[0]: int(r[1]) for r in limits.where("capacity_tokens > 0 AND limit_name IS NOT NULL").select("limit_name", "capacity_tokens").distinct().collect()}.items())
    if not caps:
        return sizes.where("false").select(F.lit("").alias("limit_name"), F.lit(0).cast("long").alias("capacity"), id_col, *(F.lit(0).cast("long").alias(c) for c in ("piece", "n_tokens", "container")))
    # the row's number tells repeated rows apart
    items = cut_lineage(sizes.select(F.col(id_col).alias("_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("row")), "sizes")
    lim = F.array(*[F.struct(F.lit(k).alias("lim"), F.lit(v).cast("long").alias("capacity")) for k, (_, v) in enumerate(caps)])
    pieces = (
        items.select("_id", "n", "row", F.explode(lim).alias("l"))
        .select("_id", "n", "row", "l.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr("(n - 1) div capacity")))))
        .select("lim", F.least("capacity", F.col("n") - F.col("piece") * F.col("capacity")).alias("len"), "_id", "row", "piece")
    )
    kind = items.schema["_id"].dataType.simpleString()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the place of each row among those of its limit and length in the partition, which is sorted by them."""
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) << 48 | b.column(1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate((first, [len(key)]))))
            if key[0] == last:
                place[: first[1] if len(first) > 1 else len(key)] += seen
            last, seen = key[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 4, 5)), pa.array(place)], names=["lim", "len", "_id", "piece", "part", "place"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("lim", "len", "_id", "row", "piece")
    placed = pieces.where("len > 0").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = cut_lineage(placed.mapInArrow(rank, f"lim int, len long, _id {kind}, piece long, part int, place long"), "pieces")

    counts: dict[int, dict[int, int]] = {}
    before: dict[tuple[int, int, int], int] = {}
    for lim_, len_, part, c in sorted(map(tuple, placed.groupBy("lim", "len", "part").agg(F.count("*").alias("c")).collect())):
        have = counts.setdefault(lim_, {})
        before[lim_, len_, part] = have.get(len_, 0)
        have[len_] = have.get(len_, 0) + c
    plans = {(k, n): p for k, h in counts.items() for n, p in plan_rows(pack_histogram(h, caps[k][1])).items()}
    shared = spark.sparkContext.broadcast((plans, before))  # bounded by the capacities and the number of partitions

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, before = shared.value
        names, most = pa.array([k for k, _ in caps], pa.string()), pa.array([v for _, v in caps], pa.int64())
        for b in batches:
            if not b.num_rows:
                continue
            lim, len_, part, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4, 5))
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(lim) != 0) | (np.diff(len_) != 0) | (np.diff(part) != 0), [True])))
            box = np.empty(len(rank), np.int64)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                key = int(lim[lo]), int(len_[lo])
                first, base, times = plans[key]
                r = rank[lo:hi] + before[*key, int(part[lo])]
                k = np.searchsorted(first, r, "right") - 1
                box[lo:hi] = base[k] + (r - first[k]) // times[k]
            yield pa.RecordBatch.from_arrays([names.take(b.column(0)), most.take(b.column(0)), b.column(2), b.column(3), b.column(1), pa.array(box)], names=["limit_name", "capacity", id_col, "piece", "n_tokens", "container"])

    packed = placed.mapInArrow(place, f"limit_name string, capacity long, `{id_col}` {kind}, piece long, n_tokens long, container long")
    name = F.element_at(F.array(*[F.lit(k) for k, _ in caps]), F.col("lim") + 1)
    most = F.element_at(F.array(*[F.lit(v).cast("long") for _, v in caps]), F.col("lim") + 1)
    return packed.union(pieces.where("len = 0").select(name, most, "_id", "piece", "len", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of the texts by container, for every capacity; the texts are measured once."""
    return pack_items(token_counts(docs, id_col, text_col, vocabulary=vocabulary), limits, id_col)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, and the share of the containers that is filled."""
    used = packed.where("n_tokens > 0")
    return used.groupBy("limit_name", "capacity").agg(
        F.count("*").alias("n_pieces"),
        (F.max("container") + 1).alias("n_containers"),
        F.sum("n_tokens").alias("n_tokens"),
        F.round(F.sum("n_tokens") / ((F.max("container") + 1) * F.first("capacity")), 6).alias("filled"),
    )
