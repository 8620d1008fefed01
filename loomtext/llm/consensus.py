"""Consensus from several annotators' labels (problem 2).

Confidence-aware truth discovery over 0/1 marks of words. Labels and annotators are estimated in turns until no sum changes:

* An annotator's error variance is the mean squared distance of the marks from the labels, and is replaced by its upper confidence
  bound, sum / chi-squared quantile(alpha / 2, n) (Li et al. 2014). Few marks give a wide bound, so an annotator of the long tail gains
  no weight by chance. The bound is taken apart for words that belong and words that don't: annotators who miss words and annotators who
  add words err in different ways.
* A word's label is the one of the smaller weighted distance from the marks. A mark's weight is the logarithm of the bounds, and the
  usual length of a title is one more voice against each word.

Weights of inverse bounds, without logarithm and taken together for both kinds of words, let the surest annotator outvote all others.

An item's marks stay together in one row, bounded by its words and annotators; only sums per annotator travel
between rounds. They are handed to all tasks while there are no more than ``few`` of them, and joined to the items beyond that.

Defined results: marks that are null or stop early are completed from the annotator's latest title, and are unknown where there is
none; a null title in the titles table keeps no word; items without words or marks have no labels; a word with equal distances has label 0; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
UNKNOWN = -1


def chi2_quantile(n, z: float = -1.959964) -> np.ndarray:
    """Wilson and Hilferty's quantile of the chi-squared distribution with n degrees of freedom; z is the normal quantile."""
    n = np.maximum(np.asarray(n, float), 1e-9)
    h = 2 / (9 * n)
    return np.maximum(1e-6, n * (1 - h + z * np.sqrt(h)) ** 3)


def bounded_rate(errors, n, z: float = -1.959964) -> np.ndarray:
    """Upper bound of an error variance. One error more keeps rare annotators from certainty; 0.5 and above say nothing in favour."""
    return np.clip((np.asarray(errors, float) + 1) / np.maximum(chi2_quantile(np.asarray(n, float) + 1, z), 1.0), 1e-4, 0.98)


def _bare(word: str) -> str:
    return _EDGE.sub("", word).lower() or word.lower()


def marks_of_title(words: list[str], title: str | None, start: int = 0) -> list[int]:
    """0/1 per word: the title's words are looked for from left to right, from ``start`` on; one out of order takes its first free place."""
    own = [_bare(w) for w in words]
    marks, cursor = [0] * len(own), start
    for w in map(_bare, (title or "").split()):
        at = next((i for i in range(cursor, len(own)) if own[i] == w), None)
        if at is None:
            at = next((i for i in range(start, len(own)) if own[i] == w and not marks[i]), None)
        else:
            cursor = at + 1
        if at is not None:
            marks[at] = 1
    return marks


def complete(words: list[str], marks: list | None, title: str | None, has_title: bool) -> list[int] | None:
    """Marks for every word from what there is; None when there is nothing."""
    n = len(words)
    have = [m if m in (0, 1) else UNKNOWN for m in (marks or [])[:n]]
    if len(have) == n:
        return have
    if not has_title:
        return have + [UNKNOWN] * (n - len(have)) if have else None
    left = [_bare(w) for w in (title or "").split()]
    for i, m in enumerate(have):  # words that the marks already account for
        if m == 1 and _bare(words[i]) in left:
            left.remove(_bare(words[i]))
    return have + marks_of_title(words, " ".join(left), len(have))[len(have) :]


def items(gold: DataFrame, titles: DataFrame) -> DataFrame:
    """(k, words, annotator array, marks array of arrays), one row an item."""
    base = gold.where("k IS NOT NULL AND size(words) > 0").groupBy("k").agg(F.max_by(F.struct("id", "words", "annotators"), F.size("words")).alias("g")).select("k", "g.*")
    link = base.where("id IS NOT NULL").groupBy("id").agg(F.min("k").alias("k_of_id"))
    late = titles.join(link, "id", "left").select(F.coalesce("k", "k_of_id").alias("k"), "annotator", "title", "annotated_ts", "annotation_id").where("k IS NOT NULL AND annotator IS NOT NULL")
    order = F.struct(F.coalesce("annotated_ts", F.lit(0).cast("timestamp")), F.coalesce("annotation_id", F.lit(0).cast("long")))
    late = late.groupBy("k", "annotator").agg(F.max_by(F.struct("title"), order).alias("t")).groupBy("k").agg(F.collect_list(F.struct("annotator", "t.title")).alias("titles"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            voices, words = b.column(2), b.column(1)
            names, at = voices.keys.to_pylist(), voices.offsets.to_numpy()
            lists, marks = voices.items, voices.items.values.fill_null(UNKNOWN).to_numpy(zero_copy_only=False)
            marks = np.where((marks == 0) | (marks == 1), marks, UNKNOWN).astype(np.int8)
            cut, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            who, what = [], []
            for i, (n, titled) in enumerate(zip(pa.compute.list_value_length(words).to_pylist(), b.column(3).to_pylist())):
                titled, full, own = {t["annotator"]: t["title"] for t in titled or ()}, {}, None
                for j in range(at[i], at[i + 1]):
                    a, have = names[j], marks[cut[j] : cut[j + 1]][:n] if there[j] else None
                    if have is None or len(have) < n:
                        own = own or [w or "" for w in words[i].as_py()]
                        m = complete(own, None if have is None else have.tolist(), titled.get(a), a in titled)
                        have = None if m is None else np.array(m, np.int8)
                    full[a] = have
                for a in titled.keys() - full.keys():
                    own = own or [w or "" for w in words[i].as_py()]
                    full[a] = np.array(complete(own, None, titled[a], True), np.int8)
                kept = sorted(a for a, m in full.items() if m is not None and len(m))
                who.append(kept)
                what.append(b"".join(full[a].tobytes() for a in kept))
            yield pa.RecordBatch.from_arrays([b.column(0), words, pa.array(who, pa.list_(pa.string())), pa.array(what, pa.binary())], names=["k", "words", "who", "marks"])

    return base.select("k", "words", "annotators").join(late, "k", "left").select("k", "words", "annotators", "titles").mapInArrow(build, "k long, words array<string>, who array<string>, marks binary")


#: Sums of an annotator: marks on words with label 1 and how many of them are 0; on words with label 0 and how many of them are 1.
SUMS = ("n1", "e1", "n0", "e0")
#: What stands for sums before the first round: a rate of missed words of 0.3, and of added ones of 0.1.
START = (1e6, 3e5, 1e6, 1e5)
#: Marks that are dealt with at once.
CHUNK = 2_000_000


class Votes:
    """The marks of some items as flat arrays: one entry a mark, told by item, annotator and word."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.size = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        voices = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.marked = voices > 0
        names = b.column(2).flatten().dictionary_encode()
        self.names, self.who = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
        self.mark = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int8)
        self.item = np.repeat(np.arange(len(self.size)), self.size)  # item of each word
        owner = np.repeat(np.arange(len(self.size)), voices)  # item of each voice
        span = self.size[owner]
        self.voice = np.repeat(np.arange(len(owner)), span)
        first = np.cumsum(self.size) - self.size
        self.word = np.arange(len(self.mark)) + np.repeat(first[owner] - (np.cumsum(span) - span), span)

    def labels(self, sums: np.ndarray, title_words: float) -> tuple[np.ndarray, np.ndarray]:
        """Label of every word, and how much further the other label is; sums: SUMS of each voice."""
        miss, extra = bounded_rate(sums[:, 1], sums[:, 0]), bounded_rate(sums[:, 3], sums[:, 2])
        kept, left = np.log1p(-miss) - np.log(extra), np.log1p(-extra) - np.log(miss)
        far = np.where(self.mark == 1, kept[self.voice], 0.0) - np.where(self.mark == 0, left[self.voice], 0.0)
        share = np.minimum(0.5, title_words / self.size)
        gain = np.bincount(self.word, far, len(self.item)) - np.log((1 - share) / share)[self.item]
        return (gain > 0) & self.marked[self.item], np.abs(gain)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = np.array([len(x) for x in b.column(3).to_pylist()])
        part = np.cumsum(size) // CHUNK
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(size) else ()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield b.slice(lo, hi - lo)


class Consensus:
    """Runs the rounds; ``reliability`` has the annotators, ``labels`` the items."""

    def __init__(self, gold: DataFrame, titles: DataFrame, rounds: int = 30, few: int = 500_000) -> None:
        self.items, self.few = cut_lineage(items(gold, titles), "items"), few
        self.known: dict[str, tuple[float, ...]] | None = {}
        self.sums: DataFrame | None = None
        self.words, last = 4.0, None
        schema = "annotator string, n1 long, e1 long, n0 long, e0 long, kept long, n_items long"
        for _ in range(rounds):
            sums = self._rows().mapInArrow(self._sums(), schema).groupBy("annotator").agg(*(F.sum(c).alias(c) for c in (*SUMS, "kept", "n_items")))
            sums = cut_lineage(sums, "sums")
            self.sums = sums.where("annotator IS NOT NULL")
            kept, n_items, now = sums.agg(F.sum("kept"), F.sum(F.expr("if(annotator IS NULL, n_items, 0)")), F.sum(F.xxhash64(*SUMS, "annotator").cast("decimal(38,0)"))).first()
            self.words = max(1.0, kept / n_items) if n_items else 4.0
            rows = self.sums.select("annotator", *SUMS).limit(few + 1).collect()
            self.known = {r[0]: tuple(map(float, r[1:])) for r in rows} if len(rows) <= few else None
            if now == last:
                break
            last = now

    def _rows(self) -> DataFrame:
        """Items, with the sums of their annotators where these are too many to be handed out."""
        if self.known is not None:
            return self.items
        each = self.items.select("k", F.explode("who").alias("annotator")).join(self.sums.select("annotator", F.array(*(F.col(c).cast("double") for c in SUMS)).alias("s")), "annotator")
        by = each.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("annotator", "s"))).alias("m"))
        return self.items.join(by, "k", "left").select("k", "words", "who", "marks", F.flatten(F.transform("who", lambda a: F.col("m")[a])).alias("sums"))

    def _judge(self):
        """Flat marks, labels and distances of the chunks of a batch."""
        shared = self.items.sparkSession.sparkContext.broadcast(self.known)  # at most ``few`` rows
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Votes, np.ndarray, np.ndarray]]:
            for b in _chunks(batches):
                v = Votes(b)
                if b.num_columns > 4:
                    sums = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                else:
                    sums = np.array([shared.value.get(x, START) for x in v.names], float).reshape(-1, 4)[v.who]
                yield b, v, *v.labels(sums, words)

        return run

    def _sums(self):
        judge = self._judge()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, v, label, _ in judge(batches):
                if not len(v.mark):
                    continue
                own, at = v.who[v.voice], label[v.word]
                count = lambda x, own=own, v=v: np.bincount(own[x], minlength=len(v.names))
                cols = [count((v.mark != UNKNOWN) & at), count((v.mark == 0) & at), count((v.mark != UNKNOWN) & ~at), count((v.mark == 1) & ~at)]
                items_ = np.bincount(v.who, minlength=len(v.names))
                total = [0, 0, 0, 0, int(label.sum()), int(v.marked.sum())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*v.names, None], pa.string()), *(pa.array(np.append(x, t).astype(np.int64)) for x, t in zip((*cols, np.zeros_like(items_), items_), total))],
                    names=["annotator", *SUMS, "kept", "n_items"],
                )

        return run

    def labels(self) -> DataFrame:
        """(k, word_pos, word, label, confidence) for every word of an item with marks."""
        judge = self._judge()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, v, label, gain in judge(batches):
                keep = v.marked[v.item]
                at = np.arange(len(v.item)) - (np.cumsum(v.size) - v.size)[v.item]
                sure = np.round(1 / (1 + np.exp(-np.minimum(gain, 40.0))), 6)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(v.item[keep])), pa.array(at[keep]), b.column(1).flatten().filter(pa.array(keep)), pa.array(label[keep].astype(np.int32)), pa.array(sure[keep])],
                    names=["k", "word_pos", "word", "label", "confidence"],
                )

        return self._rows().mapInArrow(run, "k long, word_pos long, word string, label int, confidence double")

    def agreement(self) -> DataFrame:
        """(k, n_annotators, title, agreement): the mean over words of the share of marks that equal the label."""
        judge = self._judge()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, v, label, _ in judge(batches):
                n = len(v.size)
                item, known = v.item[v.word], v.mark != UNKNOWN
                total, same = np.bincount(item[known], minlength=n), np.bincount(item[known & (v.mark == label[v.word])], minlength=n)
                ends = np.cumsum(v.size)
                titles = [" ".join(w or "" for w, x in zip(words, label[e - s : e]) if x) if m else None for words, e, s, m in zip(b.column(1).to_pylist(), ends, v.size, v.marked)]
                share = pa.array(np.round(same / np.maximum(total, 1), 6), mask=total == 0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.list_value_length(b.column(2)), pa.array(titles, pa.string()), share], names=["k", "n_annotators", "title", "agreement"])

        return self._rows().mapInArrow(run, "k long, n_annotators int, title string, agreement double")

    def reliability(self) -> DataFrame:
        """(annotator, n_items, miss_rate, extra_rate, miss_bound, extra_bound, keep_weight, leave_weight, weight): the weights that decide the
        labels, of marks that keep a word and of marks that leave one out, and both together."""
        if self.sums is None:
            raise ValueError("no rounds were run")
        names = ["annotator", "n_items", "miss_rate", "extra_rate", "miss_bound", "extra_bound", "keep_weight", "leave_weight", "weight"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n1, e1, n0, e0 = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3, 4, 5))
                miss, extra = bounded_rate(e1, n1), bounded_rate(e0, n0)
                rate = lambda e, n: pa.array(np.round(e / np.maximum(n, 1), 6), mask=n == 0)
                kept, left = np.log1p(-miss) - np.log(extra), np.log1p(-extra) - np.log(miss)
                rest = (miss, extra, kept, left, kept + left)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rate(e1, n1), rate(e0, n0), *(pa.array(np.round(x, 6)) for x in rest)], names=names)

        return self.sums.select("annotator", "n_items", *SUMS).mapInArrow(run, "annotator string, n_items long, " + ", ".join(f"{c} double" for c in names[2:]))
