"""Choosing the words of a title by their scores, and the intervals and numbers of words.

Words come as an array of struct(word, start, end, score) in text order; the choice is a column expression over it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: The rules of decoding where a model file has none of its own.
DECODING = {"threshold": 0.5, "min_words": 3, "max_words": 6, "keep_all_up_to": 4}
#: Marks that join two letters or digits into one word.
JOINERS = "-'’"


def _sorted(words: Column, *keys) -> Column:
    """Words in order of ``keys``, which stand in front of them in a struct: so no comparison is a function of its own."""
    return F.transform(F.sort_array(F.transform(words, lambda w: F.struct(*(k(w).alias(f"k{i}") for i, k in enumerate(keys)), w.alias("w")))), lambda x: x["w"])


def top(words: Column, k: Column | int) -> Column:
    """The k words of the highest scores; equal scores keep text order."""
    return F.slice(_sorted(words, lambda w: -w["score"], lambda w: w["start"]), 1, F.lit(k) if isinstance(k, int) else k)


def in_text_order(words: Column) -> Column:
    return _sorted(words, lambda w: w["start"])


def without(words: Column, stop: list[str], least: int) -> Column:
    """Without stop words, unless fewer than ``least`` words would stay."""
    left = F.filter(words, lambda w: ~F.lower(F.btrim(T.strip(w["word"]), F.lit(T.EDGE_DASH))).isin(*stop)) if stop else words
    return F.when(F.size(left) >= least, left).otherwise(words)


def choose(words: Column, mode: str = "hybrid", budget: int | None = None, stop: list[str] | None = None, **rules) -> Column:
    """Chosen words in text order.

    budget: the ``budget`` best (max_words by default). threshold: all at or over the threshold. hybrid: of the max_words best those at
    or over the threshold, but at least the min_words best; short texts keep all words. Words without letter or digit never count.
    """
    r = DECODING | rules

    def pick(w: Column) -> Column:
        if mode == "budget" or budget is not None:
            return top(w, r["max_words"] if budget is None else budget)
        sure = F.filter(w, lambda x: x["score"] >= r["threshold"])
        if mode == "threshold":
            return sure
        if mode != "hybrid":
            raise ValueError(f"unknown mode {mode!r}")

        def hybrid(first: Column) -> Column:
            best = F.filter(F.slice(first, 1, r["max_words"]), lambda x: x["score"] >= r["threshold"])
            return F.when(F.size(w) <= r["keep_all_up_to"], w).when(F.size(best) >= r["min_words"], best).otherwise(F.slice(first, 1, r["min_words"]))

        return T.let(top(w, max(r["max_words"], r["min_words"])), hybrid)

    spoken = F.filter(words, lambda w: w["word"].rlike(r"[\p{L}\p{N}]"))
    return in_text_order(T.let(T.let(spoken, lambda w: without(w, stop or [], r["min_words"])), pick))


def join_words(words: Column) -> Column:
    """The chosen words without white space and punctuation at their edges, one blank between; words of which nothing is left are dropped."""
    bare = F.transform(words, lambda w: F.btrim(T.strip(w["word"]), F.lit(T.EDGE_DASH)))
    return F.array_join(F.filter(bare, lambda w: w != ""), " ")


def with_offsets(pieces: Column) -> Column:
    """Adjoining pieces as array of struct(piece, start, end): offsets are running lengths."""
    zero = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<piece:string,start:int,end:int>>))")
    return F.aggregate(
        pieces,
        zero,
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(p.alias("piece"), acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end")))).alias("out")),
        lambda acc: acc["out"],
    )


def word_starts(pieces: Column) -> Column:
    """Which pieces begin a word: the first, and those that begin with white space or another mark, but for a joiner between two letters or digits.

    Letters behind a mark go on with its word: "foo.bar" is "foo" and ".bar", "(abc)" is "(abc" and ")".
    """
    solid = r"^[\p{L}\p{N}]"
    at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    last = lambda p: F.substring(p, F.greatest(F.length(p), F.lit(1)), F.lit(1))

    def starts(p: Column, i: Column) -> Column:
        after = F.when(F.length(p) > 1, F.substring(p, F.lit(2), F.lit(1))).otherwise(F.substring(at(i + 1), F.lit(1), F.lit(1)))
        joins = p.rlike(f"^[{JOINERS}]") & last(at(i - 1)).rlike(solid) & after.rlike(solid)
        return (i == 0) | ~(p.rlike(solid) | joins)

    return F.transform(pieces, starts)


def word_numbers(pieces: Column) -> Column:
    """Word number of each piece, from 0. Computed over array of strings that adjoin (see ``word_starts``)."""

    def number(starts: Column) -> Column:
        first = F.filter(F.transform(starts, lambda s, i: F.when(s, i).otherwise(-1)), lambda i: i >= 0)
        return T.let(first, lambda f: F.flatten(F.transform(f, lambda x, k: F.array_repeat(k, (F.coalesce(F.get(f, k + 1), F.size(starts)) - x).cast("int")))))

    return T.let(word_starts(pieces), number)


def merge_intervals(spans: Column) -> Column:
    """array of struct(start, end) sorted by start: intervals that overlap or touch become one."""
    zero = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        own = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, own))

    return F.aggregate(F.array_sort(spans), zero, step)


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """The token [start, end) shares a character with one of the spans."""
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))
