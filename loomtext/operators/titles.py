"""Titles against messages: cleaning, validity, agreement of two titlings, word matching and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LIMIT = 1200


def cleaned(titles: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``clean`` and ``refused``."""
    return titles.withColumn("clean", T.clean_title(raw)).withColumn("refused", T.is_refusal(F.col("clean")))


def validity(titles: DataFrame, messages: DataFrame, title: str = "clean", text: str = "text", limit: int | None = None) -> DataFrame:
    """Titles of known messages with n_words, subsequence and words_present, over ASCII words; ``limit`` cuts the message first."""
    d = titles.join(messages.select("id", F.col(text).alias("_text")), "id")
    body = F.substring("_text", 1, limit) if limit else F.col("_text")
    d = d.withColumn("_w", T.ascii_words(title)).withColumn("_m", T.ascii_words(body))
    return d.select(
        *titles.columns,
        F.size(T.split_space(title)).alias("words_in_title"),
        T.is_subsequence(F.col("_w"), F.col("_m")).alias("is_subsequence"),
        T.all_present(F.col("_w"), F.col("_m")).alias("all_present"),
    )


def agreement(a: DataFrame, b: DataFrame, at_least: float | None = 0.4) -> DataFrame:
    """(id, agreement) of titles that both titlings have, rounded to three places; repeated ids of ``b`` stay, those of ``a`` are looked up."""
    words = lambda c: F.array_distinct(T.bare_words(F.lower(c), T.EDGE))
    j = b.select("id", words(F.col("title")).alias("_b")).join(a.select("id", words(F.col("title")).alias("_a")), "id")
    out = j.select("id", F.round(T.jaccard(F.col("_a"), F.col("_b")), 3).alias("agreement"))
    return out if at_least is None else out.where(F.col("agreement") >= at_least)


def band(agreement: Column) -> Column:
    return F.when(agreement < 0.25, "[0, .25)").when(agreement < 0.4, "[.25, .4)").when(agreement < 0.6, "[.4, .6)").otherwise("[.6, 1]")


def match_rule(word: Column, vocabulary: Column) -> Column:
    """How a word is found in a vocabulary: 'exact', 'stem', 'typo' or 'none'; the verdict, not the word found."""
    stemmed = T.stem(word)
    return (
        F.when(F.array_contains(vocabulary, word), "exact")
        .when(F.exists(vocabulary, lambda v: T.stem(v) == stemmed), "stem")
        .when(F.exists(vocabulary, lambda v: T.one_edit(v, word)), "typo")
        .otherwise("none")
    )


def align_cursor(title_words: Column, message_words: Column) -> Column:
    """Positions in the message (from 1, 0 for none) of the title's words, and whether they are in order.

    Each word takes its first occurrence behind the one before, else its first occurrence anywhere, which puts the title out of order.
    struct(at array<int>, ordered boolean)
    """
    zero = F.expr("named_struct('at', cast(array() as array<int>), 'cursor', 0, 'ordered', true)")

    def step(acc: Column, w: Column) -> Column:
        # the first place behind the cursor: the rest of the words is searched, and its offset added
        tail = F.array_position(F.slice(message_words, acc["cursor"] + 1, F.greatest(F.size(message_words), F.lit(1))), w)
        first = F.array_position(message_words, w)
        at = F.when(tail > 0, acc["cursor"] + tail).otherwise(first).cast("int")
        return F.struct(
            F.concat(acc["at"], F.array(at)).alias("at"),
            F.when(tail > 0, at).otherwise(acc["cursor"]).alias("cursor"),
            (acc["ordered"] & (tail > 0)).alias("ordered"),
        )

    return F.aggregate(title_words, zero, step, lambda acc: F.struct(acc["at"].alias("at"), acc["ordered"].alias("ordered")))


def edit_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b, of the words (w, unique) that are one edit apart as ``one_edit`` has it.

    Each word stands under itself and itself without one letter: words one insertion, deletion, replacement or swap apart
    share one of these, and a key has few words, since they differ in one letter.
    """
    less = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, F.length("w"))))
    keys = F.transform(F.array_distinct(F.concat(F.array("w"), less)), lambda w: F.xxhash64(w))
    k = words.where(F.length("w") >= 5).select("w", F.explode(keys).alias("key"))
    a, b = k.withColumnRenamed("w", "a"), k.withColumnRenamed("w", "b")
    return a.join(b, "key").where("a < b").select("a", "b").distinct().where(T.one_edit(F.col("a"), F.col("b")))


def label_status(titles: DataFrame, messages: DataFrame) -> DataFrame:
    """The labeling funnel: one status per title, in the order in which the reasons are tested.

    no_title, refused, no_message, aligned_exact, aligned_tolerant, not_aligned.
    """
    d = titles.join(messages.select("id", F.substring("text", 1, LIMIT).alias("_text")), "id", "left")
    d = d.withColumn("_w", T.bare_words(F.lower(F.coalesce("clean", F.lit("")))))
    d = d.withColumn("_m", T.bare_words(F.lower(F.coalesce("_text", F.lit("")))))
    d = d.withColumn("_rules", F.transform("_w", lambda w: match_rule(w, F.col("_m"))))
    status = (
        F.when(F.size("_w") == 0, "no_title")
        .when(F.col("refused"), "refused")
        .when(F.col("_text").isNull(), "no_message")
        .when(F.forall("_rules", lambda r: r == "exact"), "aligned_exact")
        .when(F.forall("_rules", lambda r: r != "none"), "aligned_tolerant")
        .otherwise("not_aligned")
    )
    return d.select(*titles.columns, status.alias("status"))


def latest_titles(titles: DataFrame, lookup: DataFrame) -> DataFrame:
    """(k, annotator, title): the latest non-empty title; rows without ``k`` are linked by ``id``. lookup: (id, k), unique ids."""
    from .sampling import last_wins

    d = titles.join(lookup.select("id", F.col("k").alias("_k")), "id", "left").withColumn("k", F.coalesce("k", "_k"))
    d = d.where("k IS NOT NULL AND title IS NOT NULL").where(T.strip("title") != "")
    return last_wins(d.select("k", "annotator", "title", "annotated_ts", "annotation_id"), ["k", "annotator"], "annotated_ts", "annotation_id").select("k", "annotator", "title")


def not_done(messages: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Messages without a record in ``done``; a record of an error counts as done."""
    return messages.join(done.select(id_col).distinct(), id_col, "left_anti")


def check_labels(todo: DataFrame, labels: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """Status of each hand label against the list of items: unknown, duplicate, bad_length, impossible or valid; items without one are unlabeled.

    todo: (k, id); labels: (k, title, impossible, ord) in the order of reading.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("k").orderBy("ord"))
    d = labels.withColumn("_n", n).join(todo.select("k", F.lit(True).alias("_known")), "k", "left")
    words = F.size(T.split_space(F.coalesce("title", F.lit(""))))
    status = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("_n") > 1, "duplicate")
        .when(F.coalesce("impossible", F.lit(False)), "impossible")
        .when(~words.between(low, high), "bad_length")
        .otherwise("valid")
    )
    have = d.select("k", status.alias("status"))
    return have.union(todo.select("k").join(labels.select("k").distinct(), "k", "left_anti").withColumn("status", F.lit("unlabeled")))
