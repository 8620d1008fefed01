"""Scores of 0/1 labels and of titles: precision, recall and F1, votes, agreement between annotators, thresholds, rarity of tokens.

Micro scores add up integer counts and divide last. Everything is one aggregation over row-wise counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    """tp, fp, fn of two 0/1 arrays, as far as both go."""
    n = F.least(F.size(pred), F.size(gold))
    pairs = F.arrays_zip(F.slice(pred, 1, n).alias("p"), F.slice(gold, 1, n).alias("g"))
    count = lambda p, g: F.size(F.filter(pairs, lambda x: (x["p"] == p) & (x["g"] == g))).cast("long")
    return count(1, 1), count(1, 0), count(0, 1)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1, 0 where a denominator is 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(tp, fp, fn), 6).alias("f1")]


def micro(df: DataFrame, *by: str, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Micro scores of token labels, per group of ``by``."""
    tp, fp, fn = confusion(F.col(pred), F.col(gold))
    sums = df.select(*by, tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn")))
    return sums.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def best_of(df: DataFrame, item: str, voice: str) -> DataFrame:
    """Micro scores where each item counts with the voice of the best F1; of equal ones the first by name."""
    tp, fp, fn = confusion(F.col("pred"), F.col("gold"))
    d = df.select(item, voice, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    best = d.groupBy(item).agg(F.min(F.struct(F.round(-f1(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("o"), F.col(voice).alias("v"), "tp", "fp", "fn")).alias("b"))
    return best.agg(*(F.sum(f"b.{c}").alias(c) for c in ("tp", "fp", "fn"))).select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def voices(gold: DataFrame, item: str = "k", words: str = "words", annotators: str = "annotators") -> DataFrame:
    """(item, annotator, marks) of marks that are there; each array is cut to the words."""
    d = gold.select(item, F.size(words).alias("_n"), F.explode(annotators).alias("annotator", "marks")).where("marks IS NOT NULL")
    return d.select(item, "annotator", F.slice("marks", 1, F.greatest("_n", F.lit(1))).alias("marks"))


def votes(gold: DataFrame, least: int = 2, item: str = "k") -> DataFrame:
    """(item, word_pos, votes, label): how many annotators keep each word; kept by ``least`` or more is a 1. Marks that stop early are no votes."""
    v = voices(gold, item).select(item, F.posexplode("marks").alias("word_pos", "m")).groupBy(item, "word_pos").agg(F.sum("m").alias("votes"))
    words = gold.select(item, F.posexplode("words").alias("word_pos", "word"))
    n = F.coalesce("votes", F.lit(0).cast("long"))
    return words.join(v, [item, "word_pos"], "left").select(item, F.col("word_pos").cast("long").alias("word_pos"), n.alias("votes"), (n >= least).cast("int").alias("label"))


def pairwise(gold: DataFrame, item: str = "k") -> DataFrame:
    """(a, b, n_items, f1): micro F1 of each annotator against each other over the items of both."""
    v = voices(gold, item)
    d = v.select(item, F.col("annotator").alias("a"), F.col("marks").alias("pred")).join(v.select(item, F.col("annotator").alias("b"), F.col("marks").alias("gold")), item).where("a <> b")
    n = d.groupBy("a", "b").agg(F.count("*").alias("n_items"))
    return micro(d, "a", "b").join(n, ["a", "b"]).select("a", "b", "n_items", "f1")


def leave_one_out(gold: DataFrame, item: str = "k") -> DataFrame:
    """(annotator, f1): each annotator against the best other annotator of every item."""
    v = voices(gold, item)
    d = v.select(item, "annotator", F.col("marks").alias("pred")).join(v.select(item, F.col("annotator").alias("other"), F.col("marks").alias("gold")), item).where("annotator <> other")
    tp, fp, fn = confusion(F.col("pred"), F.col("gold"))
    d = d.select(item, "annotator", "other", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    best = d.groupBy(item, "annotator").agg(F.min(F.struct(F.round(-f1(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("o"), "other", "tp", "fp", "fn")).alias("b"))
    s = best.groupBy("annotator").agg(F.count("*").alias("n_items"), *(F.sum(f"b.{c}").alias(c) for c in ("tp", "fp", "fn")))
    return s.select("annotator", "n_items", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


def sweep(scored: DataFrame, score: str, gold: str) -> DataFrame:
    """(step, f1) for the thresholds 0.05, 0.10 … 0.95 (step / 20), over rows of one word each."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(19))).alias("step")
    d = scored.select(score, gold, steps).withColumn("on", F.col(score) * 20 >= F.col("step"))
    n = lambda c: F.sum(c.cast("long"))
    g = d.groupBy("step").agg(n(F.col("on") & (F.col(gold) == 1)).alias("tp"), n(F.col("on") & (F.col(gold) == 0)).alias("fp"), n(~F.col("on") & (F.col(gold) == 1)).alias("fn"))
    return g.select("step", "tp", "fp", "fn", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


def best_step(swept: DataFrame) -> DataFrame:
    """The row of the greatest F1 of a sweep; of equal ones the smallest step."""
    row = F.struct((-F.col("f1")).alias("o"), *(F.col(c) for c in swept.columns))
    return swept.agg(F.min(row).alias("b")).where("b IS NOT NULL").select(*(f"b.{c}" for c in swept.columns))


def inverse_frequency(docs: DataFrame, id_col: str, tokens: Column, least: int = 1) -> DataFrame:
    """(token, df, idf) with idf = ln(total / (1 + df)), over all documents."""
    total = docs.count()
    d = docs.select(id_col, F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return d.where(F.col("df") >= least).select("token", "df", F.round(F.log(F.lit(float(total)) / (1 + F.col("df"))), 6).alias("idf"))


def rarest(docs: DataFrame, id_col: str, tokens: Column, n: int) -> DataFrame:
    """(id, pos, token): the ``n`` rarest tokens of each document; of equal ones those that come first."""
    # one row for each token of a document, with its first places: as many as can be among the result
    places = docs.select(id_col, F.posexplode(tokens).alias("pos", "token")).groupBy(id_col, "token").agg(F.slice(F.sort_array(F.collect_list("pos")), 1, n).alias("at"))
    total = docs.count()
    df = places.groupBy("token").agg(F.count("*").alias("df"))
    idf = df.select("token", F.round(F.log(F.lit(float(total)) / (1 + F.col("df"))), 6).alias("idf"))
    d = places.join(idf, "token").select(id_col, "token", "idf", F.explode("at").alias("pos"))
    w = Window.partitionBy(id_col).orderBy(F.desc("idf"), "pos")
    return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select(id_col, F.col("pos").cast("long").alias("pos"), "token")


def snapped(words: Column, pred: Column, share: float = 0.34) -> Column:
    """Word numbers whose tokens are kept on average by ``share`` or more."""
    ids = F.array_distinct(words)
    own = lambda w: F.filter(F.arrays_zip(words.alias("w"), pred.alias("p")), lambda x: x["w"] == w)
    mean = lambda w: F.aggregate(own(w), F.lit(0.0), lambda a, x: a + x["p"]) / F.size(own(w))
    return F.filter(ids, lambda w: mean(w) >= share)
