"""Building a corpus of first messages: filters, funnel counts, exclusion, near-duplicate removal and the language gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import cut_lineage

SHORTEST, LONGEST = 20, 8000
_PRIME = (1 << 31) - 1


def first_user(conversations: DataFrame) -> DataFrame:
    """Conversations whose first turn is the user's, with its stripped ``text``; a null content is empty, a null or empty list is dropped."""
    turn = F.try_element_at("conversation", F.lit(1))
    return conversations.where(turn["role"] == "user").withColumn("text", T.strip(F.coalesce(turn["content"], F.lit(""))))


def harmless(null_passes: bool) -> Column:
    """Rows without the flag. Written so that it reaches the scan; a null flag passes or not."""
    return F.col("toxic").isNull() | (F.col("toxic") == F.lit(False)) if null_passes else F.col("toxic") == F.lit(False)


def by_language(df: DataFrame, languages: list[str], null_toxic_passes: bool) -> DataFrame:
    return df.where(F.col("language").isin(*languages) & harmless(null_toxic_passes))


def usable_length(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.length(text).between(SHORTEST, LONGEST))


def funnel(conversations: DataFrame, languages: list[str], null_toxic_passes: bool) -> DataFrame:
    """Rows that reach each step of the build, in one pass."""
    turn = F.try_element_at("conversation", F.lit(1))
    ok = F.coalesce(F.col("language").isin(*languages) & harmless(null_toxic_passes), F.lit(False))
    user = ok & F.coalesce(turn["role"] == "user", F.lit(False))
    long = user & F.length(T.strip(F.coalesce(turn["content"], F.lit("")))).between(SHORTEST, LONGEST)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return conversations.agg(F.count("*").alias("n_read"), n(ok).alias("n_language"), n(user).alias("n_user"), n(long).alias("n_length"))


def exclude(df: DataFrame, ids: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows whose id isn't in ``ids`` and whose normalized text isn't in ``texts``."""
    keys = texts.select(T.normalize(F.col(texts.columns[0])).alias("_k")).distinct()
    left = df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_anti").withColumn("_k", T.normalize(text_col))
    return left.join(keys, "_k", "left_anti").drop("_k")


def _pairs_of_hashes(n: int) -> list[tuple[int, int]]:
    """Coefficients of the permutations, from a rule: a fixed linear congruential sequence."""
    out, x = [], 12345
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        a = x % (_PRIME - 1) + 1
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append((a, x % _PRIME))
    return out


def band_keys(df: DataFrame, id_col: str, text_col: str, bands: int = 9, rows: int = 13, n: int = 3) -> DataFrame:
    """(id, band, key) of MinHash bands over word shingles, all inside the JVM.

    A text without words has one signature that all such texts share.
    """
    perms = _pairs_of_hashes(bands * rows)
    base = df.select(F.col(id_col).alias("id"), F.transform(T.shingles(T.word_runs(text_col), n), lambda s: F.pmod(F.xxhash64(s), F.lit(_PRIME))).alias("h"))

    def smallest(a: int, c: int) -> Column:
        return F.array_min(F.transform("h", lambda x: (x * F.lit(a) + F.lit(c)) % F.lit(_PRIME)))

    def key(b: int) -> Column:
        return F.xxhash64(*[smallest(a, c) for a, c in perms[b * rows : (b + 1) * rows]])

    return base.select("id", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), key(b).alias("key")) for b in range(bands)])).alias("x")).select("id", "x.band", "x.key")


def near_dedupe(df: DataFrame, id_col: str, text_col: str = "text", bands: int = 9, rows: int = 13, max_rounds: int = 100) -> DataFrame:
    """Rows kept when they are read in order of id and one is dropped as soon as it shares a band with a row kept before.

    That is not connected components: a row whose only near copies were dropped stays. Exact copies are dropped first. A band
    of many rows gives one edge list by its members' order: in each round every row looks only at the smallest undecided and
    whether a kept row stands before it, so no group is expanded into pairs.
    """
    from .sampling import first_wins

    unique = first_wins(df.where(F.col(text_col).isNotNull()), T.normalize(text_col), id_col)
    keys = cut_lineage(band_keys(unique, id_col, text_col, bands, rows), "bands")
    size = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    open_ = cut_lineage(keys.join(size, ["band", "key"], "left_semi"), "bands")  # (id, band, key) of rows that share a band
    kept = unique.select(F.col(id_col).alias("id")).join(open_.select("id").distinct(), "id", "left_anti")
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        low = open_.groupBy("band", "key").agg(F.min("id").alias("low"))
        # the smallest undecided row of all its bands can't be dropped any more
        lead = open_.join(low, ["band", "key"]).groupBy("id").agg(F.min((F.col("id") == F.col("low")).cast("int")).alias("first")).where("first = 1").select("id")
        lead = cut_lineage(lead, "kept")
        kept = kept.union(lead)
        hit = open_.join(lead, "id", "left_semi").select("band", "key").distinct()
        gone = open_.join(hit, ["band", "key"], "left_semi").select("id").distinct()
        open_ = cut_lineage(open_.join(gone, "id", "left_anti"), "bands")
    else:
        raise RuntimeError("near_dedupe did not settle")
    return unique.join(kept.withColumnRenamed("id", id_col), id_col, "left_semi")


def function_words(df: DataFrame, n: int, text: str = "text", lang: str = "lang", id_col: str = "id") -> DataFrame:
    """(of, word): the ``n`` words that most texts of each label have; a table of n rows a language."""
    words = df.select(id_col, lang, F.explode(F.array_distinct(T.letter_runs(text))).alias("word")).distinct()
    counts = words.groupBy(lang, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(lang).orderBy(F.desc("n"), "word")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select(F.col(lang).alias("of"), "word")


def language_gate(df: DataFrame, words: DataFrame, id_col: str, text: str = "text", lang: str = "lang", min_tokens: int = 12, min_best: float = 0.2, tolerance: float = 0.5, min_latin: float = 0.5) -> DataFrame:
    """Adds ``rejected``: the text is in another script, or the rate of its label's function words is under ``tolerance`` of the best language's.

    Texts with few words, or without a language that fits well, are kept. words: (of, word), a small table of a fixed number of words a
    language; it is collected and becomes part of the expression.
    """
    table: dict[str, list[str]] = {}
    for of, word in words.select("of", "word").orderBy("of", "word").collect():
        table.setdefault(of, []).append(word)
    langs = sorted(table)
    where: dict[str, list[int]] = {}
    for i, of in enumerate(langs):
        for w in table[of]:
            where.setdefault(w, []).append(i)
    lists = F.create_map(*[x for w, at in where.items() for x in (F.lit(w), F.array(*map(F.lit, at)))]) if where else F.expr("cast(map() as map<string, array<int>>)")
    # each word is looked up once; what is counted are the places of the languages that have it
    hits = F.flatten(F.filter(F.transform(T.letter_runs(text), lambda w: lists[w]), lambda x: x.isNotNull()))
    d = df.withColumn("_x", F.explode(F.array(F.struct(F.size(T.letter_runs(text)).alias("n"), hits.alias("hits")))))
    total = F.col("_x.n")
    count = lambda i: F.size(F.filter("_x.hits", lambda x: x == i))
    best = F.greatest(*map(count, range(len(langs))), F.lit(0), F.lit(0)) / total
    own = F.coalesce(*[F.when(F.col(lang) == of, count(i)) for i, of in enumerate(langs)], F.lit(0)) / total
    off = (total >= min_tokens) & (best >= min_best) & (own < tolerance * best)
    return d.withColumn("rejected", F.when(total > 0, off).otherwise(F.lit(False)) | (T.latin_share(text) < min_latin)).drop("_x")
