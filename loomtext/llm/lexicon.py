"""A word-by-language lexicon, fitted on a bounded sample of labelled messages."""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The languages by their English names.
LANGUAGES = ("English", "French", "Spanish", "German", "Portuguese", "Italian", "Dutch", "Swedish", "Polish", "Russian")

_WORD = re.compile(r"[^\W\d_]+")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def clean_label(column):
    """A language label without outer blanks and with a capital; anything that is no name of a language becomes null."""
    name = F.initcap(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(name.isin(*LANGUAGES), name)


class Lexicon:
    """log P(word | language) up to a constant per word, for words seen often enough in the sample."""

    def __init__(self, scores: dict[str, tuple[float, ...]]) -> None:
        self.scores = scores

    def word_scores(self, text: str) -> list[tuple[float, ...]]:
        get = self.scores.get
        return [s for w in _WORD.findall(text.lower()) if (s := get(w))]

    def best(self, text: str) -> tuple[str | None, float, int]:
        """Language, lead over the second one, and how many words spoke for it."""
        if len(_CYRILLIC.findall(text)) > 3:
            return "Russian", 99.0, 3
        found = self.word_scores(text)
        if not found:
            return None, 0.0, 0
        total = [sum(c) for c in zip(*found)]
        order = sorted(range(len(total)), key=lambda i: -total[i])
        return LANGUAGES[order[0]], total[order[0]] - total[order[1]], sum(1 for s in found if max(s) == s[order[0]])


def fit_lexicon(messages: DataFrame, sample_rows: int = 40_000, min_count: int = 4) -> Lexicon:
    """Counts words by cleaned label over a sample of at most about ``sample_rows`` messages, chosen by the hash of the id.

    The counting runs in Spark; the sample bounds the words that come to the driver. Labels are wrong at times, so each word's shares are smoothed.
    """
    labelled = messages.select("id", "text", clean_label(F.col("language")).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    n = labelled.count()
    share = min(1.0, sample_rows / max(1, n))
    part = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else labelled
    words = part.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word"))
    counts = words.groupBy("word").pivot("lang", list(LANGUAGES)).count()
    total = sum((F.coalesce(F.col(x), F.lit(0)) for x in LANGUAGES), F.lit(0))
    rows = counts.withColumn("total", total).where(F.col("total") >= min_count).collect()
    docs = defaultdict(int, part.groupBy("lang").count().collect())
    size = [max(1, docs[x]) for x in LANGUAGES]
    scores = {}
    for r in rows:
        p = [(r[x] or 0) / n for x, n in zip(LANGUAGES, size)]
        floor = 0.03 * max(p) + 0.5 / sum(size)
        scores[r["word"]] = tuple(math.log(v + floor) for v in p)
    return Lexicon({w: tuple(x - max(s) for x in s) for w, s in scores.items()})
