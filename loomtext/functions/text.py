"""Text functions as column expressions; all of them stay inside the JVM.

Several notions of "word" live side by side on purpose; each function says which one it uses.
Null in, null out, unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space by the rules of Unicode strings (more than a regex \s or trim).
SPACE = r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Punctuation that is stripped at the edges of a word; the second set has dashes too.
EDGE = ".,;:!?\"'()[]{}<>*`“”‘’«»…"
EDGE_DASH = EDGE + "-–—"
#: Quotes around a title, and marks at its end.
QUOTES, ENDS = "\"“”«»‘’' ", ".!?:;"
#: Suffixes of the light stemmer, in the order in which they are tried.
SUFFIXES = ("ing", "ed", "es", "s", "ly", "er")
#: Beginnings of a title that is a refusal.
REFUSAL = ("i cannot", "i can't", "i can not", "i'm sorry", "i am sorry", "i'm unable", "as an ai", "i apologize")
#: Fixed value: pieces of text before byte-pair merging; they cover the text without gaps.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: ideographs, kana and hangul, which bound a word like a mark.
UNSPACED = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often the result refers to it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def strip(c) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize(c) -> Column:
    """Lower case, runs of white space as one blank, stripped: the key of exact copies."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), f"[{SPACE}]+", " "), "^ | $", "")


def split_space(c) -> Column:
    """Words between white space, as they stand; an empty text has none."""
    return let(normalize_space(c), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ")))


def normalize_space(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), f"[{SPACE}]+", " "), "^ | $", "")


def word_runs(c) -> Column:
    """Runs of letters and digits of any script, lower case."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ascii_words(c) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def letter_runs(c) -> Column:
    """Runs of letters, lower case."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\p{L}+)"), F.lit(1))


def bare_words(c, chars: str = EDGE_DASH, lower: bool = False) -> Column:
    """Words between white space without punctuation at their edges; inner marks stay (c++, node.js, don't)."""
    words = F.transform(split_space(c), lambda w: F.btrim(w, F.lit(chars)))
    words = F.filter(words, lambda w: w != "")
    return F.transform(words, F.lower) if lower else words


def shingles(words: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` words; fewer words make one run, none make none."""

    def of(w: Column) -> Column:
        size = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(size >= n, F.array_distinct(runs)).when(size > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def bucket(length) -> Column:
    """Length bucket of a text; null outside of [20, 8000]."""
    n = _col(length)
    return F.when(n.between(20, 99), "short").when(n.between(100, 399), "medium").when(n.between(400, 1499), "long").when(n.between(1500, 8000), "very_long")


def sha1_id(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.encode(_col(c), "UTF-8")), 1, 16))


def iso_seconds(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def floor_title(c, n: int = 5) -> Column:
    """The first words with a letter or digit: the title that needs no model."""
    return F.array_join(F.slice(F.filter(split_space(c), lambda w: w.rlike(r"[\p{L}\p{N}]")), 1, n), " ")


def clean_title(raw) -> Column:
    """First line of an answer without closed reasoning, outer quotes and end punctuation.

    Reasoning that never closes hides all that follows it. A null answer is an empty title.
    """
    t = F.regexp_replace(F.coalesce(_col(raw), F.lit("")), "(?s)<think>.*?</think>", "")
    t = strip(F.regexp_replace(t, "(?s)<think>.*", ""))
    line = strip(F.regexp_replace(t, r"(?s)[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}].*", ""))
    return strip(F.rtrim(F.btrim(line, F.lit(QUOTES)), F.lit(ENDS)))


def is_refusal(title) -> Column:
    low = F.lower(_col(title))
    hit = F.lit(False)
    for p in REFUSAL:
        hit = hit | low.startswith(p)
    return F.coalesce(hit, F.lit(False))


def is_subsequence(words: Column, of: Column) -> Column:
    """The words occur in ``of`` in their order; no words are no subsequence."""
    found = F.aggregate(of, F.lit(0), lambda at, w: F.when((at < F.size(words)) & (F.try_element_at(words, at + 1) == w), at + 1).otherwise(at))
    return (F.size(words) > 0) & (found == F.size(words))


def all_present(words: Column, of: Column) -> Column:
    return (F.size(words) > 0) & (F.size(F.array_except(words, of)) == 0)


def stem(w: Column) -> Column:
    """Cuts the first of the suffixes that the word ends with, where more than three letters stay before it."""
    out = w
    for s in reversed(SUFFIXES):
        out = F.when(w.endswith(s) & (F.length(w) > len(s) + 3), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return out


def is_swap(a: Column, b: Column) -> Column:
    """Equal length of five or more, alike but for two neighbours that changed places."""
    n = F.length(a)
    diff = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i = F.try_element_at(diff, F.lit(1))
    swapped = (F.substring(a, i, F.lit(1)) == F.substring(b, i + 1, F.lit(1))) & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i, F.lit(1)))
    ok = (F.size(diff) == 2) & (F.try_element_at(diff, F.lit(2)) == i + 1) & swapped
    return F.when((n == F.length(b)) & (n >= 5), F.coalesce(ok, F.lit(False))).otherwise(F.lit(False))


def one_edit(a: Column, b: Column) -> Column:
    """Words of five letters or more that one insertion, deletion, replacement or swap makes equal; equal words are not."""
    return (F.least(F.length(a), F.length(b)) >= 5) & ((F.levenshtein(a, b) == 1) | is_swap(a, b))


def close_word(a: Column, b: Column) -> Column:
    """Equal words of any length, or one edit apart at five letters or more; a swap is two edits here."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b) <= 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; two empty ones have 0."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def set_prf(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of word set ``a`` against ``b``."""
    both = F.size(F.array_intersect(a, b))
    na, nb = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    p = F.when(na > 0, both / na).otherwise(F.lit(0.0))
    r = F.when(nb > 0, both / nb).otherwise(F.lit(0.0))
    return p, r, F.when(both > 0, 2.0 * both / (na + nb)).otherwise(F.lit(0.0))


def common_words(a: Column, b: Column) -> Column:
    """Size of the intersection of two word multisets."""
    times = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))


def multiset_f1(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * common_words(a, b) / total).otherwise(F.lit(0.0))


def latin_share(c) -> Column:
    """Share of Latin letters among letters; a text without letters has 1."""
    letters = F.length(F.regexp_replace(_col(c), r"\P{L}", ""))
    latin = F.length(F.regexp_replace(_col(c), r"[^\p{IsLatin}&&\p{L}]", ""))
    return F.when(letters > 0, latin / letters).otherwise(F.lit(1.0))


def has_word(text, literal: str) -> Column:
    """The literal stands in the text, bounded by anything but letters and digits; ideographs, kana and hangul bound too."""
    inner = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]"
    return F.regexp_like(_col(text), F.lit(rf"(?<!{inner})\Q{literal}\E(?!{inner})"))


def pre_split(c) -> Column:
    """Pieces before byte-pair merging; joined they are the text. White space is that of ``SPACE``, which \\s isn't here."""
    form = PRE_SPLIT.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    return F.regexp_extract_all(_col(c), F.lit(f"({form})"), F.lit(1))
