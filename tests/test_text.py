"""Text functions against plain Python, over awkward strings."""

import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T

AWKWARD = ["", "   ...  !!  ", "a\xa0b", "x\x1cy", " A  b\tC\n", "é é", "😀 b", "日本 xml", "m² Ⅷ", "c++ log4j2.xml _x_", "don't we-know it’s", "_", "x" * 30, '"Quoted title."', "<think>a</think>\n«Left» \nnext", "<think>open", None]


def column(spark, expr, values=AWKWARD):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(expr).collect()]


def test_strip_and_normalize(spark):
    assert column(spark, T.strip("s")) == [v if v is None else v.strip() for v in AWKWARD]
    assert column(spark, T.normalize("s")) == [v if v is None else " ".join(v.lower().split()) for v in AWKWARD]


def test_words(spark):
    assert column(spark, T.split_space("s"))[:-1] == [v.split() for v in AWKWARD[:-1]]
    plain = [v for v in AWKWARD[:-1] if "́" not in v]
    assert column(spark, T.word_runs("s"), plain) == [re.findall(r"[^\W_]+", v.lower()) for v in plain]
    assert column(spark, T.bare_words("s"))[:-1] == [[w for w in (x.strip(T.EDGE_DASH) for x in v.split()) if w] for v in AWKWARD[:-1]]


def test_shingles(spark):
    get = lambda v: column(spark, T.shingles(T.word_runs("s")), [v])[0]
    assert get("") == []
    assert get("one two") == ["one two"]
    assert get("a b c a b c") == ["a b c", "b c a", "c a b"]


def test_clean_title(spark):
    assert column(spark, T.clean_title("s"), ['"A b."', "<think>x</think> «T!»", "<think>x", "first\nsecond", None, "  "]) == ["A b", "T", "", "first", "", ""]
    assert column(spark, T.is_refusal("s"), ["I'm sorry, no", "As an AI", "A title", None]) == [True, True, False, False]


@pytest.mark.parametrize("a,b,one,close", [("table", "table", False, True), ("table", "tables", True, True), ("table", "talbe", True, False), ("cat", "car", False, False), ("abcde", "badce", False, False), ("house", "hause", True, True)])
def test_edits(spark, a, b, one, close):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(T.one_edit(F.col("a"), F.col("b")), T.close_word(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (one, close)


def test_stem(spark):
    assert column(spark, T.stem(F.col("s")), ["walking", "boxes", "bridges", "quickly", "sing", "cars", "red"]) == ["walk", "boxe", "bridg", "quick", "sing", "cars", "red"]


def test_sets(spark):
    d = spark.createDataFrame([(["a", "b", "b"], ["b", "b", "c"]), ([], [])], "a array<string>, b array<string>")
    rows = d.select(T.multiset_f1(F.col("a"), F.col("b")), T.jaccard(F.col("a"), F.col("b")), T.is_subsequence(F.col("a"), F.col("b")), T.all_present(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == pytest.approx(2 * 2 / 6) and rows[0][1] == pytest.approx(1 / 3) and not rows[0][2]
    assert tuple(rows[1]) == (0.0, 0.0, False, False)


def test_boundaries_and_script(spark):
    assert column(spark, T.has_word("s", "xml"), ["log4j2.xml", "axml", "_xml_", "対xml"]) == [True, False, True, True]
    assert column(spark, T.latin_share("s"), ["abc", "абв", "ab аб", "123"]) == [1.0, 0.0, 0.5, 1.0]


def test_pre_split_covers(spark):
    texts = [v for v in AWKWARD if v]
    assert ["".join(p) for p in column(spark, T.pre_split("s"), texts)] == texts
