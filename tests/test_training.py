"""Words of tokens, alignment, training rows, endpoints and the shared folder, each against a table of cases."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import session
from loomtext.functions import text as T
from loomtext.operators import decode, labels, sampling, tagger, titles, training
from loomtext.plans import models
from loomtext.sources import modelfile, teacher

#: Texts and the words that their pieces make up.
WORDS = [
    ("foo.bar", ["foo", ".bar"]),
    ("12.5", ["12", ".5"]),
    ("a (abc) b", ["a", " (abc", ")", " b"]),
    ("what?!", ["what", "?!"]),
    ("l'école d’art", ["l'école", " d’art"]),
    ("Pourrais-tu -tu", ["Pourrais-tu", " -tu"]),
    ("co-op's plan", ["co-op's", " plan"]),
    ("x\n\n  y", ["x", "\n\n ", " y"]),
    ("a  b", ["a", " ", " b"]),
    ("", []),
]


def joined(pieces, numbers):
    out = []
    for p, n in zip(pieces, numbers):
        if n == len(out):
            out.append("")
        out[n] += p
    return out


@pytest.mark.parametrize("text,want", WORDS)
def test_words_of_pieces_and_tokens(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(T.pre_split("t").alias("p"), decode.word_numbers(T.pre_split("t")).alias("n")).first()
    assert "".join(r.p) == text and joined(r.p, r.n) == want
    ends = [sum(map(len, r.p[: i + 1])) for i in range(len(r.p))]
    groups = tagger.group_tokens(text, [(e - len(p), e) for p, e in zip(r.p, ends)])
    assert ["".join(r.p[i] for i in g) for g in groups] == want


def test_edges_of_chosen_words(spark):
    d = spark.createDataFrame([([(" «Stone", 0, 7, 0.9), (" (bridge)", 7, 16, 0.8), (" ...", 16, 20, 0.7), (" c++", 20, 24, 0.6)],)], "w array<struct<word:string,start:int,end:int,score:double>>")
    assert d.select(decode.join_words(F.col("w"))).first()[0] == "Stone bridge c++"


def test_clean_title_of_quotes_before_a_mark(spark):
    assert spark.createDataFrame([("«T» !",)], "r string").select(T.clean_title("r")).first()[0] == "T»"


@pytest.mark.parametrize(
    "text,title,spans",
    [("the c++, code", "c++ code", [(4, 7), (9, 13)]), ("partition(self, x)", "self x", [(10, 14), (16, 17)]), ("用Python写", "Python", [(1, 7)]), ("myPython", "Python", None), ("b a", "a b", None), ("_a a", "a", [(3, 4)])],
)
def test_hand_spans(spark, text, title, spans):
    got = spark.createDataFrame([(text, title)], "t string, h string").select(labels.title_spans(F.col("t"), F.col("h"))).first()[0]
    assert (got and [tuple(s) for s in got]) == spans


@pytest.mark.parametrize(
    "text,title,spans,rule",
    [
        ("The bridges of stone", "stone bridge", [(4, 11), (15, 20)], "tolerant"),
        ("the stone bridge", "Stone bridge.", [(4, 9), (10, 16)], "exact"),
        ("a wonderful garden", "wonderfull garden", [(2, 11), (12, 18)], "tolerant"),
        ("red house red", "house red", [(4, 9), (10, 13)], "exact"),
        ("a b", "c", None, "c"),
        ("a b", "", [], "exact"),
    ],
)
def test_alignment_with_tolerance(text, title, spans, rule):
    assert training.Message(text).align(title) == (spans, rule)


def test_python_rules_equal_the_columns(spark):
    words = "garden gardens gardne gardenn walking walked walks was using fixed boxes slowly ab abcde abced over overs stone stones".split()
    pairs = [(a, b) for a in words for b in words]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.one_edit(F.col("a"), F.col("b")).alias("e"), T.stem(F.col("a")).alias("s"))
    for r in d.collect():
        assert (training.one_edit(r.a, r.b), training.stem(r.a)) == (r.e, r.s), (r.a, r.b)


def test_recompose():
    text = '"Politics of ça'
    assert training.recompose(text, [(0, 1), (1, 9), (9, 12), (12, 14), (13, 14), (14, 15)], [1, 1, 0, 1, 1, 1]) == "Politics ça"
    assert training.recompose(text, [(0, 1)], [1]) == "" == training.recompose(text, [], [])


def test_training_rows(spark):
    m = spark.createDataFrame([("1", "the old stone bridge near the mill"), ("2", "x " * 700 + "harbour town"), ("3", None)], "id string, text string")
    t = spark.createDataFrame([("1", "stone bridge", False), ("1", "stone bridges", False), ("1", "lake", False), ("1", "", False), ("1", None, None), ("1", "mill", True), ("9", "mill", False), ("3", "mill", False), (None, "mill", False), ("2", "harbour", False), ("2", "x harbour", False)], "id string, title string, refused boolean").withColumn("ids", F.lit(1))
    tok = models.learn(m.where("text IS NOT NULL"), 20)
    rows = training.training_rows(t, m, tok, limit=2000, most=600).collect()
    assert sorted((r.status, r.truncated) for r in rows) == sorted([("aligned_exact", False), ("aligned_tolerant", False), ("not_aligned", False), ("no_title", False), ("no_title", False), ("refused", False), ("no_message", False), ("no_message", False), ("no_message", False), ("recompose_failed", False), ("aligned_exact", True)])
    for r in rows:
        if r.ids:
            text = next(x for x in ("the old stone bridge near the mill", "x " * 700 + "harbour town") if tok.encode(x)[0][:600] == r.ids)
            offsets = tok.encode(text)[1][:600]
            assert len(r.ids) == len(r.labels) == len(r.words) and training.recompose(text, offsets, r.labels) in ("stone bridge", "x")
    funnel = {r.status: r.n for r in training.labeling_funnel(training.training_rows(t, m, tok)).collect()}
    assert sum(funnel.values()) == 11
    assert training.training_rows(t.where("false"), m, tok).count() == 0
    same = training.compare_tokenizers(m, tok, models.learn(m.where("text IS NOT NULL"), 1)).first()
    assert same.n == 2 and same.same_ids < 2


def test_each_endpoint_has_a_partition(spark):
    d = spark.range(400).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("a "), (F.col("id") + 1).cast("int")).alias("text"))
    server = lambda url, body, timeout: {"choices": [{"message": {"content": "a title"}}]}
    for n in (2, 4, 8):
        out = teacher.ask(d, [f"e{i}@http://{i}" for i in range(n)], "m", "s", transport=server)
        used = out.withColumn("p", F.spark_partition_id()).groupBy("instance").agg(F.countDistinct("p").alias("p"), F.count("*").alias("n"), F.min("p").alias("at")).collect()
        assert len(used) == n and all(r.p == 1 for r in used) and len({r["at"] for r in used}) == n
    out = teacher.ask(d, ["fast@http://1", "cpu@http://2"], "m", "s", transport=server, slow={"cpu": 6.0}).join(d, "id")
    by = {r.instance: r for r in out.groupBy("instance").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most")).collect()}
    assert 40 < by["cpu"].n < 75 and by["cpu"].most < by["fast"].most
    models_ = lambda url: {"data": [{"id": "m", "loaded_context_length": 32768}, {"id": "x"}]}
    assert len(teacher.loaded_or_raise("http://a", "m", models_)) == 2
    with pytest.raises(ValueError):
        teacher.loaded_or_raise("http://a", "other", models_)


def test_quotas_and_ranks(spark):
    d = spark.range(500).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("b"))
    got = {r.b: r.n for r in sampling.quotas(d, "b", {"rare": 7, "often": 30, "none": 5, "off": 0}, "id").groupBy("b").agg(F.count("*").alias("n")).collect()}
    assert got == {"rare": 7, "often": 30}
    assert sampling.quotas(d, "b", {}, "id").count() == 0
    assert [r.k for r in sampling.ranked(d, "k", "id").orderBy("id").collect()] == list(range(500))


def test_edit_pairs_by_brute_force(spark):
    words = ["liste", "listę", "lista", "garden", "gardne", "gardens", "graden", "abcd", "müller", "muller", "müllre", "abcdef", "abdcfe"]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.a, r.b) for r in titles.edit_pairs(d).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and training.one_edit(a, b)}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_folder(Session())
    Session.sparkContext.master = "local[4]"
    assert session.shared_folder(Session())


def test_sizes_precision_and_latency(spark):
    m = spark.createDataFrame([("1", "the old stone bridge near the mill and the river"), ("2", ""), ("3", "x")], "id string, text string")
    tok = models.learn(m, 20)
    files = {str(b): models.seeded_model(tok, b) for b in (3, 32)}
    weights = modelfile.parse(files["32"]).weights
    assert modelfile.size_estimate(weights, 3) < len(files["3"]) < modelfile.size_estimate(weights, 3) + 10_000
    rows = {r.file: r for r in tagger.precision_report(m, files, "32").collect()}
    assert rows["32"].n_same == rows["32"].n == 3 and rows["32"].n_empty == 1 and rows["3"].n_same >= 2
    both = {r.id: r for r in tagger.both_titles(m, files["32"], budget=2).collect()}
    assert len(both["1"].title_budget.split()) == 2 and both["2"].title == "" and both["3"].title == "x"
    assert tagger.latency(["stone bridge"] * 3, files["3"], warm=1, passes=1)["ms_per_title"] > 0


def test_precision_report_scores_each_text_once(spark):
    texts = ["the old stone bridge near the mill and the river", "the old stone bridge near the mill and the river ", "", None, "  ", "l'école d’art in the garden of lions, walls and bells"]
    rows = [(str(i), texts[i % len(texts)]) for i in range(24)] + [(None, "x y")]
    m = spark.createDataFrame(rows, "id string, text string")
    small, large = (models.learn(m, n) for n in (5, 40))
    files = {"3": models.seeded_model(small, 3), "32": models.seeded_model(small, 32), "other": models.seeded_model(large, 32)}
    report = tagger.precision_report(m, files, "32")
    # one stage of Python for all files, not one a file
    assert report._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    said = {name: {r.id: r.title for r in tagger.titles(m.where("id IS NOT NULL"), data).collect()} for name, data in files.items()}
    got = {r.file: r for r in report.collect()}
    for name, data in files.items():
        r = got[name]
        assert (r.bytes, r.n, r.n_empty) == (len(data), 24, 12)
        assert r.n_same == sum(said[name][i] == said["32"][i] for i in said[name])
    empty = tagger.precision_report(m.where("false"), files, "32").collect()
    assert [(r.file, r.n, r.n_same, r.n_empty) for r in empty] == [(name, 0, 0, 0) for name in files]
