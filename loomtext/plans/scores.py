"""Queries of scores, votes, decoding and intervals. Each is (function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decode as D
from ..operators import labels as L
from ..operators import scores as S
from . import sqltext as Q
from .corpus import read


def _gold(spark, sf):
    return read(spark, sf, "gold_consensus")


def consensus_votes(spark, sf):
    return S.votes(_gold(spark, sf))


#: Marks of each annotator, one row a word, cut to the words.
MARKS = """a AS (SELECT k, len(words) AS n, unnest(map_keys(annotators)) AS annotator, unnest(map_values(annotators)) AS marks FROM gold_consensus),
v AS (SELECT k, annotator, CASE WHEN n > 0 THEN marks[1:n] ELSE marks[1:1] END AS marks FROM a WHERE marks IS NOT NULL),
p AS (SELECT k, annotator, unnest(marks) AS m, unnest(range(len(marks))) AS word_pos FROM v)"""
VOTES = f"""{MARKS}, w AS (SELECT k, unnest(range(len(words))) AS word_pos FROM gold_consensus), vs AS (SELECT k, word_pos, sum(m)::BIGINT AS votes FROM p GROUP BY ALL),
c AS (SELECT k, word_pos, coalesce(votes, 0) AS votes, CAST(coalesce(votes, 0) >= 2 AS INTEGER) AS label FROM w LEFT JOIN vs USING (k, word_pos))"""
_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"
_COUNT = "count(*) FILTER (WHERE p = 1 AND g = 1) AS tp, count(*) FILTER (WHERE p = 1 AND g = 0) AS fp, count(*) FILTER (WHERE p = 0 AND g = 1) AS fn"


def _against_labels(spark, sf):
    """(k, bucket, annotator, pred, gold): marks against the table's labels."""
    g = _gold(spark, sf)
    return S.voices(g).join(g.select("k", "bucket", F.col("labels").alias("gold")), "k").withColumnRenamed("marks", "pred").where("gold IS NOT NULL")


PAIRED = f"""{MARKS}, l AS (SELECT k, bucket, unnest(labels) AS g, unnest(range(len(labels))) AS word_pos FROM gold_consensus), x AS (SELECT p.k, bucket, annotator, m AS p, g FROM p JOIN l ON l.k = p.k AND l.word_pos = p.word_pos)"""


def token_prf(spark, sf):
    return S.micro(_against_labels(spark, sf), "annotator")


def bucket_f1(spark, sf):
    return S.micro(_against_labels(spark, sf), "bucket")


def max_over_annotators(spark, sf):
    return S.best_of(_against_labels(spark, sf), "k", "annotator")


BEST_SQL = f"""WITH {PAIRED}, i AS (SELECT k, annotator, {_COUNT} FROM x GROUP BY ALL), b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) DESC, annotator) = 1),
s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM b) SELECT tp, fp, fn, {_PRF} FROM s"""
TWO = f"{MARKS}, j AS (SELECT x.k, x.annotator AS a, y.annotator AS b, x.m AS p, y.m AS g FROM p x JOIN p y ON x.k = y.k AND x.word_pos = y.word_pos AND x.annotator <> y.annotator)"


def pairwise_agreement(spark, sf):
    return S.pairwise(_gold(spark, sf))


PAIR_SQL = f"""WITH {TWO}, c AS (SELECT a, b, {_COUNT} FROM j GROUP BY ALL), n AS (SELECT x.annotator AS a, y.annotator AS b, count(*) AS n_items FROM v x JOIN v y ON x.k = y.k AND x.annotator <> y.annotator GROUP BY ALL)
SELECT n.a, n.b, n_items, round(CASE WHEN coalesce(tp, 0) > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM n LEFT JOIN c ON n.a = c.a AND n.b = c.b"""


def leave_one_out(spark, sf):
    return S.leave_one_out(_gold(spark, sf))


LEAVE_SQL = f"""WITH {TWO}, o AS (SELECT x.k, x.annotator AS a, y.annotator AS b FROM v x JOIN v y ON x.k = y.k AND x.annotator <> y.annotator), c AS (SELECT k, a, b, {_COUNT} FROM j GROUP BY ALL),
d AS (SELECT o.k, o.a, o.b, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM o LEFT JOIN c USING (k, a, b)),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k, a ORDER BY round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) DESC, b) = 1),
s AS (SELECT a AS annotator, count(*) AS n_items, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM e GROUP BY a) SELECT annotator, n_items, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM s"""


def _shares(spark, sf):
    """(k, word_pos, votes of 6 as a score, label of the table)."""
    g = _gold(spark, sf).where("labels IS NOT NULL")
    gold = g.select("k", F.posexplode("labels").alias("word_pos", "gold"))
    return S.votes(g).join(gold, ["k", "word_pos"]).withColumn("score", F.col("votes") / 6)


def threshold_sweep(spark, sf):
    return S.sweep(_shares(spark, sf), "score", "gold")


SWEEP_SQL = f"""WITH {VOTES}, l AS (SELECT k, unnest(labels) AS g, unnest(range(len(labels))) AS word_pos FROM gold_consensus), x AS (SELECT step, CAST(votes / 6 * 20 >= step AS INTEGER) AS p, g FROM c JOIN l USING (k, word_pos), range(1, 20) t(step)), s AS (SELECT step, {_COUNT} FROM x GROUP BY step)
SELECT CAST(step AS INTEGER) AS step, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM s"""


def best_threshold(spark, sf):
    """The first threshold of the greatest F1."""
    return S.best_step(threshold_sweep(spark, sf))


def baselines(spark, sf):
    """Micro scores of three predictors without a model: nothing, the first five words, and those of the first twenty that aren't stop words."""
    g = L.usable_examples(_gold(spark, sf).withColumn("ids", F.col("words")).where("labels IS NOT NULL"))
    of = lambda keep: F.transform("words", lambda w, i: keep(w, i).cast("int"))
    name = F.explode(
        F.array(
            F.struct(F.lit("none").alias("name"), of(lambda w, i: F.lit(False)).alias("pred")),
            F.struct(F.lit("first").alias("name"), of(lambda w, i: i < 5).alias("pred")),
            F.struct(F.lit("first_kept").alias("name"), of(lambda w, i: (i < 20) & ~F.lower(F.btrim(w, F.lit(T.EDGE_DASH))).isin(*STOP)).alias("pred")),
        )
    ).alias("x")
    return S.micro(g.select(F.col("labels").alias("gold"), name).select("x.name", "x.pred", "gold"), "name")


def positive_density(spark, sf):
    """Share of kept words per bucket, and the weight that evens the classes out."""
    d = _gold(spark, sf).where("labels IS NOT NULL").select("bucket", F.explode("labels").alias("y")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"))
    return d.select("bucket", "n", "n_positive", F.round(F.col("n_positive") / F.col("n"), 6).alias("density"), F.round((F.col("n") - F.col("n_positive")) / F.col("n_positive"), 6).alias("weight"))


DENSITY_SQL = "WITH d AS (SELECT bucket, count(*) AS n, sum(y)::BIGINT AS n_positive FROM (SELECT bucket, unnest(labels) AS y FROM gold_consensus) GROUP BY 1) SELECT bucket, n, n_positive, round(n_positive / n, 6) AS density, round((n - n_positive) / n_positive, 6) AS weight FROM d"


def word_prf_micro(spark, sf):
    """Micro word scores of the one-annotator title against the words of the labels, as multisets."""
    g = _gold(spark, sf).where("title IS NOT NULL AND labels IS NOT NULL")
    kept = F.transform(F.filter(F.arrays_zip("words", "labels"), lambda x: x["labels"] == 1), lambda x: F.lower(x["words"]))
    a = g.select("k", F.explode(T.split_space(F.lower("title"))).alias("w")).groupBy("k", "w").agg(F.count("*").alias("na"))
    b = g.select("k", F.explode(kept).alias("w")).groupBy("k", "w").agg(F.count("*").alias("nb"))
    j = a.join(b, ["k", "w"], "full").select(F.coalesce("na", F.lit(0).cast("long")).alias("na"), F.coalesce("nb", F.lit(0).cast("long")).alias("nb"))
    s = j.agg(F.sum(F.least("na", "nb")).alias("tp"), F.sum("na").alias("sa"), F.sum("nb").alias("sb")).select("tp", (F.col("sa") - F.col("tp")).alias("fp"), (F.col("sb") - F.col("tp")).alias("fn"))
    return s.select("tp", "fp", "fn", *S.prf(F.col("tp"), F.col("fp"), F.col("fn")))


MICRO_SQL = f"""WITH g AS (SELECT k, title, words, labels FROM gold_consensus WHERE title IS NOT NULL AND labels IS NOT NULL), a AS (SELECT k, w, count(*) AS na FROM (SELECT k, unnest({Q.split('lower(title)')}) AS w FROM g) GROUP BY ALL),
b AS (SELECT k, w, count(*) AS nb FROM (SELECT k, lower(w) AS w, y FROM (SELECT k, unnest(words) AS w, unnest(labels) AS y FROM g)) WHERE y = 1 GROUP BY ALL),
j AS (SELECT coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b USING (k, w)), s AS (SELECT sum(least(na, nb))::BIGINT AS tp, (sum(na) - sum(least(na, nb)))::BIGINT AS fp, (sum(nb) - sum(least(na, nb)))::BIGINT AS fn FROM j) SELECT tp, fp, fn, {_PRF} FROM s"""


def token_idf(spark, sf):
    return S.inverse_frequency(read(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", T.word_runs("text"))


_TOK = f"tk AS (SELECT doc_id, {Q.runs('text')} AS w FROM documents WHERE text IS NOT NULL), df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS token FROM tk) GROUP BY token), idf AS (SELECT token, df, round(ln(CAST((SELECT count(*) FROM tk) AS DOUBLE) / (1 + df)), 6) AS idf FROM df)"


def rarest_tokens(spark, sf):
    return S.rarest(read(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", T.word_runs("text"), 5)


RARE_SQL = f"WITH {_TOK}, e AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM tk) SELECT doc_id, pos, token FROM e JOIN idf USING (token) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idf DESC, pos) <= 5"


STOP = ["de", "la", "the", "a", "of", "en", "in", "der", "die"]
BASE_SQL = f"""WITH u AS (SELECT k, words, labels FROM gold_consensus WHERE labels IS NOT NULL AND len(words) > 0 AND list_contains(labels, 1)),
e AS (SELECT k, unnest(words) AS w, unnest(range(len(words))) AS i FROM u), l AS (SELECT k, unnest(labels) AS g, unnest(range(len(labels))) AS i FROM u),
n AS (SELECT unnest(['none', 'first', 'first_kept']) AS name),
x AS (SELECT name, CAST(CASE name WHEN 'none' THEN false WHEN 'first' THEN i < 5 ELSE i < 20 AND NOT lower(trim(w, {Q.quote(T.EDGE_DASH)})) IN ({', '.join(map(Q.quote, STOP))}) END AS INTEGER) AS p, g FROM e JOIN l USING (k, i), n),
s AS (SELECT name, {_COUNT} FROM x GROUP BY name) SELECT name, tp, fp, fn, {_PRF} FROM s"""


def _scored(spark, sf):
    """(k, words) with the words of each item as scored words: the share of votes, in order of their places."""
    g = _gold(spark, sf)
    v = S.votes(g).join(g.select("k", F.posexplode("words").alias("word_pos", "word")), ["k", "word_pos"])
    s = F.struct("word", F.col("word_pos").cast("int").alias("start"), (F.col("word_pos") + 1).cast("int").alias("end"), (F.col("votes") / 6).alias("score"))
    return v.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("word_pos", s.alias("s")))).alias("x")).select("k", F.transform("x", lambda y: y["s"]).alias("words"))


SCORED = f"{VOTES}, sw AS (SELECT k, word_pos, c.votes / 6 AS score, words[word_pos + 1] AS word FROM c JOIN gold_consensus USING (k)), sp AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY score DESC, word_pos) AS r FROM sw WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]'))"


def decode_budget(spark, sf):
    return _scored(spark, sf).select("k", D.join_words(D.choose(F.col("words"), "budget", 4)).alias("title"))


def decode_hybrid(spark, sf):
    return _scored(spark, sf).select("k", D.join_words(D.choose(F.col("words"))).alias("title"))


def decode_threshold(spark, sf):
    return _scored(spark, sf).select("k", D.join_words(D.choose(F.col("words"), "threshold", threshold=0.4)).alias("title"))


def decode_stop_words(spark, sf):
    return _scored(spark, sf).select("k", D.join_words(D.choose(F.col("words"), stop=STOP)).alias("title"))


_STRIP = f"trim({Q.strip('word')}, {Q.quote(T.EDGE_DASH)})"
_ALL = "(SELECT DISTINCT k FROM c) z LEFT JOIN q USING (k)"


def _decoded(q: str) -> str:
    return f"WITH {SCORED}, q AS ({q}) SELECT z.k, coalesce(array_to_string(list({_STRIP} ORDER BY word_pos) FILTER (WHERE {_STRIP} <> ''), ' '), '') AS title FROM {_ALL} GROUP BY z.k"


_HYBRID = "SELECT k, word, word_pos FROM (SELECT *, count(*) FILTER (WHERE r <= 6 AND score >= 0.5) OVER (PARTITION BY k) AS sure FROM {src}) WHERE n <= 4 OR CASE WHEN sure >= 3 THEN r <= 6 AND score >= 0.5 ELSE r <= 3 END"
_STOPPED = f"""(SELECT k, word, word_pos, score, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY score DESC, word_pos) AS r FROM
(SELECT *, lower({_STRIP}) IN ({', '.join(map(Q.quote, STOP))}) AS is_stop, count(*) FILTER (WHERE lower({_STRIP}) NOT IN ({', '.join(map(Q.quote, STOP))})) OVER (PARTITION BY k) AS left_ FROM sp) WHERE left_ < 3 OR NOT is_stop)"""


def interval_merge(spark, sf):
    """Runs of kept words of the labels as intervals of word places, those that touch merged."""
    g = _gold(spark, sf).where("labels IS NOT NULL")
    spans = F.transform(F.filter(F.sequence(F.lit(1), F.size("labels")), lambda i: F.col("labels")[i - 1] == 1), lambda i: F.struct((i - 1).alias("start"), i.alias("end")))
    return g.where("size(labels) > 0").select("k", F.explode(D.merge_intervals(spans)).alias("x")).select("k", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


MERGE_SQL = """WITH e AS (SELECT k, unnest(labels) AS y, unnest(range(len(labels))) AS p FROM gold_consensus), o AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS island FROM e WHERE y = 1)
SELECT k, min(p) AS start, max(p) + 1 AS "end" FROM o GROUP BY k, island"""


def word_numbering(spark, sf):
    """Pieces and words per message: the pieces before byte-pair merging, and the words that they make up."""
    m = read(spark, sf, "messages").where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.max("text").alias("text"))
    m = m.select("id", F.length("text").alias("n_chars"), F.explode(F.array(T.pre_split("text"))).alias("p"))
    covered = F.aggregate("p", F.lit(0), lambda n, p: n + F.length(p))
    words = F.size(F.filter(D.word_starts(F.col("p")), lambda s: s))
    return m.select("id", F.size("p").alias("n_pieces"), covered.alias("covered"), "n_chars", words.alias("n_words"))


_ALNUM = "regexp_matches({}, '^[\\p{{L}}\\p{{N}}]')"


def _starts(i: str, p: str = "p") -> str:
    """Does the piece at place ``i`` (from 1) of the list ``p`` begin a word?"""
    joins = f"substr({p}[{i}], 1, 1) IN ({', '.join(map(Q.quote, D.JOINERS))}) AND {_ALNUM.format(f'right({p}[{i} - 1], 1)')} AND {_ALNUM.format(f'CASE WHEN length({p}[{i}]) > 1 THEN substr({p}[{i}], 2, 1) ELSE substr({p}[{i} + 1], 1, 1) END')}"
    return f"({i} = 1 OR NOT ({_ALNUM.format(f'{p}[{i}]')} OR coalesce({joins}, false)))"


NUMBER_SQL = f"""WITH m AS (SELECT id, max(text) AS text FROM messages WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id), c AS (SELECT id, text, {Q.pre_split('text')} AS p FROM m)
SELECT id, CAST(len(p) AS INTEGER) AS n_pieces, CAST(length(array_to_string(p, '')) AS INTEGER) AS covered, CAST(length(text) AS INTEGER) AS n_chars, CAST(len(list_filter(range(1, len(p) + 1), lambda i: {_starts('i')})) AS INTEGER) AS n_words FROM c"""


def title_statistics(spark, sf):
    """Characters per word and empty titles per decoding."""
    d = _scored(spark, sf).select("k", D.join_words(D.choose(F.col("words"))).alias("hybrid"), D.join_words(D.choose(F.col("words"), "threshold")).alias("threshold"))
    rows = d.select(F.explode(F.map_from_arrays(F.array(F.lit("hybrid"), F.lit("threshold")), F.array("hybrid", "threshold"))).alias("decoding", "title"))
    return rows.groupBy("decoding").agg(F.sum((F.col("title") == "").cast("long")).alias("n_empty"), F.sum(F.length("title")).alias("n_chars"))


_TH = "SELECT k, word, word_pos FROM sp WHERE score >= {t}"
STATS_SQL = " UNION ALL ".join(f"(SELECT '{n}' AS decoding, sum(CAST(title = '' AS BIGINT))::BIGINT AS n_empty, sum(length(title))::BIGINT AS n_chars FROM ({_decoded(q)}))" for n, q in (("hybrid", _HYBRID.format(src="sp")), ("threshold", _TH.format(t="0.5"))))

QUERIES = {
    "consensus_votes": (consensus_votes, f"WITH {VOTES} SELECT k, word_pos, votes, label FROM c"),
    "token_prf": (token_prf, f"WITH {PAIRED}, s AS (SELECT annotator, {_COUNT} FROM x GROUP BY 1) SELECT annotator, tp, fp, fn, {_PRF} FROM s"),
    "bucket_f1": (bucket_f1, f"WITH {PAIRED}, s AS (SELECT bucket, {_COUNT} FROM x GROUP BY 1) SELECT bucket, tp, fp, fn, {_PRF} FROM s"),
    "max_over_annotators": (max_over_annotators, BEST_SQL),
    "pairwise_agreement": (pairwise_agreement, PAIR_SQL),
    "leave_one_out": (leave_one_out, LEAVE_SQL),
    "threshold_sweep": (threshold_sweep, SWEEP_SQL),
    "best_threshold": (best_threshold, f"WITH b AS ({SWEEP_SQL}) SELECT step, tp, fp, fn, f1 FROM b ORDER BY f1 DESC, step LIMIT 1"),
    "baselines": (baselines, BASE_SQL),
    "positive_density": (positive_density, DENSITY_SQL),
    "word_prf_micro": (word_prf_micro, MICRO_SQL),
    "token_idf": (token_idf, f"WITH {_TOK} SELECT token, df, idf FROM idf"),
    "rarest_tokens": (rarest_tokens, RARE_SQL),
    "decode_budget": (decode_budget, _decoded("SELECT k, word, word_pos FROM sp WHERE r <= 4")),
    "decode_hybrid": (decode_hybrid, _decoded(_HYBRID.format(src="sp"))),
    "decode_threshold": (decode_threshold, _decoded(_TH.format(t="0.4"))),
    "decode_stop_words": (decode_stop_words, _decoded(_HYBRID.format(src=_STOPPED))),
    "title_statistics": (title_statistics, STATS_SQL),
    "interval_merge": (interval_merge, MERGE_SQL),
    "word_numbering": (word_numbering, NUMBER_SQL),
}
