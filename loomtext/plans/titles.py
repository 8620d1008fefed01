"""Queries of titles: cleaning, validity, agreement, alignment and gold checks. Each is (function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as L
from ..operators import sampling as S
from ..operators import titles as O
from . import sqltext as Q
from .corpus import read


def _messages(spark, sf):
    return read(spark, sf, "messages").where("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))


def _runs(spark, sf):
    """Each run once: repeated deliveries are one row."""
    t = read(spark, sf, "teacher_titles").where("run_id IS NOT NULL AND error IS NULL")
    return S.first_wins(t.select("run_id", "id", "prompt_variant", "teacher_instance", "raw", "title", "seconds"), "run_id", "id")


MSG = "m AS (SELECT id, min(text) AS text FROM messages WHERE id IS NOT NULL GROUP BY id)"
RUN = "t AS (SELECT run_id, min(id) AS id, min(prompt_variant) AS prompt_variant, min(teacher_instance) AS teacher_instance, min(raw) AS raw, min(title) AS title, min(seconds) AS seconds FROM teacher_titles WHERE run_id IS NOT NULL AND error IS NULL GROUP BY run_id)"


def title_clean(spark, sf):
    return O.cleaned(_runs(spark, sf)).select("run_id", "clean", "refused")


CLEAN_SQL = f"WITH {RUN} SELECT run_id, clean, {Q.is_refusal('clean')} AS refused FROM (SELECT run_id, {Q.clean_title('raw')} AS clean FROM t)"


def title_validity(spark, sf):
    d = O.validity(O.cleaned(_runs(spark, sf)), _messages(spark, sf), limit=O.LIMIT)
    return d.select("run_id", "words_in_title", "is_subsequence", "all_present")


_TA, _MA = Q.runs("clean", "[a-z0-9]+"), Q.runs("substr(text, 1, 1200)", "[a-z0-9]+")
VALID_SQL = f"""WITH {RUN}, {MSG}, d AS (SELECT run_id, clean, {_TA} AS w, {_MA} AS o FROM (SELECT run_id, id, {Q.clean_title('raw')} AS clean FROM t) JOIN m USING (id))
SELECT run_id, CAST(len({Q.split('clean')}) AS INTEGER) AS words_in_title, len(w) > 0 AND list_reduce(o, lambda a, x: CASE WHEN a < len(w) AND w[a + 1] = x THEN a + 1 ELSE a END, 0) = len(w) AS is_subsequence,
len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains(o, x))) = 0 AS all_present FROM d""".replace("list_reduce(o, lambda a, x: CASE WHEN a < len(w) AND w[a + 1] = x THEN a + 1 ELSE a END, 0)", "(SELECT s FROM (WITH RECURSIVE r(i, s) AS (SELECT 0, 0 UNION ALL SELECT i + 1, CASE WHEN s < len(w) AND w[s + 1] = o[i + 1] THEN s + 1 ELSE s END FROM r WHERE i < len(o)) SELECT max(s) AS s FROM r))")


def title_compliance(spark, sf):
    """Per serving instance: titles, share of three to five words, share with all words present, refusals, median seconds by index."""
    d = O.validity(O.cleaned(_runs(spark, sf)), _messages(spark, sf))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return d.groupBy("teacher_instance").agg(F.count("*").alias("n"), share(F.col("words_in_title").between(3, 5)).alias("length_ok"), share(F.col("all_present")).alias("words_present"), F.sum(F.col("refused").cast("long")).alias("n_refused"))


_MF = Q.runs("text", "[a-z0-9]+")
COMPLY_SQL = f"""WITH {RUN}, {MSG}, d AS (SELECT teacher_instance, clean, {_TA} AS w, {_MF} AS o, len({Q.split('clean')}) AS n FROM (SELECT teacher_instance, id, {Q.clean_title('raw')} AS clean FROM t) JOIN m USING (id))
SELECT teacher_instance, count(*) AS n, round(avg(CAST(n BETWEEN 3 AND 5 AS DOUBLE)), 6) AS length_ok, round(avg(CAST(len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains(o, x))) = 0 AS DOUBLE)), 6) AS words_present, sum(CAST({Q.is_refusal('clean')} AS BIGINT))::BIGINT AS n_refused FROM d GROUP BY teacher_instance"""


def _variants(spark, sf):
    t = _runs(spark, sf).where(T.strip(F.coalesce("title", F.lit(""))) != "")
    return tuple(S.last_wins(t.where(F.col("prompt_variant") == v), ["id"], "run_id").select("id", "title") for v in ("v1", "v2"))


def _variant_sql(v: str) -> str:
    return f"(SELECT id, title FROM t WHERE prompt_variant = '{v}' AND {Q.strip(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id DESC) = 1)"


def agreement_jaccard(spark, sf):
    return O.agreement(*_variants(spark, sf))


_BW = lambda c: f"list_distinct({Q.bare(f'lower({c})', T.EDGE)})"
_AGREE = f"""{RUN}, a AS (SELECT id, {_BW('title')} AS a FROM {_variant_sql('v1')}), b AS (SELECT id, {_BW('title')} AS b FROM {_variant_sql('v2')}),
j AS (SELECT id, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM a JOIN b USING (id)), g AS (SELECT id, round(CASE WHEN u > 0 THEN i / u ELSE 0.0 END, 3) AS agreement FROM j)"""


def agreement_bands(spark, sf):
    g = O.agreement(*_variants(spark, sf), at_least=None)
    return g.groupBy(O.band(F.col("agreement")).alias("band")).agg(F.count("*").alias("n"))


BAND = "CASE WHEN agreement < 0.25 THEN '[0, .25)' WHEN agreement < 0.4 THEN '[.25, .4)' WHEN agreement < 0.6 THEN '[.4, .6)' ELSE '[.6, 1]' END"


def align_exact(spark, sf):
    """Titles in order of the message, by the cursor rule over bare words; only titles all of whose words occur."""
    w, m = T.bare_words(F.lower("title")), T.bare_words(F.lower(F.substring("text", 1, O.LIMIT)))
    # one row as an exploded array: filters behind it don't compute the alignment again
    aligned = F.explode(F.array(T.let(w, lambda x: T.let(m, lambda y: F.when(F.size(x) > 0, O.align_cursor(x, y)))))).alias("a")
    d = _runs(spark, sf).join(_messages(spark, sf), "id").select("run_id", aligned).where("a IS NOT NULL")
    return d.where(~F.array_contains("a.at", 0)).select("run_id", F.col("a.ordered").alias("ordered"), F.element_at("a.at", 1).alias("first_word"), F.element_at("a.at", -1).alias("last_word"))


ALIGN_SQL = f"""WITH RECURSIVE {RUN}, {MSG}, d AS (SELECT run_id, {Q.bare('lower(title)')} AS w, {Q.bare('lower(substr(text, 1, 1200))')} AS o FROM t JOIN m USING (id)),
r AS (SELECT run_id, w, o, 0 AS i, 0 AS cur, 0 AS pos, 0 AS lead_pos, true AS ordered, true AS found FROM d WHERE len(w) > 0
UNION ALL SELECT run_id, w, o, i + 1, CASE WHEN tail > 0 THEN cur + tail ELSE cur END, CASE WHEN tail > 0 THEN cur + tail ELSE any_ END, CASE WHEN i = 0 THEN CASE WHEN tail > 0 THEN cur + tail ELSE any_ END ELSE lead_pos END, ordered AND tail > 0, found AND any_ > 0
FROM (SELECT *, coalesce(list_position(o[cur + 1:], w[i + 1]), 0) AS tail, coalesce(list_position(o, w[i + 1]), 0) AS any_ FROM r WHERE i < len(w)))
SELECT run_id, ordered, CAST(lead_pos AS INTEGER) AS first_word, CAST(pos AS INTEGER) AS last_word FROM r WHERE i = len(w) AND found"""


def label_funnel(spark, sf):
    s = O.label_status(O.cleaned(_runs(spark, sf)), _messages(spark, sf))
    return s.groupBy("status").agg(F.count("*").alias("n"))


def _stem(w: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) > {len(s) + 3} THEN substr({w}, 1, length({w}) - {len(s)})" for s in T.SUFFIXES) + f" ELSE {w} END"


def _swap(a: str, b: str) -> str:
    # two neighbours changed places: the words are equal before and behind them
    return f"(length({a}) = length({b}) AND len(list_filter(range(1, length({a})), lambda i: substr({a}, i, 1) <> substr({a}, i + 1, 1) AND {b} = substr({a}, 1, i - 1) || substr({a}, i + 1, 1) || substr({a}, i, 1) || substr({a}, i + 2))) > 0)"


def _edit(a: str, b: str) -> str:
    return f"(least(length({a}), length({b})) >= 5 AND (levenshtein({a}, {b}) = 1 OR {_swap(a, b)}))"


FUNNEL_SQL = f"""WITH {RUN}, {MSG}, d AS (SELECT run_id, {Q.bare('lower(clean)')} AS w, {Q.bare("lower(substr(coalesce(text, ''), 1, 1200))")} AS o, text IS NULL AS lost, {Q.is_refusal('clean')} AS refused FROM (SELECT run_id, id, {Q.clean_title('raw')} AS clean FROM t) LEFT JOIN m USING (id)),
x AS (SELECT run_id, unnest(w) AS w, o FROM d), y AS (SELECT run_id, w, list_contains(o, w) AS exact, o FROM x),
z AS (SELECT run_id, bool_and(exact) AS all_exact, bool_and(exact OR len(list_filter(o, lambda v: ({_stem('v')}) = ({_stem('w')}) OR {_edit('v', 'w')})) > 0) AS all_found FROM y GROUP BY run_id)
SELECT CASE WHEN len(w) = 0 THEN 'no_title' WHEN refused THEN 'refused' WHEN lost THEN 'no_message' WHEN all_exact THEN 'aligned_exact' WHEN all_found THEN 'aligned_tolerant' ELSE 'not_aligned' END AS status, count(*) AS n FROM d LEFT JOIN z USING (run_id) GROUP BY 1"""


def latest_titles(spark, sf):
    g = read(spark, sf, "gold_consensus").where("id IS NOT NULL").groupBy("id").agg(F.min("k").alias("k"))
    return O.latest_titles(read(spark, sf, "annotator_titles"), g)


LATEST_SQL = f"""WITH g AS (SELECT id, min(k) AS gk FROM gold_consensus WHERE id IS NOT NULL GROUP BY id), d AS (SELECT coalesce(a.k, gk) AS k, annotator, title, annotated_ts, annotation_id FROM annotator_titles a LEFT JOIN g ON a.id = g.id)
SELECT k, annotator, title FROM d WHERE k IS NOT NULL AND title IS NOT NULL AND {Q.strip('title')} <> '' QUALIFY row_number() OVER (PARTITION BY k, annotator ORDER BY annotated_ts DESC NULLS LAST, annotation_id DESC, title DESC) = 1"""


def resume(spark, sf):
    """Messages that no run has dealt with; failed runs count."""
    return O.not_done(_messages(spark, sf), read(spark, sf, "teacher_titles")).select("id")


def gold_check(spark, sf):
    """The one-annotator titles of the gold set as hand labels: those of too few or too many words are impossible when even."""
    gold = read(spark, sf, "gold_consensus")
    labels = gold.where("title IS NOT NULL").select("k", "title", (F.col("k") % 11 == 0).alias("impossible"), F.lit(0).alias("ord"))
    again = labels.where("k % 7 = 0").withColumn("ord", F.lit(1))
    lost = labels.where("k % 5 = 0").withColumn("k", F.col("k") + 1_000_000)
    return O.check_labels(gold.select("k"), labels.union(again).union(lost)).groupBy("status").agg(F.count("*").alias("n"))


GOLD_SQL = f"""WITH l AS (SELECT k, title, k % 11 = 0 AS impossible, 0 AS ord FROM gold_consensus WHERE title IS NOT NULL), a AS (SELECT * FROM l UNION ALL SELECT k, title, impossible, 1 FROM l WHERE k % 7 = 0 UNION ALL SELECT k + 1000000, title, impossible, 0 FROM l WHERE k % 5 = 0),
s AS (SELECT a.k, CASE WHEN g.k IS NULL THEN 'unknown' WHEN row_number() OVER (PARTITION BY a.k ORDER BY ord) > 1 THEN 'duplicate' WHEN impossible THEN 'impossible' WHEN len({Q.split('a.title')}) NOT BETWEEN 3 AND 5 THEN 'bad_length' ELSE 'valid' END AS status FROM a LEFT JOIN gold_consensus g ON g.k = a.k)
SELECT status, count(*) AS n FROM (SELECT status FROM s UNION ALL SELECT 'unlabeled' FROM gold_consensus WHERE k NOT IN (SELECT k FROM a)) GROUP BY status"""


def teacher_gold(spark, sf):
    """Teacher titles against gold titles of the same message: strict and tolerant presence, mean set F1, share of 0.5 or more, same words."""
    gold = read(spark, sf, "gold_consensus").where("title IS NOT NULL").groupBy("id").agg(F.min("title").alias("gold"), F.min("text").alias("text"))
    d = _runs(spark, sf).where(T.strip(F.coalesce("title", F.lit(""))) != "").join(gold, "id")
    d = d.withColumn("a", F.array_distinct(T.bare_words("title", T.EDGE, True))).withColumn("b", F.array_distinct(T.bare_words("gold", T.EDGE, True)))
    d = d.withColumn("v", F.array_union(T.bare_words("text", T.EDGE, True), T.ascii_words("text")))
    f = T.set_prf(F.col("a"), F.col("b"))[2]
    near = F.forall("a", lambda w: F.exists("v", lambda x: (x == w) | (T.stem(x) == T.stem(w)) | T.close_word(x, w)))
    n = lambda c: F.sum(c.cast("long")).alias
    return d.withColumn("f", f).agg(
        F.count("*").alias("n"), n(F.size(F.array_except("a", "v")) == 0)("n_strict"), n(near)("n_tolerant"), F.round(F.avg("f"), 6).alias("mean_f1"), n(F.col("f") >= 0.5)("n_half"), n((F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0))("n_same")
    )


TG_SQL = f"""WITH {RUN}, g AS (SELECT id, min(title) AS gold, min(text) AS text FROM gold_consensus WHERE title IS NOT NULL GROUP BY id),
d AS (SELECT run_id, list_distinct({Q.bare('t.title', T.EDGE, True)}) AS a, list_distinct({Q.bare('gold', T.EDGE, True)}) AS b, list_distinct(list_concat({Q.bare('text', T.EDGE, True)}, {Q.runs('text', '[a-z0-9]+')})) AS v FROM t JOIN g USING (id) WHERE {Q.strip("coalesce(t.title, '')")} <> ''),
e AS (SELECT *, len(list_intersect(a, b)) AS i FROM d), x AS (SELECT run_id, v, unnest(a) AS w FROM e),
y AS (SELECT run_id, bool_and(len(list_filter(v, lambda z: z = w OR ({_stem('z')}) = ({_stem('w')}) OR (least(length(z), length(w)) >= 5 AND levenshtein(z, w) <= 1))) > 0) AS near FROM x GROUP BY run_id),
f AS (SELECT e.*, CASE WHEN i > 0 THEN 2.0 * i / (len(a) + len(b)) ELSE 0.0 END AS f, coalesce(near, true) AS near FROM e LEFT JOIN y USING (run_id))
SELECT count(*) AS n, sum(CAST(len(list_filter(a, lambda x: NOT list_contains(v, x))) = 0 AS BIGINT))::BIGINT AS n_strict, sum(CAST(near AS BIGINT))::BIGINT AS n_tolerant, round(avg(f), 6) AS mean_f1, sum(CAST(f >= 0.5 AS BIGINT))::BIGINT AS n_half, sum(CAST(i = len(a) AND i = len(b) AS BIGINT))::BIGINT AS n_same FROM f"""


def _f1_rows(spark, sf):
    """(run_id, language, f1): multiset F1 of each teacher title against the floor title of its message."""
    m = read(spark, sf, "messages").where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"), F.min(F.initcap(T.strip("language"))).alias("language"))
    d = _runs(spark, sf).join(m, "id").withColumn("a", T.bare_words("title", T.EDGE_DASH, True)).withColumn("b", T.bare_words(T.floor_title("text"), T.EDGE_DASH, True))
    return d.select("run_id", "teacher_instance", "language", T.multiset_f1(F.coalesce("a", F.array().cast("array<string>")), F.col("b")).alias("f1"))


def _times(arr: str, x: str) -> str:
    return f"len(list_filter({arr}, lambda q: q = {x}))"


_INIT = f"upper(substr({Q.strip('language')}, 1, 1)) || lower(substr({Q.strip('language')}, 2))"
F1_ROWS = f"""{RUN}, ml AS (SELECT id, min(text) AS text, min({_INIT}) AS language FROM messages WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
fd AS (SELECT run_id, teacher_instance, language, coalesce({Q.bare('title', T.EDGE_DASH, True)}, CAST([] AS VARCHAR[])) AS a, {Q.bare(Q.floor_title('text'), T.EDGE_DASH, True)} AS b FROM t JOIN ml USING (id)),
fc AS (SELECT run_id, sum(least(na, nb)) AS c FROM (SELECT run_id, w, count(*) AS na FROM (SELECT run_id, unnest(a) AS w FROM fd) GROUP BY ALL) JOIN (SELECT run_id, w, count(*) AS nb FROM (SELECT run_id, unnest(b) AS w FROM fd) GROUP BY ALL) USING (run_id, w) GROUP BY run_id),
fr AS (SELECT run_id, teacher_instance, language, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0 * coalesce(c, 0) / (len(a) + len(b)) ELSE 0.0 END AS f1 FROM fd LEFT JOIN fc USING (run_id))"""


def word_f1_macro(spark, sf):
    return _f1_rows(spark, sf).groupBy("teacher_instance", "language").agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


def score_matrix(spark, sf):
    """Macro F1 as a matrix: an instance a row, a language a column, and the mean over the languages."""
    from .corpus import LANGS

    p = word_f1_macro(spark, sf).where(F.col("language").isin(*LANGS)).groupBy("teacher_instance").pivot("language", list(LANGS)).agg(F.first("f1"))
    return p.withColumn("mean", F.round(sum((F.coalesce(F.col(x), F.lit(0.0)) for x in LANGS), F.lit(0.0)) / len(LANGS), 6))


def _matrix_sql() -> str:
    from .corpus import LANGS

    cols = ", ".join(f"max(CASE WHEN language = '{x}' THEN f1 END) AS {x}" for x in LANGS)
    total = " + ".join(f"coalesce(max(CASE WHEN language = '{x}' THEN f1 END), 0.0)" for x in LANGS)
    inside = ", ".join(map(Q.quote, LANGS))
    return f"WITH {F1_ROWS}, g AS (SELECT teacher_instance, language, round(avg(f1), 6) AS f1 FROM fr GROUP BY ALL) SELECT teacher_instance, {cols}, round(({total}) / {len(LANGS)}, 6) AS mean FROM g WHERE language IN ({inside}) GROUP BY teacher_instance"


def lowest_f1(spark, sf):
    return _f1_rows(spark, sf).select("run_id", F.round("f1", 6).alias("f1")).orderBy("f1", "run_id").limit(25)


def language_stats(spark, sf):
    """Mean, least and greatest of the languages' macro F1 per instance."""
    g = word_f1_macro(spark, sf).where("language IS NOT NULL")
    return g.groupBy("teacher_instance").agg(F.round(F.avg("f1"), 5).alias("mean_f1"), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"))


def stem_and_edits(spark, sf):
    """Pairs of words of documents, of five letters or more, that are one edit apart, and what the stemmer makes of them."""
    d = read(spark, sf, "documents").where("text IS NOT NULL")
    return O.edit_pairs(d.select(F.explode(T.letter_runs("text")).alias("w")).distinct()).select("a", "b", T.stem(F.col("a")).alias("stem_a"), T.stem(F.col("b")).alias("stem_b"))


def _less(w: str, i: str) -> str:
    return f"(substr({w}, 1, {i} - 1) || substr({w}, {i} + 1))"


# two words one edit apart are equal, or equal without one of their letters, as in the query; levenshtein() counts bytes here
_ONE = f"""CASE length(a) - length(b) WHEN 0 THEN len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1 OR {_swap('a', 'b')}
WHEN 1 THEN len(list_filter(range(1, length(a) + 1), lambda i: {_less('a', 'i')} = b)) > 0 WHEN -1 THEN len(list_filter(range(1, length(b) + 1), lambda i: {_less('b', 'i')} = a)) > 0 ELSE false END"""
EDIT_SQL = f"""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest({Q.runs('text', chr(92) + 'p{L}+')}) AS w FROM documents WHERE text IS NOT NULL) WHERE length(w) >= 5),
k AS (SELECT DISTINCT w, unnest(list_concat([w], list_transform(range(1, length(w) + 1), lambda i: {_less('w', 'i')}))) AS key FROM w),
p AS (SELECT DISTINCT x.w AS a, y.w AS b FROM k x JOIN k y ON x.key = y.key AND x.w < y.w)
SELECT a, b, {_stem('a')} AS stem_a, {_stem('b')} AS stem_b FROM p WHERE {_ONE}"""


def usable_gold(spark, sf, least: int = 100):
    """Rows of the gold set that are scored, per bucket; a set of fewer than ``least`` rows in all isn't used."""
    g = L.usable_gold(_flagged(spark, sf)).groupBy("bucket").agg(F.count("*").alias("n"))
    return g.join(g.agg(F.sum("n").alias("total")).where(F.col("total") >= least).select(F.lit(True).alias("enough"))).select("bucket", "n")


def _flagged(spark, sf):
    g = read(spark, sf, "gold_consensus")
    return g.withColumn("impossible", F.when(F.col("k") % 5 == 0, True)).withColumn("off_language", F.col("k") % 7 == 0)


USABLE_SQL = f"SELECT bucket, count(*) AS n FROM gold_consensus WHERE k % 5 <> 0 AND k % 7 <> 0 AND {Q.strip("coalesce(title, '')")} <> '' GROUP BY bucket QUALIFY sum(count(*)) OVER () >= 100"


def model_names(spark, sf):
    """Version, scope and key of model files named after the serving instances."""
    d = read(spark, sf, "teacher_titles").where("teacher_instance IS NOT NULL").select("teacher_instance").distinct()
    name = F.concat(F.lit("titler-v1."), F.length("teacher_instance").cast("string"), F.lit("-"), F.col("teacher_instance"), F.lit("-int3.bin"))
    version, scope, _ = L.file_parts(name)
    return d.select(version.alias("version"), scope.alias("scope"), L.file_key(name, "1.2").alias("key"))


NAMES_SQL = """WITH n AS (SELECT DISTINCT 'titler-v1.' || length(teacher_instance) || '-' || teacher_instance || '-int3.bin' AS name FROM teacher_titles WHERE teacher_instance IS NOT NULL),
p AS (SELECT regexp_extract(name, '^titler-v([0-9.]+)-(.+)-int3\\.bin$', 1) AS version, regexp_extract(name, '^titler-v([0-9.]+)-(.+)-int3\\.bin$', 2) AS scope FROM n)
SELECT version, scope, CASE WHEN version = '1.2' THEN scope ELSE scope || '@' || version END AS key FROM p"""


def title_spans(spark, sf):
    """Gold titles whose words stand in their text in order: number of words, first and last place."""
    g = read(spark, sf, "gold_consensus").where("title IS NOT NULL AND text IS NOT NULL")
    d = g.select("k", F.explode(F.array(L.title_spans(F.col("text"), F.col("title")))).alias("s")).where("size(s) > 0")
    return d.select("k", F.size("s").alias("n_words"), F.element_at("s", 1)["start"].alias("first"), F.element_at("s", -1)["end"].alias("last"))


def _inner(c: str) -> str:
    """Is the character a part of a word that bounds none?"""
    return f"(regexp_matches({c}, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches({c}, '[{T.UNSPACED}]'))"


_PLACES = f"list_filter(range(cur, length(text) - length(w[i + 1]) + 1), lambda p: substr(text, p + 1, length(w[i + 1])) = w[i + 1] AND NOT (p > 0 AND {_inner('substr(text, p, 1)')}) AND NOT {_inner('substr(text, p + 1 + length(w[i + 1]), 1)')})"
SPAN_SQL = f"""WITH RECURSIVE r AS (SELECT k, text, {Q.split('title')} AS w, 0::BIGINT AS i, 0::BIGINT AS cur, NULL::BIGINT AS lead_pos FROM gold_consensus WHERE title IS NOT NULL AND text IS NOT NULL
UNION ALL SELECT k, text, w, i + 1, place + length(w[i + 1]), coalesce(lead_pos, place) FROM (SELECT *, ({_PLACES})[1] AS place FROM r WHERE i < len(w)) WHERE place IS NOT NULL)
SELECT k, CAST(len(w) AS INTEGER) AS n_words, CAST(lead_pos AS INTEGER) AS "first", CAST(cur AS INTEGER) AS "last" FROM r WHERE i = len(w) AND len(w) > 0"""


def gold_floor(spark, sf):
    """Macro F1 of teacher titles per bucket against the gold titles that are scored; a message without a title scores 0."""
    gold = S.first_wins(L.usable_gold(read(spark, sf, "gold_consensus")).where("id IS NOT NULL").select("k", "id", "bucket", F.col("title").alias("gold")), "id", "k")
    said = S.last_wins(_runs(spark, sf).where(T.strip(F.coalesce("title", F.lit(""))) != ""), ["id"], "run_id").select("id", "title")
    d = gold.join(said, "id", "left")
    f1 = T.multiset_f1(T.bare_words(F.coalesce("title", F.lit("")), T.EDGE_DASH, True), T.bare_words("gold", T.EDGE_DASH, True))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("title").isNull().cast("long")).alias("n_missing"), F.round(F.avg(f1), 6).alias("f1"))


FLOOR_SQL = f"""WITH {RUN}, g AS (SELECT k, id, bucket, title AS gold FROM gold_consensus WHERE id IS NOT NULL AND {Q.strip("coalesce(title, '')")} <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1),
s AS (SELECT id, title FROM t WHERE {Q.strip("coalesce(title, '')")} <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id DESC) = 1),
d AS (SELECT k, bucket, title, {Q.bare("coalesce(title, '')", T.EDGE_DASH, True)} AS a, {Q.bare('gold', T.EDGE_DASH, True)} AS b FROM g LEFT JOIN s USING (id)),
c AS (SELECT k, sum(least(na, nb)) AS c FROM (SELECT k, w, count(*) AS na FROM (SELECT k, unnest(a) AS w FROM d) GROUP BY ALL) JOIN (SELECT k, w, count(*) AS nb FROM (SELECT k, unnest(b) AS w FROM d) GROUP BY ALL) USING (k, w) GROUP BY k)
SELECT bucket, count(*) AS n, sum(CAST(title IS NULL AS BIGINT))::BIGINT AS n_missing, round(avg(CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0 * coalesce(c, 0) / (len(a) + len(b)) ELSE 0.0 END), 6) AS f1 FROM d LEFT JOIN c USING (k) GROUP BY bucket"""


QUERIES = {
    "gold_floor": (gold_floor, FLOOR_SQL),
    "usable_gold": (usable_gold, USABLE_SQL),
    "model_names": (model_names, NAMES_SQL),
    "title_spans": (title_spans, SPAN_SQL),
    "title_clean": (title_clean, CLEAN_SQL),
    "title_validity": (title_validity, VALID_SQL),
    "title_compliance": (title_compliance, COMPLY_SQL),
    "agreement_jaccard": (agreement_jaccard, f"WITH {_AGREE} SELECT id, agreement FROM g WHERE agreement >= 0.4"),
    "agreement_bands": (agreement_bands, f"WITH {_AGREE} SELECT {BAND} AS band, count(*) AS n FROM g GROUP BY 1"),
    "align_titles": (align_exact, ALIGN_SQL),
    "label_funnel": (label_funnel, FUNNEL_SQL),
    "latest_titles": (latest_titles, LATEST_SQL),
    "resume_titles": (resume, "SELECT DISTINCT id FROM messages WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM teacher_titles WHERE id IS NOT NULL)"),
    "gold_check": (gold_check, GOLD_SQL),
    "teacher_vs_gold": (teacher_gold, TG_SQL),
    "word_f1_macro": (word_f1_macro, f"WITH {F1_ROWS} SELECT teacher_instance, language, round(avg(f1), 6) AS f1, count(*) AS n FROM fr GROUP BY ALL"),
    "score_matrix_pivot": (score_matrix, _matrix_sql()),
    "lowest_f1": (lowest_f1, f"WITH {F1_ROWS} SELECT run_id, round(f1, 6) AS f1 FROM fr ORDER BY round(f1, 6), run_id LIMIT 25"),
    "language_stats": (language_stats, f"WITH {F1_ROWS}, g AS (SELECT teacher_instance, language, round(avg(f1), 6) AS f1 FROM fr GROUP BY ALL) SELECT teacher_instance, round(avg(f1), 5) AS mean_f1, min(f1) AS min_f1, max(f1) AS max_f1 FROM g WHERE language IS NOT NULL GROUP BY 1"),
    "stem_and_edits": (stem_and_edits, EDIT_SQL),
}
