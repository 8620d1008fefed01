"""Queries of the corpus build: sources, filters, dedupe, sampling, statistics. Each is (function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import cut_lineage
from ..operators import corpus as C
from ..operators import sampling as S
from ..sources import tables
from . import sqltext as Q

LANGS = ("English", "French", "German", "Spanish")
IN_LANGS = ", ".join(map(Q.quote, LANGS))
ALL_LANGS = ("English", "French", "Spanish", "German", "Portuguese", "Italian", "Dutch", "Swedish", "Polish", "Russian")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def first_user_message(spark, sf):
    return C.first_user(read(spark, sf, "source_conversations")).select("conversation_hash", "text", F.length("text").cast("long").alias("n_chars"))


FIRST_SQL = f"SELECT conversation_hash, text, length(text) AS n_chars FROM ({Q.FIRST})"


def flagship(spark, sf):
    """First user message of 20 to 8000 characters, its length bucket, and the title that needs no model."""
    d = C.usable_length(C.first_user(read(spark, sf, "source_conversations")))
    return d.select("conversation_hash", F.length("text").cast("long").alias("n_chars"), T.bucket(F.length("text")).alias("bucket"), T.floor_title("text").alias("floor_title"))


FLAGSHIP_SQL = f"SELECT conversation_hash, length(text) AS n_chars, {Q.bucket('length(text)')} AS bucket, {Q.floor_title('text')} AS floor_title FROM ({Q.FIRST}) WHERE length(text) BETWEEN 20 AND 8000"


def funnel_null_keep(spark, sf):
    return C.funnel(read(spark, sf, "source_conversations"), ["English"], null_toxic_passes=True)


def funnel_null_drop(spark, sf):
    return C.funnel(read(spark, sf, "source_conversations"), list(LANGS), null_toxic_passes=False)


def _funnel_sql(langs: str, default: str) -> str:
    ok = f"(language IN ({langs}) AND NOT coalesce(toxic, {default}))"
    user = f"({ok} AND coalesce(conversation[1].role, '') = 'user')"
    long = f"({user} AND length({Q.strip(chr(99) + 'oalesce(conversation[1].content, ' + chr(39) * 2 + ')')}) BETWEEN 20 AND 8000)"
    return f"SELECT count(*) AS n_read, count(*) FILTER (WHERE {ok}) AS n_language, count(*) FILTER (WHERE {user}) AS n_user, count(*) FILTER (WHERE {long}) AS n_length FROM source_conversations"


def funnel_whole(spark, sf):
    """All steps of the build, with what exact copies, near copies and the list of excluded messages take away."""
    c = read(spark, sf, "source_conversations")
    first = C.funnel(c, list(LANGS), null_toxic_passes=False)
    d = S.first_wins(C.usable_length(C.first_user(C.by_language(c, list(LANGS), False))).select("conversation_hash", "text"), T.normalize("text"), "conversation_hash")
    near = cut_lineage(C.near_dedupe(d, "conversation_hash").select("conversation_hash", "text"), "near")
    listed = read(spark, sf, "gold_consensus").select("id", "text")
    left = C.exclude(near, listed.select("id"), listed.select("text").where("text IS NOT NULL"), "conversation_hash", "text")
    count = lambda x, name: x.agg(F.count("*").alias(name))
    return first.crossJoin(count(d, "n_exact")).crossJoin(count(near, "n_near")).crossJoin(count(left, "n_excluded"))  # one row each


def rows_per_language(spark, sf):
    return read(spark, sf, "source_conversations").groupBy("language").agg(F.count("*").alias("n"))


def multi_language_scan(spark, sf):
    """One pass over the table for all languages: counts per language and code of what each output would hold."""
    d = C.usable_length(C.first_user(C.by_language(read(spark, sf, "source_conversations"), list(LANGS), False)))
    return d.groupBy("language").agg(F.count("*").alias("n"), F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"))


MULTI_SQL = f"SELECT language, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest FROM ({Q.FIRST}) WHERE language IN ({IN_LANGS}) AND toxic = false AND length(text) BETWEEN 20 AND 8000 GROUP BY language"


def short_messages(spark, sf):
    """First of each normalized text of 1 to 19 characters per language."""
    d = C.first_user(C.by_language(read(spark, sf, "source_conversations"), list(LANGS), False)).where(F.length("text").between(1, 19))
    return S.first_wins(d.select("language", "text", "conversation_hash"), F.concat_ws("\1", "language", T.normalize("text")), "conversation_hash", "text")


SHORT_SQL = f"SELECT language, text, conversation_hash FROM ({Q.FIRST}) WHERE language IN ({IN_LANGS}) AND toxic = false AND length(text) BETWEEN 1 AND 19 QUALIFY row_number() OVER (PARTITION BY language, {Q.normalize('text')} ORDER BY conversation_hash, text) = 1"


def exact_dedupe(spark, sf):
    return S.first_wins(read(spark, sf, "messages").select("id", "text"), T.normalize("text"), "id", "text")


EXACT_SQL = f"SELECT id, text FROM messages WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {Q.normalize('text')} ORDER BY id, text) = 1"


def near_dedupe(spark, sf):
    """Documents that stay when each near copy of one that stays is dropped, in the order of their ids."""
    return C.near_dedupe(C.usable_length(read(spark, sf, "documents").select("doc_id", "text")), "doc_id").select("doc_id")


def shingle_counts(spark, sf):
    d = read(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.size(T.shingles(T.word_runs("text"))).alias("n_shingles"), F.size(T.word_runs("text")).alias("n_words"))


_W = Q.runs("text")
SHINGLE_SQL = f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(CASE WHEN len(w) >= 3 THEN len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) WHEN len(w) > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_shingles, CAST(len(w) AS INTEGER) AS n_words FROM w"""


def exclusion(spark, sf):
    """Messages that neither by id nor by normalized text are in the list of messages of 30 characters or less."""
    m = read(spark, sf, "messages").select("id", "text")
    listed = m.where(F.length("text") <= 30)
    return C.exclude(m, listed.select("id"), listed.select("text"), "id", "text").select("id")


EXCLUDE_SQL = f"""WITH l AS (SELECT id, {Q.normalize('text')} AS k FROM messages WHERE length(text) <= 30)
SELECT id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = m.id) AND NOT EXISTS (SELECT 1 FROM l WHERE l.k = {Q.normalize('m.text')})"""


def systematic_sample(spark, sf):
    return S.systematic(read(spark, sf, "events").select("event_id", "ts"), 700, "ts", "event_id").select("event_id")


SYSTEMATIC_SQL = """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT event_id FROM r WHERE n <= 700 OR r IN (SELECT CAST(floor(i * (CAST(n2 AS DOUBLE) / 700)) AS BIGINT) FROM range(700) t(i), (SELECT count(*) AS n2 FROM events))"""

PRIORITY = ("letters", "manuals", "notes", "faq", "forum", "prompts", "chat")


def source_waterfill(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source")
    return S.fill_by_priority(d, "source", list(PRIORITY), 400, "doc_id")


_RANK = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(PRIORITY)) + " END"
WATER_SQL = f"""WITH c AS (SELECT source, count(*) AS n, {_RANK} AS k FROM documents GROUP BY source),
q AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE k IS NOT NULL),
t AS (SELECT source, n, least(n, greatest(0, 400 - before)) AS take FROM q),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)
SELECT doc_id, r.source FROM r JOIN t ON r.source = t.source WHERE take = n OR r IN (SELECT CAST(floor(i * (CAST(n AS DOUBLE) / CAST(take AS DOUBLE))) AS BIGINT) FROM range(CAST(take AS BIGINT)) x(i))"""


def site_cap(spark, sf):
    """At most the site's own number of questions, by hash order; rows of unknown sites stay out."""
    sites = read(spark, sf, "sites").select("site", F.col("max_questions").alias("cap"))
    m = read(spark, sf, "messages").select("id", "site").distinct().join(sites, "site")
    return S.capped(m, "site", F.col("cap"), "id").select("id", "site")


SITE_SQL = f"""SELECT id, site FROM (SELECT DISTINCT m.id, m.site, s.max_questions AS cap FROM messages m JOIN sites s ON m.site = s.site)
QUALIFY row_number() OVER (PARTITION BY site ORDER BY {Q.hash_order('id')}, id) <= cap"""


def length_buckets(spark, sf):
    d = read(spark, sf, "messages").select("source", T.bucket(F.length("text")).alias("bucket"))
    return d.groupBy("source", F.coalesce("bucket", F.lit("outside")).alias("bucket")).agg(F.count("*").alias("n"))


BUCKET_SQL = f"SELECT source, coalesce({Q.bucket('length(text)')}, 'outside') AS bucket, count(*) AS n FROM messages GROUP BY ALL"


def time_bounds(spark, sf):
    """First and last time per source; the sentinel of unknown times counts as unknown."""
    ts = F.when(F.col("ts") < "9999", F.col("ts"))
    return read(spark, sf, "messages").groupBy("source").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.sum((F.col("ts") >= "9999").cast("long")).alias("n_unknown"))


TIME_SQL = "SELECT source, min(CASE WHEN ts < '9999' THEN ts END) AS first_ts, max(CASE WHEN ts < '9999' THEN ts END) AS last_ts, sum(CAST(ts >= '9999' AS BIGINT))::BIGINT AS n_unknown FROM messages GROUP BY source"
QUOTA = {"short": 40, "medium": 30, "long": 20, "very_long": 10}


def stratified_quota(spark, sf):
    d = S.first_wins(read(spark, sf, "messages").select("id", "text"), "id", "text").select("id", T.bucket(F.length("text")).alias("bucket"))
    return S.quotas(d, "bucket", QUOTA, "id", 3)


QUOTA_SQL = f"""WITH d AS (SELECT id, {Q.bucket('length(min(text))')} AS bucket FROM messages WHERE id IS NOT NULL GROUP BY id)
SELECT id, bucket FROM d WHERE bucket IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY {Q.hash_order('id', 3)}, id) <= CASE bucket {' '.join(f"WHEN '{k}' THEN {v}" for k, v in QUOTA.items())} END"""


def eval_split(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    n, _, _ = S.eval_size(d.count(), train=600, most=250, least=100, small=90)
    return S.split_eval(d, n, "doc_id", 1)


SPLIT_SQL = f"""WITH n AS (SELECT CASE WHEN least(250, count(*) - 600) >= 100 THEN least(250, count(*) - 600) ELSE least(90, count(*) // 10) END AS k FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {Q.hash_order('doc_id', 1)}, doc_id) <= (SELECT k FROM n) THEN 'eval' ELSE 'train' END AS split FROM documents"""


def language_gate(spark, sf):
    """How many messages per label are kept or rejected by the rates of function words; the words are those most frequent per label."""
    m = read(spark, sf, "messages").select("id", "text", F.initcap(T.strip("language")).alias("lang")).where("text IS NOT NULL").distinct()
    m = m.where(F.col("lang").isin(*ALL_LANGS))
    gate = C.language_gate(m, C.function_words(m, 30), "id")
    return gate.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("rejected").cast("long")).alias("n_rejected"))


_LW = Q.runs("text", r"\p{L}+")
GATE_SQL = f"""WITH m AS (SELECT DISTINCT id, text, lang FROM (SELECT id, text, upper(substr({Q.strip('language')}, 1, 1)) || lower(substr({Q.strip('language')}, 2)) AS lang FROM messages WHERE text IS NOT NULL) WHERE lang IN ({', '.join(map(Q.quote, ALL_LANGS))})),
w AS (SELECT id, lang, unnest({_LW}) AS word FROM m),
f AS (SELECT lang AS of, word FROM (SELECT lang, word, count(DISTINCT id) AS n FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 30),
s AS (SELECT m.id, m.lang, f.of, sum(CASE WHEN f.word IS NOT NULL THEN 1 ELSE 0 END) AS hits FROM m JOIN w ON w.id = m.id AND w.lang = m.lang LEFT JOIN f ON f.word = w.word GROUP BY ALL),
t AS (SELECT id, lang, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT t.id, t.lang, t.n, max(CASE WHEN of IS NOT NULL THEN hits END) / t.n AS best, max(CASE WHEN of = t.lang THEN hits END) / t.n AS own FROM t LEFT JOIN s ON s.id = t.id AND s.lang = t.lang GROUP BY t.id, t.lang, t.n),
x AS (SELECT id, text, lang, length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS letters, length(regexp_replace(regexp_replace(text, '\\P{{L}}', '', 'g'), '[^\\p{{Latin}}]', '', 'g')) AS latin FROM m)
SELECT x.lang, count(*) AS n, sum(CAST((letters > 0 AND latin / letters < 0.5) OR (coalesce(b.n, 0) >= 12 AND coalesce(best, 0) >= 0.2 AND coalesce(own, 0) < 0.5 * best) AS BIGINT))::BIGINT AS n_rejected
FROM x LEFT JOIN b ON b.id = x.id AND b.lang = x.lang GROUP BY x.lang"""


def group_cap(spark, sf):
    """The first 50 documents of each language, of all languages together."""
    d = read(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    return S.first_rows(d, "lang", 50, "doc_id")


CAP_SQL = "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50"


def canonical_messages(spark, sf):
    """The canonical record of documents: id by hash, cut text, time in seconds or the sentinel."""
    d = read(spark, sf, "documents").where("text IS NOT NULL")
    return d.select(T.sha1_id("aya_", "text").alias("id"), F.substring("text", 1, 1200).alias("text"), F.coalesce(T.iso_seconds("ts"), F.lit("9999-12-31T00:00:00")).alias("ts"), F.coalesce("site", F.lit("?")).alias("site"))


CANON_SQL = "SELECT 'aya_' || substr(sha1(text), 1, 16) AS id, substr(text, 1, 1200) AS text, coalesce(strftime(CAST(ts AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S'), '9999-12-31T00:00:00') AS ts, coalesce(site, '?') AS site FROM documents WHERE text IS NOT NULL"


def exploded_turns(spark, sf):
    """Turns of users with three words or more, from nested lists; an empty or null list gives nothing."""
    d = read(spark, sf, "source_conversations").select("conversation_hash", F.posexplode("conversation").alias("turn", "c"))
    return d.where("c.role = 'user'").where(F.size(T.split_space(F.coalesce("c.content", F.lit("")))) >= 3).select("conversation_hash", F.col("turn").cast("long").alias("turn"), T.strip("c.content").alias("text"))


TURN_SQL = f"""WITH t AS (SELECT conversation_hash, unnest(conversation) AS c, unnest(range(len(conversation))) AS turn FROM source_conversations WHERE len(conversation) > 0)
SELECT conversation_hash, turn, {Q.strip('c.content')} AS text FROM t WHERE c.role = 'user' AND len({Q.split("coalesce(c.content, '')")}) >= 3"""


def root_prompts(spark, sf):
    """Conversations by language or its variant, with prefixed ids, as of a source with one row per prompt."""
    return tables.prompts(C.first_user(read(spark, sf, "source_conversations")).select(F.col("conversation_hash").alias("message_id"), F.lit("prompter").alias("role"), F.lit(None).cast("string").alias("parent_id"), F.lower(F.substring("language", 1, 2)).alias("lang"), "text"), "en").select("id", "text")


ROOT_SQL = f"SELECT 'oasst2_' || conversation_hash AS id, text FROM ({Q.FIRST}) WHERE lower(substr(language, 1, 2)) = 'en' OR lower(substr(language, 1, 2)) LIKE 'en-%'"


def union_sources(spark, sf):
    """Messages of two tables under one schema, the first source of a text winning."""
    a = read(spark, sf, "messages").select(F.col("id"), "text", "source").withColumn("rank", F.lit(0))
    b = read(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "text").withColumn("rank", F.lit(1))
    u = a.unionByName(b, allowMissingColumns=True).where("text IS NOT NULL")
    return S.first_wins(u, T.normalize("text"), "rank", "id").groupBy(F.coalesce("source", F.lit("documents")).alias("source")).agg(F.count("*").alias("n_kept"))


UNION_SQL = f"""WITH u AS (SELECT id, text, source, 0 AS rank FROM messages UNION ALL SELECT 'doc_' || doc_id, text, NULL, 1 FROM documents)
SELECT coalesce(source, 'documents') AS source, count(*) AS n_kept FROM (SELECT source FROM u WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {Q.normalize('text')} ORDER BY rank, id) = 1) GROUP BY ALL"""


def source_stats(spark, sf):
    m = read(spark, sf, "messages").select("id", "text", "source")
    kept = S.first_wins(m, T.normalize("text"), "id", "text").groupBy("source").agg(F.count("*").alias("kept"))
    return m.groupBy("source").agg(F.count("*").alias("candidates")).join(kept, "source", "left").select("source", "candidates", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


STATS_SQL = f"SELECT a.source, candidates, coalesce(kept, 0) AS kept FROM (SELECT source, count(*) AS candidates FROM messages GROUP BY 1) a LEFT JOIN (SELECT source, count(*) AS kept FROM (SELECT source FROM messages WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {Q.normalize('text')} ORDER BY id, text) = 1) GROUP BY 1) b ON a.source IS NOT DISTINCT FROM b.source"


def page_slice(spark, sf):
    """Rows 20 to 39 of the documents in order."""
    d = read(spark, sf, "documents").select("doc_id", "n_chars")
    return d.orderBy("doc_id").offset(20).limit(20)


def row_numbers(spark, sf):
    return S.ranked(read(spark, sf, "gold_consensus").select("id"), "k", "id").select("id", F.col("k").cast("long").alias("k"))


def length_percentiles(spark, sf):
    """Upper median and 95th percentile of lengths by index, without interpolation.

    The rows are counted by length first, so that the running sums go over the lengths of a source and not over its rows.
    """
    d = read(spark, sf, "documents").where("text IS NOT NULL").groupBy("source", F.length("text").alias("n")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("source")
    d = d.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("total", F.sum("c").over(w))
    pick = lambda at: F.min(F.when(F.col("upto") > at, F.col("n"))).cast("long")
    return d.groupBy("source").agg(pick(F.floor(F.col("total") / 2)).alias("median"), pick(F.least(F.col("total") - 1, F.floor(F.col("total") * 0.95))).alias("p95"))


PERCENT_SQL = """WITH r AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS c FROM documents WHERE text IS NOT NULL)
SELECT source, max(CASE WHEN r = c // 2 THEN n END) AS median, max(CASE WHEN r = least(c - 1, CAST(floor(c * 0.95) AS BIGINT)) THEN n END) AS p95 FROM r GROUP BY source"""

QUERIES = {
    "first_user_message": (first_user_message, FIRST_SQL),
    "floor_titles": (flagship, FLAGSHIP_SQL),
    "corpus_funnel_null_keep": (funnel_null_keep, _funnel_sql("'English'", "false")),
    "corpus_funnel_null_drop": (funnel_null_drop, _funnel_sql(IN_LANGS, "true")),
    "corpus_funnel_whole": (funnel_whole, None),
    "rows_per_language": (rows_per_language, "SELECT language, count(*) AS n FROM source_conversations GROUP BY language"),
    "multi_language_scan": (multi_language_scan, MULTI_SQL),
    "short_messages": (short_messages, SHORT_SQL),
    "exact_dedupe": (exact_dedupe, EXACT_SQL),
    "near_dedupe": (near_dedupe, None),
    "shingle_counts": (shingle_counts, SHINGLE_SQL),
    "bakeoff_exclusion": (exclusion, EXCLUDE_SQL),
    "systematic_sample": (systematic_sample, SYSTEMATIC_SQL),
    "source_waterfill": (source_waterfill, WATER_SQL),
    "site_cap": (site_cap, SITE_SQL),
    "length_buckets": (length_buckets, BUCKET_SQL),
    "time_bounds": (time_bounds, TIME_SQL),
    "stratified_quota": (stratified_quota, QUOTA_SQL),
    "eval_split": (eval_split, SPLIT_SQL),
    "language_gate": (language_gate, GATE_SQL),
    "group_cap": (group_cap, CAP_SQL),
    "canonical_messages": (canonical_messages, CANON_SQL),
    "exploded_turns": (exploded_turns, TURN_SQL),
    "root_prompts": (root_prompts, ROOT_SQL),
    "union_sources": (union_sources, UNION_SQL),
    "source_stats": (source_stats, STATS_SQL),
    "page_slice": (page_slice, "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 20 OFFSET 20"),
    "row_numbers": (row_numbers, "SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM gold_consensus"),
    "index_percentiles": (length_percentiles, PERCENT_SQL),
}
