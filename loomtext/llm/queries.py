"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import consensus, defects, formatting, language, mixing, neardup, packing, personal, spans, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defects(table(spark, sf_dir, "teacher_titles"), table(spark, sf_dir, "messages"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir).select("run_id", "defect")


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type of defect that a record has, one row each."""
    return _defects(spark, sf_dir).select("run_id", F.explode("all_defects").alias("defect"))


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    return consensus.Consensus(table(spark, sf_dir, "gold_consensus"), table(spark, sf_dir, "annotator_titles"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).labels().where("label = 1").select("k", "word_pos")


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).agreement()


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).reliability()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, sf_dir, "documents"), words=3, threshold=0.8).pairs().select("doc_id_1", "doc_id_2")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, sf_dir, "documents"), words=3, threshold=0.8).groups()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.pairs(table(spark, sf_dir, "messages"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.collapsed(table(spark, sf_dir, "messages"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "messages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("is_toxic").select("id")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(_scored(spark, sf_dir))


def _personal(spark: SparkSession, sf_dir: str) -> personal.PersonalInformation:
    return personal.PersonalInformation(table(spark, sf_dir, "documents"), table(spark, sf_dir, "given_names"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).pieces()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).redacted()


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(table(spark, sf_dir, "messages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.doubtful(_segments(spark, sf_dir))


def p7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.documents(_segments(spark, sf_dir))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_packing(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).rows()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_portion(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (p1_found, p1_defects, p2_found, p2_agreement, p2_reliability, p3_found, p3_groups, p4_found, p4_collapsed, p5_found, p5_scores, p5_rates, p6_found, p6_redacted, p7_found, p7_languages, p7_segments, p8_packing, p8_filled, p9_mixture, p9_shares, p10_found, p10_share)
    return {f.__name__: f for f in each}


#: All pairs by their shared runs of three words; all windows of 200 characters.
SQL = {
    "p3_found": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_id_1, doc_id_2 FROM j JOIN n x ON x.doc_id = doc_id_1 JOIN n y ON y.doc_id = doc_id_2 WHERE c >= 0.8 * (x.n + y.n - c)""",
    "p10_found": """WITH p AS (SELECT doc_id, unnest(list_transform(range(length(text) - 199), lambda i: md5(substr(text, i + 1, 200)))) AS h, unnest(range(length(text) - 199)) AS s FROM documents WHERE length(text) >= 200),
r AS (SELECT h FROM p GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 1 ELSE 0 END AS new FROM p JOIN r USING (h)),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m)
SELECT doc_id, min(s) AS span_start, max(s) + 200 AS span_end FROM i GROUP BY doc_id, island""",
}


#: Share of each document that its spans cover.
SQL["p10_share"] = f"""WITH s AS (SELECT doc_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars FROM ({SQL["p10_found"]}) GROUP BY doc_id), d AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents GROUP BY doc_id)
SELECT doc_id, n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN round(coalesce(shared_chars, 0) / n_chars, 6) ELSE 0.0 END AS share FROM d LEFT JOIN s USING (doc_id)"""
#: Classes of equal sets by the sets themselves, links between classes, and what can be reached over links.
SQL["p3_groups"] = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
h AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS own, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY own) AS class_id FROM h),
r AS (SELECT s.doc_id, g, n FROM s JOIN c ON c.doc_id = s.doc_id AND c.class_id = c.doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
p AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT p.a, l.y FROM p JOIN l ON l.x = p.b), m AS (SELECT a, min(b) AS group_id FROM p GROUP BY a), k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(group_id, d.doc_id) AS group_id, coalesce(n_links, 0) AS n_links FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.a = c.class_id LEFT JOIN k ON k.x = c.class_id"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
