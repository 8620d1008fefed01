"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CONVERSATIONS = "conversation_hash string, timestamp timestamp, conversation array<struct<role:string,content:string>>, language string, toxic boolean"
PROMPTS = "message_id string, role string, parent_id string, lang string, text string, created_date timestamp"
INPUTS = "language_code string, inputs string"
PAGES = "domain string, question string, qa_pairs array<struct<question:string>>"
MESSAGES = "id string, text string, n_chars int, timestamp string, source string, site string"
TITLES = "id string, k long, title string, raw string, seconds double, n_words int, words_present boolean, refused boolean, error string"
LABELED = "id string, title string, ids array<int>, labels array<int>, words array<int>"
GOLD = "id string, k long, bucket string, text string, title string, spans array<struct<start:int,end:int>>, impossible boolean, off_language boolean, transcription boolean"
CONSENSUS = "k long, id string, labels array<int>, votes array<int>, annotators map<string,array<int>>"
UNKNOWN_TIME = "9999-12-31T00:00:00"


def conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONVERSATIONS).parquet(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a line that can't be read is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def prompts(df: DataFrame, lang: str) -> DataFrame:
    """Root prompts of a language or one of its variants (pt, pt-BR), with prefixed ids."""
    root = (F.col("role") == "prompter") & F.col("parent_id").isNull() & ((F.col("lang") == lang) | F.col("lang").startswith(f"{lang}-"))
    return df.where(root).withColumn("id", F.concat(F.lit("oasst2_"), "message_id"))


def inputs(df: DataFrame, code: str) -> DataFrame:
    """Rows of one ISO 639-3 code as messages; ids by hash, time unknown."""
    t = T.strip("inputs")
    return df.where(F.col("language_code") == code).select(T.sha1_id("aya_", t).alias("id"), t.alias("text"), F.lit(UNKNOWN_TIME).alias("timestamp"))


def questions(df: DataFrame, min_words: int = 3) -> DataFrame:
    """(id, text, site, timestamp) of the questions of FAQ pages: those of the list, or the page itself when the list is null or empty."""
    each = F.when(F.size(F.coalesce("qa_pairs", F.array())) > 0, F.col("qa_pairs.question")).otherwise(F.array("question"))
    d = df.select(F.coalesce("domain", F.lit("?")).alias("site"), F.explode(each).alias("q")).select("site", T.strip(F.coalesce("q", F.lit(""))).alias("text"))
    return d.where(F.size(T.split_space("text")) >= min_words).select(T.sha1_id("mfaq_", "text").alias("id"), "text", "site", F.lit(UNKNOWN_TIME).alias("timestamp"))
