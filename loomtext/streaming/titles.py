"""Titles and first messages over streams. Scoring keeps no state; the checkpoint of the query is the resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import corpus, tagger


def messages(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Files of plain text, a message a line."""
    return spark.readStream.text(folder).select(F.sha1(F.encode("value", "UTF-8")).alias("id"), F.col("value").alias("text"))


def first_messages(conversations: DataFrame) -> DataFrame:
    return corpus.usable_length(corpus.first_user(conversations)).select("conversation_hash", "text", T.floor_title("text").alias("floor_title"))


def distinct_messages(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Each normalized text once within the watermark; later deliveries of it are dropped."""
    return stream.withWatermark(time, delay).withColumn("_k", T.normalize("text")).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def titles_stream(stream: DataFrame, model, path: str, checkpoint: str, once: bool = True, **choice) -> StreamingQuery:
    """Appends titles as JSON lines; a restarted query goes on behind its checkpoint."""
    out = tagger.titles(stream, model, **choice) if model is not None else stream.withColumn("title", T.floor_title("text"))
    writer = out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
