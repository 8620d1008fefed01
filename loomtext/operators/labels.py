"""Token labels from spans, spans from hand titles, and which examples and gold rows count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .decode import overlaps

MAX_TOKENS = 512


def label_tokens(text: Column, tokens: Column, spans: Column, limit: int = MAX_TOKENS) -> Column:
    """0/1 for each of the first ``limit`` tokens: does it share a character with a span, its leading white space left aside?

    tokens, spans: arrays of struct(start, end) in code points.
    """

    def label(t: Column) -> Column:
        piece = text.substr(t["start"] + 1, t["end"] - t["start"])
        lead = F.length(piece) - F.length(F.regexp_replace(piece, f"^[{T.SPACE}]+", ""))
        return overlaps(t["start"] + lead, t["end"], spans).cast("int")

    return F.transform(F.slice(tokens, 1, limit), label)


def title_spans(text: Column, title: Column) -> Column:
    """Spans of a hand title's words in the text, strictly in order and in the same case; null if a word isn't found.

    A word is bounded by anything but letters and digits and the low line, which belongs to a word here; ideographs, kana and hangul bound too.
    """
    inner = rf"[\p{{L}}\p{{N}}_&&[^{T.UNSPACED}]]"
    zero = F.expr("named_struct('at', 0, 'ok', true, 'out', cast(array() as array<struct<start:int,end:int>>))")

    def step(acc: Column, w: Column) -> Column:
        rest = text.substr(acc["at"] + 1, F.length(text))
        before = F.when(acc["at"] > 0, text.substr(acc["at"], F.lit(1))).otherwise(F.lit(""))
        form = F.concat(F.lit(f"(?s)^(.*?)(?<!{inner})"), F.lit(r"\Q"), w, F.lit(r"\E"), F.lit(f"(?!{inner})"))
        # the character before the cursor is put in front again, for the boundary
        head = F.coalesce(F.call_function("regexp_extract", F.concat(before, rest), form, F.lit(1)), F.lit(""))
        found = F.regexp_like(F.concat(before, rest), form)
        start = (acc["at"] - F.length(before) + F.length(head)).cast("int")
        end = (start + F.length(w)).cast("int")
        return F.struct(
            F.when(found, end).otherwise(acc["at"]).alias("at"),
            (acc["ok"] & found).alias("ok"),
            F.when(found, F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(T.split_space(title), zero, step, lambda acc: F.when(acc["ok"], acc["out"]))


def usable_gold(gold: DataFrame) -> DataFrame:
    """Rows that are scored: not impossible, off-language or a transcription, and with a title; missing flags are false."""
    flag = lambda c: ~F.coalesce(F.col(c), F.lit(False)) if c in gold.columns else F.lit(True)
    return gold.where(flag("impossible") & flag("off_language") & flag("transcription")).where(T.strip(F.coalesce("title", F.lit(""))) != "")


def usable_examples(df: DataFrame) -> DataFrame:
    """Labeled examples with tokens and at least one positive."""
    return df.where(F.size("ids") > 0).where(F.exists("labels", lambda x: x == 1))


def short_examples(messages: DataFrame, text: str = "text") -> DataFrame:
    """Short messages as examples that keep every word: adds ``spans`` of all runs of letters and digits; those without any are left out."""
    runs = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    zero = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>))")

    def step(acc: Column, p: Column) -> Column:
        end = (acc["at"] + F.length(p)).cast("int")
        own = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p.rlike(r"^[\p{L}\p{N}]"), F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return messages.withColumn("spans", F.aggregate(runs, zero, step, lambda acc: acc["out"])).where(F.size("spans") > 0)


def file_parts(name: Column) -> tuple[Column, Column, Column]:
    """Version, scope and key of a model file's name; the key has the version unless it is ``current`` (see ``file_key``)."""
    form = r"^titler-v([0-9.]+)-(.+)-int3\.bin$"
    version, scope = F.regexp_extract(name, form, 1), F.regexp_extract(name, form, 2)
    return version, scope, F.concat_ws("@", scope, version)


def file_key(name: Column, current: str) -> Column:
    version, scope, key = file_parts(name)
    return F.when(version == current, scope).otherwise(key)
