"""Writers: JSON lines, statistics, reports and tables of scores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One object a line, UTF-8 as it is; an existing corpus is refused unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_by_language(df: DataFrame, path: str, column: str = "code", overwrite: bool = False) -> None:
    """One pass over the data, one folder per language."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(column).json(path)


def statistics(df: DataFrame) -> str:
    """The one row of counts as JSON text, nested columns included."""
    row = df.select(F.to_json(F.struct(*df.columns)).alias("j")).first()
    return row["j"] if row else "{}"


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown; nulls are dashes. At most ``limit`` rows: it is a report."""
    rows = df.limit(limit).collect()
    show = lambda v: "—" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def source_summary(df: DataFrame, group: str, source: str, kept: str, taken: str) -> DataFrame:
    """One row a group, one column a source: "kept", or "kept -> taken" where fewer were taken; null where a source is unused."""
    cell = F.when(F.col(kept) == F.col(taken), F.col(kept).cast("string")).otherwise(F.concat(F.col(kept).cast("string"), F.lit(" -> "), F.col(taken).cast("string")))
    return df.groupBy(group).pivot(source).agg(F.first(cell))


def replace_table(document: str, header: str, table: str) -> str:
    """The document with its one Markdown table whose first line begins with ``header`` replaced."""
    lines = document.split("\n")
    begin = next((i for i, x in enumerate(lines) if x.startswith(header)), None)
    if begin is None:
        raise ValueError(f"no table begins with {header!r}")
    end = begin
    while end < len(lines) and lines[end].startswith("|"):
        end += 1
    return "\n".join(lines[:begin] + table.rstrip("\n").split("\n") + lines[end:])


def scores_json(long: DataFrame, metric: str, model: str = "model", language: str = "language", score: str = "score") -> str:
    """The long table of scores as nested JSON: model, language, score. One row per model and language."""
    models: dict[str, dict[str, float]] = {}
    for r in long.select(model, language, score).orderBy(model, language).collect():
        models.setdefault(r[0], {})[r[1]] = r[2]
    return json.dumps({"metric": metric, "models": {k: {"scores": v} for k, v in models.items()}}, ensure_ascii=False)


def flag_off_language(df: DataFrame, rejected: str = "rejected") -> DataFrame:
    """The flag set where the gate rejects and null elsewhere; written to another path by the caller, never in place."""
    return df.withColumn("off_language", F.when(F.col(rejected), F.lit(True))).drop(rejected)
