"""Sinks: Parquet tables, JSON, appended JSON lines, Markdown tables."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append records; Spark's committer stands in for a lock."""
    df.write.mode("append").json(path)


def metrics_json(spark: SparkSession, metrics: dict, path: str) -> None:
    """A metric dictionary as one JSON file."""
    text = json.dumps(metrics, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def corpus(chunks: DataFrame, path: str) -> None:
    """Corpus records and the doc-to-movie map."""
    overwrite(chunks, f"{path}/corpus")
    overwrite(chunks.select("doc_id", "movie_id"), f"{path}/doc_to_movie")


def faithfulness(detailed: DataFrame, summary: DataFrame, metadata: dict, path: str) -> None:
    detailed.write.mode("overwrite").json(f"{path}/detailed")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    metrics_json(detailed.sparkSession, metadata, f"{path}/metadata")


def explanations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_explanations(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A padded Markdown table; numbers in six significant digits, NaN and null empty."""

    def cell(v) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    body = [[cell(r.get(c)) for c in columns] for r in rows]
    width = [max(map(len, col)) for col in zip(columns, *body, strict=True)]

    def line(cells) -> str:
        return "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"

    return "\n".join([line(columns), "| " + " | ".join("-" * w for w in width) + " |", *map(line, body)])


def markdown_of(df: DataFrame, limit: int = 1000) -> str:
    """A report table (a bounded number of rows by nature)."""
    rows = [r.asDict() for r in df.limit(limit).collect()]
    return markdown(rows, df.columns)


def with_backup(df: DataFrame, base: str, variant: str) -> str:
    """Experiments write to a path per variant, so nothing has to be backed up and restored."""
    path = f"{base}/variant={variant}"
    overwrite(df.select([F.col(c) for c in df.columns]), path)
    return path
