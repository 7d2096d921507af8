"""Resumable generation as a stream: new requests are answered once and appended.

The checkpoint remembers which request files were read; a left anti join against
the results skips pairs answered before, so a rerun after a crash only does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenrec.operators.explain import Backend, generate, pending
from lumenrec.sources.readers import exists


def answer_batch(spark: SparkSession, requests: DataFrame, results: str, backend: Backend) -> None:
    todo = pending(requests, spark.read.parquet(results)) if exists(spark, results) else requests
    generate(todo.dropDuplicates(["user_id", "movie_id"]), backend).write.mode("append").parquet(results)


def run(spark: SparkSession, requests: str, schema, results: str, checkpoint: str, backend: Backend, files_per_batch: int = 16) -> StreamingQuery:
    """Reads request files, micro-batch by micro-batch, until none is left."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(requests)
    return (
        stream.writeStream.foreachBatch(lambda df, _: answer_batch(spark, df, results, backend))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
