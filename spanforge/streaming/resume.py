"""Incremental work: each case once, whatever was interrupted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def remaining(prompts: DataFrame, done: DataFrame | None) -> DataFrame:
    """Cases without a result yet."""
    return prompts if done is None else prompts.join(done.select("case_id"), "case_id", "left_anti")


def completed(spark: SparkSession, path: str) -> DataFrame | None:
    """Results written before, or None."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # Spark raises AnalysisException for a path that isn't there yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def run_batch(spark: SparkSession, prompts: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Answers the cases that ``path`` doesn't hold yet and appends them; a repeated case is answered once."""
    answer(remaining(prompts.dropDuplicates(["case_id"]), completed(spark, path))).write.mode("append").parquet(path)


def run_stream(spark: SparkSession, source: str, schema: str, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Prompt files as they arrive: every file is read once, every case answered once. A batch that was interrupted
    before its commit is run again; cases that its first run wrote are then skipped."""
    prompts = spark.readStream.schema(schema).json(source)

    def write(batch: DataFrame, _: int) -> None:
        run_batch(batch.sparkSession, batch, answer, path)

    return prompts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
