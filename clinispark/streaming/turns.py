"""Turns that arrive as files, scored in a stream. The batch operators are the same; this only packages them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinispark.operators import roles


def running_scores(spark: SparkSession, path: str, schema) -> DataFrame:
    """Indicator score of each speaker so far, over a folder of turn files (recording_id, speaker, text)."""
    turns = spark.readStream.schema(schema).parquet(path)
    return turns.groupBy("recording_id", "speaker").agg(F.sum(roles.indicator_count(F.col("text"))).alias("score"))


def drain(scored: DataFrame, path: str) -> DataFrame:
    """All files there are now, then stops -> the scores.

    Only what a batch changed is written, under its own number, so a batch that is repeated after a failure replaces itself;
    the state goes on from the checkpoint with the next call. The last batch of a speaker has the score so far.
    """
    put = lambda changed, batch: changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
    query = scored.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    changes = scored.sparkSession.read.parquet(f"{path}/changes")
    keys = [c for c in scored.columns if c != "score"]
    return changes.groupBy(*keys).agg(F.max_by("score", "batch").alias("score"))
