"""Structured Streaming jobs. The transforms are the batch ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import CheckSuite, issues_frame
from ..operators.rollups import WINDOW, windowed_means, windowed_rate
from ..operators.scoring import align_features, parse_payload, score

LATENESS = "10 minutes"


def file_stream(spark: SparkSession, folder: str, name_pattern: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number per batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into parquet, and read it back.

    The sink's log and the checkpoint beside it make a restarted run exact.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def stream_score(
    payloads: DataFrame,
    schema: Mapping[str, str],
    model: Transformer,
    payload: str = "payload",
    threshold: float | None = None,
) -> DataFrame:
    """Parse, align, score with a fitted model and decide, at the model's own threshold unless one is given.

    Stateless, so batch and stream agree. Lookup tables are joined as static tables; the model's sizes were counted when it was fitted, so
    nothing looks at a row before the stream starts.
    """
    parsed = payloads.withColumn("features", parse_payload(F.col(payload))).where(F.col("features").isNotNull())
    return score(align_features(parsed.drop(payload), schema), model, threshold)


def stream_counts(events: DataFrame, by: Sequence[str], ts: str = "ts", lateness: str = LATENESS, size: str = WINDOW) -> DataFrame:
    """Windowed counts and rates per label; rows later than the watermark are dropped."""
    return windowed_rate(events.withWatermark(ts, lateness), by, ts, size)


def stream_means(events: DataFrame, values: Sequence[str], ts: str = "ts", lateness: str = LATENESS, size: str = WINDOW) -> DataFrame:
    return windowed_means(events.withWatermark(ts, lateness), values, ts, size)


def stream_quality(stream: DataFrame, suite: CheckSuite, path: str) -> DataFrame:
    """Run the quality suite on every micro-batch and append its issues.

    Issues go to a folder per batch id, written over on a replayed batch, so a
    restart neither loses nor repeats any.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            found, _ = suite.run(batch)
            issues_frame(batch.sparkSession, found).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
                f"{path}/issues/batch_id={batch_id}"
            )
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(check)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/issues")
