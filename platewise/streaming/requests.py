"""Serving requests as a stream.

The reference answers one HTTP request at a time.  Here a directory of
request files is a Structured Streaming source; each micro-batch is scored
with the same batch operators (``recommend`` / ``predict_rating``) and
appended to a parquet sink.  The checkpoint location makes the query
restartable with exactly-once output per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from platewise.operators.similarity import REQUEST_SCHEMA, Recommender, fit_recommender, recommend


def stream_requests(
    spark: SparkSession,
    source_dir: str,
    schema: str,
    score: Callable[[DataFrame], DataFrame],
    sink_dir: str,
    checkpoint: str,
    fmt: str = "json",
    available_now: bool = False,
) -> StreamingQuery:
    """Score request files as they arrive: ``score(batch) -> result`` per
    micro-batch, appended to ``sink_dir`` (parquet)."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # idempotent per batch id: a replayed batch overwrites its own folder
        score(batch).write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def stream_recommendations(
    spark: SparkSession,
    venues: DataFrame,
    source_dir: str,
    sink_dir: str,
    checkpoint: str,
    top_n: int = 10,
    available_now: bool = False,
) -> tuple[StreamingQuery, Recommender]:
    """Recommendation requests (``REQUEST_SCHEMA``) as a stream.  The
    recommender is fitted once; every micro-batch is scored against it.
    Returns the query and the fitted state, to ``release`` when it ends."""
    state = fit_recommender(venues).persist()
    query = stream_requests(
        spark,
        source_dir,
        REQUEST_SCHEMA,
        lambda batch: recommend(batch, state, top_n),
        sink_dir,
        checkpoint,
        available_now=available_now,
    )
    return query, state
