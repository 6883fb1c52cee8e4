"""L7 with expiry: rating requests as a stream; a repeated input is scored
again only when its last score is older than ``ttl_seconds``.

The state of an input (its feature values are the key) is the time when it was
last scored, with a time-to-live, so inputs that don't come back are
forgotten.  It marks every request as fresh or as served by an earlier score.  Each
micro-batch scores its fresh inputs with the batch operator, adds them to the
table of scores, and joins every request to the score that serves it.

A key's rows in one micro-batch are sorted by time in one task; ``max_files``
bounds a micro-batch, and only ids, times and feature values are held.  A replayed
micro-batch overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import Row, StructType

from platewise.operators.models import RatingModel, predict_rating

# Read by a query when it starts: state with a time-to-live needs this store, and asks
# for a batch without data after every batch, which only forgets old inputs earlier.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class LastScored(StatefulProcessor):
    """Marks the requests of one input: ``scored_at`` is the time of the score
    that serves the request, ``fresh`` says that it is its own.  Times are
    microseconds, free of time zones."""

    def __init__(self, keys: Sequence[str], ttl_seconds: int):
        self.keys, self.ttl_seconds = tuple(keys), ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "scored_at long", self.ttl_seconds * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for at, request_id in sorted((r.requested_at, r.request_id) for r in rows):
            fresh = last is None or at >= last + self.ttl_seconds * 1_000_000
            last = at if fresh else last
            yield Row(
                request_id=request_id, requested_at=at, scored_at=last, fresh=fresh,
                **dict(zip(self.keys, key)),
            )
        if last != before:
            self.last.update((last,))

    def close(self) -> None:
        pass


def marked_requests(requests: DataFrame, keys: Sequence[str], ttl_seconds: int = 3600) -> DataFrame:
    """The stream ``requests(request_id, requested_at, *keys)`` with
    ``scored_at`` and ``fresh``.  Needs the RocksDB state store."""
    types = {f.name: f.dataType for f in requests.schema}
    out = StructType().add("request_id", types["request_id"]).add("requested_at", "long")
    out = out.add("scored_at", "long").add("fresh", "boolean")
    for k in keys:
        out = out.add(k, types[k])
    known = requests.where("request_id IS NOT NULL AND requested_at IS NOT NULL")
    known = known.withColumn("requested_at", F.unix_micros("requested_at"))
    marked = known.groupBy(*keys).transformWithState(
        statefulProcessor=LastScored(keys, ttl_seconds), outputStructType=out, outputMode="Update",
        timeMode="ProcessingTime",
    )
    return marked.withColumns(
        {c: F.timestamp_micros(c) for c in ("requested_at", "scored_at")}
    )


def stream_cached_ratings(
    spark: SparkSession,
    model: RatingModel,
    source_dir: str,
    schema: str,
    folder: str,
    ttl_seconds: int = 3600,
    max_files: int = 100,
    fmt: str = "json",
    available_now: bool = False,
) -> StreamingQuery:
    """Requests as files in ``source_dir``, with the columns ``request_id``,
    ``requested_at`` and feature values (see ``predict_rating``).  Below ``folder``:
    ``results`` (request_id, requested_at, scored_at, fresh, predicted_rating),
    ``scores`` (one row per scoring) and ``checkpoint``.  A request without an
    id or a time is left out."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    stream = stream.load(source_dir)
    keys = [c for c in stream.columns if c not in ("request_id", "requested_at")]
    marked = marked_requests(stream, keys, ttl_seconds)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read twice; recomputed from the state store's version if lost
        fresh = batch.where("fresh").select(*keys, "scored_at").distinct()
        scored = predict_rating(model, fresh)
        scored.write.mode("overwrite").parquet(f"{folder}/scores/batch={batch_id}")
        # only the scores that can still serve are read
        oldest = batch.agg(F.min("scored_at")).first()[0]
        if oldest is not None:
            scores = spark.read.parquet(f"{folder}/scores").where(F.col("scored_at") >= F.lit(oldest))
            scores = scores.drop("batch").alias("s")
            same = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]
            served = batch.alias("b").join(scores, [*same, F.col("b.scored_at") == F.col("s.scored_at")])
            served.select(
                "request_id", "requested_at", "b.scored_at", "fresh", "predicted_rating"
            ).write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")
        batch.unpersist()

    writer = marked.writeStream.outputMode("update").foreachBatch(write_batch)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
