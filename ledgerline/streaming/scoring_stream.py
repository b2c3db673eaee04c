"""Score statements as they arrive, log the predictions, and watch them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions.scores import PD_LIMITS, pd_histogram
from ledgerline.operators.drift import bin_index


def score_stream(
    source: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    log_path: str,
    checkpoint: str,
    available_now: bool = True,
    output_mode: str = "append",
) -> StreamingQuery:
    """Score each micro-batch on its own, like one request, into a prediction log.

    Features with state (``customer_state.running_features``) take output mode ``update``.

    A batch owns the folder ``batch=<id>`` and overwrites it, so a replayed batch
    leaves no duplicates.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        logged = score(batch).withColumn("scored_at", F.current_timestamp())
        logged.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    writer = source.writeStream.outputMode(output_mode).foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def pd_counters(
    scored: DataFrame,
    pd: str,
    scored_at: str,
    window: str = "1 hour",
    late: str = "2 hours",
    limits: Sequence[float] = PD_LIMITS,
) -> DataFrame:
    """Running counters and cumulative histogram of scored customers per time window."""
    events = scored.withColumn("_at", F.col(scored_at).cast("timestamp"))
    return (
        events.withWatermark("_at", late)
        .groupBy(F.window("_at", window).alias("w"))
        .agg(*pd_histogram(F.col(pd), limits))
        .withColumn("window_start", F.col("w.start").cast("timestamp_ntz"))
        .drop("w")
    )


def drift_counters(
    scored: DataFrame, pd: str, scored_at: str, edges: Sequence[float], window: str = "1 day", late: str = "2 hours"
) -> DataFrame:
    """Scores per bin and time window, at the fixed inner ``edges`` of the training reference.

    One row of counters per window is all the state; ``drift.psi_of_counters`` turns it into PSI. Missing scores count nowhere.
    """
    v = F.col(pd).cast("double")
    bin_ = bin_index(v, [F.lit(float(e)) for e in edges])
    present = v.isNotNull() & ~F.isnan(v)
    counts = [F.count_if(present & (bin_ == i)).alias(f"b{i}") for i in range(len(edges) + 1)]
    events = scored.withColumn("_at", F.col(scored_at).cast("timestamp"))
    counted = events.withWatermark("_at", late).groupBy(F.window("_at", window).alias("w")).agg(*counts)
    return counted.withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")


def late_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because they came after the watermark, over the progress it still holds."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def append_counters(counters: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Production sink: closed windows are appended; rows later than the watermark are dropped."""
    writer = (
        counters.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replace_counters(counters: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The full state after every batch, open windows included: one small table."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state={batch_id}")

    return (
        counters.writeStream.outputMode("complete").foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def finish(query: StreamingQuery) -> int:
    """Wait for an available-now query; returns its last batch id."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query.lastProgress["batchId"] if query.lastProgress else -1
