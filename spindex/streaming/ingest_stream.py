"""Micro-batch page ingest on Structured Streaming.

Captured responses arrive as Parquet files; each micro-batch (bounded by
``maxFilesPerTrigger``) is appended to the link graph's tables with the batch
``ingest`` operator inside ``foreachBatch``: a micro-batch writes what it
brings, and its tables are merged by size now and then.  The available-now
trigger drains what is there and stops (the idle flush of a long-running
crawler); a processing-time trigger keeps it running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindex.plans.ingest import LinkGraph, compact, ingest
from spindex.sources.responses import RESPONSES_SCHEMA
from spindex.streaming.state import scratch_dir

COMPACT_EVERY = 8  # micro-batches


def load_graph(spark: SparkSession, state_dir: str, epoch: int | None = None) -> LinkGraph:
    """The graph after ``epoch`` (by default after the last committed micro-batch)."""
    g = LinkGraph(spark, state_dir)
    return LinkGraph(spark, state_dir, (g.batches.latest() if epoch is None else epoch) + 1)


def run_ingest_stream(spark: SparkSession, source_dir: str, state_dir: str | None = None,
                      files_per_trigger: int = 1, available_now: bool = True, budget: int | None = None):
    """Drain ``source_dir`` into the graph kept in ``state_dir``.

    Returns ``(state_dir, query)``; with ``available_now`` the query has finished when this returns.
    A later call with the same ``state_dir`` goes on with the files that came meanwhile.
    """
    state_dir = state_dir or scratch_dir(spark, "ingest-state")
    stream = (spark.readStream.schema(RESPONSES_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir))

    def merge(batch: DataFrame, epoch_id: int) -> None:
        graph, _ = ingest(LinkGraph(batch.sparkSession, state_dir, epoch_id), batch, budget=budget)
        if graph.batch % COMPACT_EVERY == 0:
            compact(graph)

    w = (stream.writeStream.foreachBatch(merge)
         .option("checkpointLocation", f"{state_dir}/_stream"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="25 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return state_dir, q
