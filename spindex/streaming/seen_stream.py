"""Seen-URL filter on Structured Streaming.

Discovered URLs arrive as files ``(url, discovered_at)``; the stream emits
each URL the first time it is seen.  Exact mode keeps every URL in the
state store (``dropDuplicates``); bounded mode forgets URLs older than a
watermark (``dropDuplicatesWithinWatermark``), so a URL may be emitted again
once it has aged out — the bounded-memory behaviour of a size-capped seen
set, expressed in event time.  For very large exact state use the RocksDB
state store provider.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.sources.log_table import LogTable
from spindex.streaming.state import scratch_dir

URLS_SCHEMA = "url STRING, discovered_at TIMESTAMP"


def run_seen_stream(spark: SparkSession, source_dir: str, out_dir: str | None = None,
                    files_per_trigger: int = 1, forget_after: str | None = None) -> DataFrame:
    """Drain ``source_dir``; return the emitted (first-seen) URLs."""
    out_dir = out_dir or scratch_dir(spark, "unseen")
    stream = (spark.readStream.schema(URLS_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir))
    if forget_after:
        fresh = (stream.withWatermark("discovered_at", forget_after)
                 .dropDuplicatesWithinWatermark(["url"]))
    else:
        fresh = stream.dropDuplicates(["url"])
    q = (fresh.writeStream.format("parquet").outputMode("append")
         .option("path", f"{out_dir}/data").option("checkpointLocation", f"{out_dir}/_stream")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(URLS_SCHEMA).parquet(f"{out_dir}/data")


# --- bounded by count ----------------------------------------------------------------

GENERATION_SCHEMA = "generation BIGINT, given BIGINT, batch BIGINT"


def _emitted(spark: SparkSession, out_dir: str) -> LogTable:
    return LogTable(spark, f"{out_dir}/urls", "url STRING, generation BIGINT, batch BIGINT", "url")


def _generations(spark: SparkSession, out_dir: str) -> LogTable:
    return LogTable(spark, f"{out_dir}/generations", GENERATION_SCHEMA, "batch", buckets=1)


def emitted_urls(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(url, generation, batch)`` of every URL given out so far, again for those forgotten meanwhile."""
    return _emitted(spark, out_dir).rows()


def _add(batch: DataFrame, epoch: int, out_dir: str, capacity: int, keep: int) -> None:
    """Give out the URLs of a micro-batch that no kept generation holds, into the open generation."""
    spark = batch.sparkSession
    urls, log = _emitted(spark, out_dir), _generations(spark, out_dir)
    # one row per generation so far: how many URLs it has
    sizes = {r["generation"]: r["given"] for r in log.rows(epoch).groupBy("generation").agg(F.sum("given").alias("given"))
             .orderBy(F.desc("generation")).limit(1).collect()}
    newest, given = next(iter(sizes.items()), (0, 0))
    now = newest + 1 if given >= capacity else newest
    known = urls.rows(epoch).where(F.col("generation") > now - keep).select("url")
    fresh = batch.select("url").where("url IS NOT NULL").distinct().join(known, "url", "left_anti")
    urls.append(fresh.select("url", F.lit(now).alias("generation"), F.lit(epoch).alias("batch")), epoch)
    n = urls.of_batch(epoch).count()
    log.append(spark.createDataFrame([(now, n, epoch)], GENERATION_SCHEMA), epoch)


def run_seen_generations(spark: SparkSession, source_dir: str, out_dir: str, capacity: int, keep: int,
                         files_per_trigger: int = 1 << 20) -> str:
    """Drain ``source_dir`` (files with a ``url`` column); a later call with the same folder goes on.

    A generation is closed after the micro-batch that fills it, so it holds ``capacity`` URLs and
    what else that micro-batch brought.
    """
    stream = spark.readStream.schema("url STRING").option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    q = (stream.writeStream.foreachBatch(lambda rows, epoch: _add(rows, epoch, out_dir, capacity, keep))
         .option("checkpointLocation", f"{out_dir}/_stream").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir
