"""Change streams: last event of a key, sessions of quiet gaps, windows, retries, pending batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.build import last_wins


def compact(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key."""
    return last_wins(events, key, order)


def _watermarked(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if stream.isStreaming else stream


def debounced(stream: DataFrame, ts: str, key: str, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): bursts of a key that a gap without events ends, on streams and tables."""
    own = _watermarked(stream, ts, late)
    return own.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(stream: DataFrame, ts: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total): counts and sums of value in windows."""
    own = _watermarked(stream, ts, late)
    return own.groupBy(F.window(ts, size).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def run_to_end(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, attempts: int = 3, delay: float = 0.1):
    """Applies each micro-batch, up to attempts times, and ends when the source has no more. A batch
    that fails stays pending in the checkpoint and comes again with the next start."""

    def tried(batch: DataFrame, number: int) -> None:
        for k in range(attempts):
            try:
                return apply(batch, number)
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(max(0.1, delay))

    query = stream.writeStream.foreachBatch(tried).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_aggregate(aggregated: DataFrame, path: str, checkpoint: str) -> None:
    """Writes the whole state of a streamed aggregate to path after each micro-batch, and ends when the
    source has no more."""

    def whole(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    aggregated.writeStream.outputMode("complete").foreachBatch(whole).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _places(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which batch last wrote each bucket, after the batch of this number."""
    return {r.bucket: r.number for r in spark.read.parquet(f"{path}/places/{number}").collect()}


def upsert_latest(batch: DataFrame, number: int, path: str, key: str, order: str, buckets: int = 64) -> None:
    """Folds a batch into the table of latest events at path. Keys lie in buckets by hash; those that
    a batch touches are written anew below its number, and a small table beside them says where each
    bucket is, so that a repeated batch writes the same again. The number of buckets stays as it is."""
    spark = batch.sparkSession
    own = _bucketed(compact(batch, key, order), key, buckets)
    places = _places(spark, path, number - 1) if number > 0 else {}
    hit = [r[0] for r in own.select("__bucket").distinct().collect()]
    old = [f"{path}/rows/{places[b]}/__bucket={b}" for b in hit if b in places]
    if old:
        own = _bucketed(compact(spark.read.schema(batch.schema).parquet(*old).unionByName(own.drop("__bucket")), key, order), key, buckets)
    own.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/rows/{number}")
    now = places | dict.fromkeys(hit, number)
    spark.createDataFrame(list(now.items()), "bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/places/{number}")


def latest(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The table of upsert_latest() after the batch of this number."""
    places = _places(spark, path, number)
    return spark.read.parquet(*[f"{path}/rows/{n}/__bucket={b}" for b, n in sorted(places.items())])
