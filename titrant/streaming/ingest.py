"""Continuous ingestion: new result rows are finalised as they arrive, and only what a cache lacks is generated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dims import aliases, reference
from ..operators.extract import manual_rows
from ..operators.results import cache_misses, finalise
from ..sources.kept import kept
from ..sources.tables import read_cache


def finalised(rows: DataFrame) -> DataFrame:
    """A stream or table of raw rows (raw_name, value, unit) as finalised rows; stateless, so append mode needs no watermark."""
    spark = rows.sparkSession
    ref = reference(spark)
    return finalise(manual_rows(rows, aliases(spark, ref)), ref)


def run_finalise(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    rows = spark.readStream.schema(schema).parquet(source)
    writer = finalised(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_cache_fill(spark: SparkSession, source: str, schema: str, keys: list[str], fill, cache_path: str, cache_schema: str, checkpoint: str) -> StreamingQuery:
    """Per micro-batch: entries of ``fill(misses)`` for keys that the cache lacks are added to it.

    Each batch has a folder of its own, overwritten when the batch is run again, so a retried batch adds nothing twice."""

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        known = read_cache(session, cache_path, f"{cache_schema}, batch long").where(F.coalesce("batch", F.lit(-1)) != number).drop("batch")
        missing = cache_misses(rows.dropDuplicates(keys), known, keys)
        kept(fill(missing)).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
