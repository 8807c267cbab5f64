"""Stored tables as streams, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from waygrid.plans.scratch import shared_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream: the files that are there now, then any that are added."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, and read what it wrote; a restart goes on from its checkpoint.

    Each batch writes a folder of its own, named by its number, so a batch that runs again after a failure
    replaces itself.  In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/waygrid/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    folders = sorted(set(seen))[-1:] if mode == "complete" else sorted(set(seen))
    if not folders:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/batch={n}" for n in folders])
