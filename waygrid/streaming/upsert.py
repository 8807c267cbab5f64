"""Places learned from sightings in a stream: a table of places with counts, kept in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygrid.operators.lines import merged_near


class PlaceTable:
    """Places ``level, name, x, y, n, o`` under a shared folder, one version for each batch.

    A sighting within ``reach`` of an earlier place of its name and level counts there, with the earliest if there are several; else
    it is a place of its own.  So the order counts: places are ordered by ``o`` (batch, then time and id), and a batch merges
    into the version before its own.  A batch that runs again reads that same version and replaces its own, so
    a replay changes nothing.  Versions that no restart can need are deleted.
    """

    KEEP = 2

    def __init__(self, spark: SparkSession, base: str, reach: float):
        self.spark, self.base, self.reach = spark, base.rstrip("/"), reach

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [x.getPath() for x in files.listStatus(path)]
        whole = [x for x in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(int(x.getName().split("=")[1]) for x in whole)

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        version = known[-1] if version is None and known else version
        return self.spark.read.parquet(f"{self.base}/version={version}")

    def merge(self, batch: DataFrame, number: int) -> None:
        """``batch`` has ``level, name, x, y, time, id``; for ``foreachBatch``."""
        order = F.struct(F.lit(number).cast("bigint").alias("batch"), F.col("time").cast("double").alias("time"), F.col("id").cast("bigint").alias("id"))
        rows = batch.select("level", "name", "x", "y", order.alias("o"), F.lit(1).cast("bigint").alias("n"))
        before = [v for v in self.versions() if v < number]
        if before:
            rows = rows.unionByName(self.read(before[-1]))
        merged = merged_near(rows, ["level", "name"], "o", self.reach, weight="n")
        merged.withColumnRenamed("kept", "o").write.mode("overwrite").parquet(f"{self.base}/version={number}")
        for old in before[: -self.KEEP + 1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/version={old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def learned_places(sightings: DataFrame, base: str, reach: float) -> DataFrame:
    """Run a stream of ``level, name, x, y, time, id`` over what is there and give the places: ``level, name, x, y, n, o``."""
    table = PlaceTable(sightings.sparkSession, f"{base}/places", reach)
    query = sightings.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()
