"""Tables that cut lineage between the passes of one plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: ``spark.checkpoint.dir``, else the warehouse.

    On a cluster that names neither, the warehouse is a folder of the driver's machine, which is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if (warehouse.startswith("file:") or warehouse.startswith("/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = warehouse + "/_scratch"
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows reads files that outlive any executor, so a lost executor costs its own unfinished tasks only
    and nothing above is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waygrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, such as those of the rounds before."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()[:1]}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
