"""Scans of the parquet tables and the small set-up every plan shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; a file and a folder of parts read alike."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def c(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread(df: DataFrame) -> DataFrame:
    """Give Python stages at least one task a core.

    Inputs that already have as many partitions as cores, which is every input of
    some size, are left alone, so that no shuffle is added at scale. For scans only:
    behind a shuffle, asking for the number of partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the setting is absent and all runs on one machine (tests), a temporary folder is set; a cluster without it is refused.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="caseloom-"))
        found = sc.getCheckpointDir()
    return found


_CUTS: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the tables that cut() wrote in this application; call it when the results that read them are written. Returns their number."""
    sc = spark.sparkContext
    paths = _CUTS.pop(sc.applicationId, [])
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def cut(df: DataFrame, name: str = "stage", schema: StructType | None = None) -> DataFrame:
    """Write df to a parquet table in the shared folder and read it back.

    Cuts the lineage as checkpoint() does, but keeps columns prunable and small;
    it survives the loss of executors, as the files are in the shared folder. schema:
    other types of the same columns, to read them back as. release() deletes the tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, proven to have that many rows at most, as a local table; an error beyond. For what is broadcast."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table that is broadcast may have {most} rows at most")
    return df.sparkSession.createDataFrame(rows, df.schema)
