"""Intermediate tables and lineage cuts in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where that is unset (local runs and tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if given:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(given)
        return given
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="orrery-")
    sc.setCheckpointDir(own)
    return own


def write_table(df: DataFrame, name: str, *by: str) -> str:
    """Write df as Parquet into the shared folder, in folders by some columns if asked; returns its path. The files go when the session ends or on drop_table()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """df, computed once and read back: cuts the lineage and survives the loss of executors."""
    spark, schema = df.sparkSession, df.schema
    return spark.read.schema(schema).parquet(write_table(df, name))


def drop_table(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_table(spark, path)
        except Exception:
            pass
