"""Graphs kept as tables: points, edges, partition and trace in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {"points": "id bigint, x array<double>", "edges": "u bigint, v bigint, w double", "partition": "node bigint, cid bigint", "trace": "iter int, di double"}


def save(folder: str, **tables: DataFrame) -> None:
    """Write the given tables, replacing older ones. Each is brought to its schema, so a wrong type fails here."""
    for name, df in tables.items():
        if name not in SCHEMAS:
            raise ValueError(f"tables are {', '.join(SCHEMAS)}")
        df.to(df.sparkSession.createDataFrame([], SCHEMAS[name]).schema).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}")
