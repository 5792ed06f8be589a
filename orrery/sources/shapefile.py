"""A source for the point records of .shp files, and sinks for graphs, traces and shapes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ShapeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob
        import os

        files = sorted(glob.glob(os.path.join(self.path, "*.shp"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(f) for f in files]

    def read(self, partition) -> Iterator[tuple]:
        import struct

        with open(partition.value, "rb") as f:
            f.seek(100)
            while len(head := f.read(8)) == 8:
                number, words = struct.unpack(">ii", head)
                body = f.read(2 * words)
                kind = struct.unpack("<i", body[:4])[0]
                # Points, also those with measures or heights; empty shapes have no place.
                if kind in (1, 11, 21):
                    x, y = struct.unpack("<dd", body[4:20])
                    yield partition.value, number, x, y
                elif kind == 0:
                    yield partition.value, number, None, None


class ShapeSource(DataSource):
    """spark.read.format("shapefile").load(path): (file, record, x, y), one task per file. Other shapes than points are passed over."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "file string, record bigint, x double, y double"

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(self.options["path"])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ShapeSource)
    return spark.read.format("shapefile").load(path)


def write_shp(points: list[tuple[float, float]], path: str) -> None:
    """A .shp file of points; for tests and small exchanges."""
    body = b"".join(struct.pack(">ii", k + 1, 10) + struct.pack("<idd", 1, x, y) for k, (x, y) in enumerate(points))
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    head = struct.pack(">iiiiiii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii", 1000, 1) + struct.pack("<dddddddd", min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(head + body)


def edge_lines(edges: DataFrame) -> DataFrame:
    """(ord, line): the text form of a graph: the number of nodes, then 'u v w' by u, v. Sort by ord, line order within is by u, v."""
    n = edges.select(F.explode(F.array("u", "v")).alias("n")).agg(F.countDistinct("n").cast("string").alias("line")).select(F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("v"), "line")
    e = edges.select(F.lit(1).alias("ord"), "u", "v", F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string"), F.col("w").cast("string")).alias("line"))
    return n.unionByName(e)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Text files that make the edge list when read in order of their names."""
    edge_lines(edges).repartitionByRange("ord", "u", "v").sortWithinPartitions("ord", "u", "v").select("line").write.text(path)


def write_trace(trace: DataFrame, path: str) -> None:
    trace.orderBy("iter").select(F.concat_ws(",", F.col("iter").cast("string"), F.col("di").cast("string"))).write.text(path)


def segments(edges: DataFrame, points: DataFrame, weighted: bool = True) -> DataFrame:
    """(u, v, x1, y1, x2, y2, weight): edges as lines between the first two dimensions of their ends; weight is 1 unless weighted. Edges to unknown points go."""
    p = points.select("id", F.get("x", 0).alias("px"), F.get("x", 1).alias("py"))
    e = edges.join(p.withColumnsRenamed({"id": "u", "px": "x1", "py": "y1"}), "u").join(p.withColumnsRenamed({"id": "v", "px": "x2", "py": "y2"}), "v")
    return e.select("u", "v", "x1", "y1", "x2", "y2", (F.col("w") if weighted else F.lit(1.0)).alias("weight"))


def write_geojson(points: DataFrame, path: str) -> None:
    """One GeoJSON feature a line, for points (id, x)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.slice("x", 1, 2).alias("coordinates"))
    points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("id").alias("properties")))).write.text(path)


def gexf_lines(edges: DataFrame) -> DataFrame:
    """(ord, line): a GEXF document of a graph."""
    s = edges.sparkSession
    top = s.createDataFrame([(0, '<gexf version="1.2"><graph defaultedgetype="undirected"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")], "ord int, line string")
    n = edges.select(F.explode(F.array("u", "v")).alias("n")).distinct().select(F.lit(1).alias("ord"), F.format_string('<node id="%d"/>', "n").alias("line"))
    e = edges.select(F.lit(3).alias("ord"), F.concat(F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('" weight="'), F.col("w").cast("string"), F.lit('"/>')).alias("line"))
    return top.unionByName(n).unionByName(e)
