"""References kept over a stream of batches, with those that wait for their targets open."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.orphans import STATE, advance
from orrery.plans.scratch import drop_table, shared_dir


class OrphanStream:
    """State tables in a folder that foreachBatch advances. Events (kind STRING, src, key, t, owner_id, dead, drop): 'version' or 'reference'.

    folder: where the state lives, on storage that all executors share; a stream that starts again with the folder and the checkpoint of an earlier one goes on
    where that one stopped. Without it a new folder in spark.checkpoint.dir is used. Each batch writes tables of its own and commits them by a mark;
    what a failed batch left is written over, and a batch that was committed is passed over. The state before the last one is kept, older ones go.
    """

    SCHEMA = "kind string, src string, key bigint, t timestamp_ntz, owner_id bigint, dead boolean, drop timestamp_ntz"
    _STATE = f"src string, key bigint, state {STATE}"
    _PENDING = "src string, owner_id bigint, key bigint, t timestamp_ntz, open boolean"
    _REPORT = "src string, what string, owner_id bigint, key bigint"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/orphans-{uuid.uuid4().hex}").rstrip("/")
        self.report = f"{self.folder}/report"
        if not self._marks():
            self._write(spark.createDataFrame([], self._STATE), "state", -1)
            self._write(spark.createDataFrame([], self._PENDING), "pending", -1)
            self._write(spark.createDataFrame([], self._REPORT), "report", -1)
            self._mark(-1)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marks(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        p, fs = self._path(f"{self.folder}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _mark(self, number: int) -> None:
        p, fs = self._path(f"{self.folder}/commits/{number}")
        fs.create(p, True).close()

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    @property
    def last(self) -> int:
        """The number of the last committed batch, -1 before the first."""
        return self._marks()[-1]

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Advance by one batch. A batch that comes again after a failure is passed over, so each counts once."""
        marks = self._marks()
        if number <= marks[-1] or batch.isEmpty():
            return
        state = F.struct("t", F.coalesce("dead", F.lit(False)).alias("dead"), "drop").cast(STATE)
        versions = batch.where("kind = 'version'").select("src", "key", "t", state.alias("state"))
        refs = batch.where("kind = 'reference'").select("src", "owner_id", "key", "t")
        spark = batch.sparkSession
        old = (spark.read.schema(s).parquet(f"{self.folder}/{n}/batch={marks[-1]}") for n, s in (("state", self._STATE), ("pending", self._PENDING)))
        new_state, new_pending, report = advance(*old, versions, refs)
        self._write(new_state, "state", number)
        self._write(new_pending, "pending", number)
        self._write(report.select("src", "what", "owner_id", "key"), "report", number)
        self._mark(number)
        for k in marks[:-1]:
            for n in ("state", "pending"):
                drop_table(spark, f"{self.folder}/{n}/batch={k}")

    def run(self, stream: DataFrame, checkpoint: str):
        """The streaming query over a stream of events."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
