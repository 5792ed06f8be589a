"""The orphan ledger over a stream of files agrees with the batch form."""

from datetime import datetime

from orrery.streaming.orphan_stream import OrphanStream


def test_stream_of_orphans(spark, tmp_path):
    s = OrphanStream.SCHEMA
    t = lambda d: datetime(2023, 1, d)
    days = [
        [("reference", "a", 1, t(1), 100, None, None), ("version", "a", 2, t(1), None, False, None), ("reference", "a", 2, t(1), 101, None, None)],
        [("version", "a", 1, t(2), None, False, None), ("reference", "a", 1, t(2), 102, None, None)],
        [("version", "a", 2, t(3), None, True, None), ("reference", "a", 2, t(3), 103, None, None)],
    ]
    ledger = OrphanStream(spark)
    for k, rows in enumerate(days):
        spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ledger.run(spark.readStream.schema(s).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r["batch"], r["what"], r["owner_id"]) for r in spark.read.parquet(ledger.report).collect()}
    assert {x for x in got if x[1] == "orphan"} == {(0, "orphan", 100), (2, "orphan", 103)}
    assert (1, "resolved", 100) in got and (2, "waiting", 103) in got
    ledger(spark.createDataFrame(days[0], s), 1)  # a batch that comes again changes nothing
    assert {(r["batch"], r["what"], r["owner_id"]) for r in spark.read.parquet(ledger.report).collect()} == got


def test_a_deletion_reopens_resolved_references(spark):
    ledger = OrphanStream(spark)
    t = lambda d: datetime(2023, 1, d)
    first = [("version", "a", 2, t(1), None, False, None), ("reference", "a", 2, t(1), 101, None, None), ("reference", "a", 2, t(1), None, None, None)]
    for k, rows in enumerate([first, [("version", "a", 2, t(2), None, True, None)], [("version", "a", 2, t(3), None, False, None)]]):
        ledger(spark.createDataFrame(rows, OrphanStream.SCHEMA), k)
    got = {(r["batch"], r["what"], r["owner_id"]) for r in spark.read.parquet(ledger.report).collect()}
    assert got == {(k, w, o) for k, w in ((1, "reopened"), (1, "waiting"), (2, "resolved")) for o in (101, None)}


def test_a_restart_goes_on_where_the_stream_stopped(spark, tmp_path):
    s = OrphanStream.SCHEMA
    t = lambda d: datetime(2023, 1, d)
    days = [
        [("version", "a", 2, t(1), None, False, None), ("reference", "a", 2, t(1), 101, None, None), ("reference", "a", 1, t(1), 100, None, None)],
        [("version", "a", 1, t(2), None, False, None), ("reference", "a", 2, t(2), 102, None, None)],
        [("version", "a", 2, t(3), None, True, None), ("reference", "a", 2, t(3), 103, None, None)],
    ]
    for rows in days:
        spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # A new object each time: all it knows is in the folder.
        ledger = OrphanStream(spark, str(tmp_path / "ledger"))
        ledger.run(spark.readStream.schema(s).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r["batch"], r["what"], r["owner_id"]) for r in spark.read.parquet(ledger.report).collect()}
    assert got == {(0, "orphan", 100), (0, "waiting", 100), (1, "resolved", 100), (2, "orphan", 103), *((2, w, o) for w, o in (("reopened", 101), ("reopened", 102), ("waiting", 101), ("waiting", 102), ("waiting", 103)))}
    # What a batch left that failed before its mark is written over.
    import os

    os.remove(tmp_path / "ledger" / "commits" / "2")
    again = OrphanStream(spark, str(tmp_path / "ledger"))
    assert again.last == 1
    again(spark.createDataFrame(days[2], s), 2)
    assert {(r["batch"], r["what"], r["owner_id"]) for r in spark.read.parquet(ledger.report).collect()} == got
