"""References to records that do not exist, yet, or any more.

ledger() keeps a state by target - its latest version, the number of its references, whether they wait - and takes it from period to period. Within a
period new references probe that state and the period's versions, in the order of time and in spans of a day: so neither a target with very many
references nor one with very many versions is ever swept by one task as a whole.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.plans.scratch import materialize, write_table

STATE = "struct<t:timestamp_ntz,dead:boolean,drop:timestamp_ntz>"


def _at(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def parents(df: DataFrame, src: str, key: Column, loaded_at: str, dead: Column | None = None, dropped_at: str | None = None) -> DataFrame:
    """(src, key, t, state): the versions of the targets. dead: whether this version deletes it; dropped_at: the time from which it counts as deleted."""
    state = F.struct(
        _at(loaded_at).alias("t"), F.coalesce(dead, F.lit(False)).alias("dead") if dead is not None else F.lit(False).alias("dead"),
        _at(dropped_at).alias("drop") if dropped_at else F.lit(None).cast("timestamp_ntz").alias("drop"),
    )
    d = df.select(F.lit(src).alias("src"), key.cast("bigint").alias("key"), _at(loaded_at).alias("t"), state.cast(STATE).alias("state"))
    return d.where("key IS NOT NULL AND t IS NOT NULL")


def _gone(state: str, t: str) -> Column:
    return F.expr(f"{state} IS NULL OR {state}.dead OR coalesce({state}.drop <= {t}, false)")


def probe(versions: DataFrame, times: DataFrame, period: str = "day") -> DataFrame:
    """times (src, key, t), each once, with `orphan`: whether the target has no version with t' <= t, or the latest such one is deleted.

    versions come from parents(). A version loaded at the very time of a reference counts for it. Of versions with equal times the
    deleting one wins. period bounds the events of a target that one task sweeps together.
    """
    per = F.date_trunc(period, F.col("t")).cast("timestamp_ntz")
    v, q = versions.select("src", "key", per.alias("per"), "t", "state"), times.select("src", "key", per.alias("per"), "t")
    none = F.lit(None).cast(STATE)
    # Snapshot of each target at the end of each period in which anything happens, then the state carried into the next one.
    ends = v.groupBy("src", "key", "per").agg(F.max("state").alias("state")).unionByName(q.select("src", "key", "per").distinct().withColumn("state", none))
    ends = ends.groupBy("src", "key", "per").agg(F.max("state").alias("state"), F.max(F.col("state").isNull()).alias("asked"))
    before = W.partitionBy("src", "key").orderBy("per").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("src", "key", "per", "asked", F.last("state", ignorenulls=True).over(before).alias("state")).where("asked AND state IS NOT NULL")
    events = (
        carried.select("src", "key", "per", F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(0).alias("kind"), "state")
        .unionByName(v.select("src", "key", "per", "t", F.lit(1).alias("kind"), "state"))
        .unionByName(q.select("src", "key", "per", "t", F.lit(2).alias("kind"), none.alias("state")))
    )
    sofar = W.partitionBy("src", "key", "per").orderBy(F.col("t").asc_nulls_first(), "kind", "state").rowsBetween(W.unboundedPreceding, 0)
    swept = events.select("src", "key", "t", "kind", F.last("state", ignorenulls=True).over(sofar).alias("state")).where("kind = 2")
    return swept.select("src", "key", "t", _gone("state", "t").alias("orphan"))


def orphans(versions: DataFrame, refs: DataFrame, period: str = "day") -> DataFrame:
    """(src, ym, owner_id, key, t): the references that are orphans when they are loaded, each once.

    refs (src, owner_id, key, t): rows without key or time are no references; copies count once. A null owner_id is kept.
    No references give no rows; without versions every reference is an orphan.
    """
    r = refs.select("src", "owner_id", "key", F.col("t").cast("timestamp_ntz").alias("t")).where("key IS NOT NULL AND t IS NOT NULL")
    flagged = probe(versions, r.select("src", "key", "t").distinct(), period).where("orphan")
    return r.join(flagged, ["src", "key", "t"]).select("src", F.date_format("t", "yyyy-MM").alias("ym"), "owner_id", "key", "t").distinct()


def pending_by_month(versions: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, ym, new_orphans, open_at_end): per table and month the references that arrive as orphans and those that wait at its end; in one pass over all months, where ledger() goes month by month.

    A waiting reference is resolved when its target arrives and reopened when the target is deleted; copies of a reference count once.
    Months in which nothing changes have no row.
    """
    r = refs.select("src", "owner_id", "key", F.col("t").cast("timestamp_ntz").alias("t")).where("key IS NOT NULL AND t IS NOT NULL").distinct()
    month = F.date_trunc("month", F.col("t")).cast("timestamp_ntz")
    drops = versions.where("state.drop IS NOT NULL").select("src", "key", F.expr("greatest(state.drop, t)").alias("t"))
    # Per target and month: references so far, and the state at its end.
    n = r.select("src", "key", month.alias("m")).groupBy("src", "key", "m").agg(F.count("*").alias("n"))
    v = versions.select("src", "key", month.alias("m"), "state").groupBy("src", "key", "m").agg(F.max("state").alias("state"))
    d = drops.select("src", "key", month.alias("m")).distinct()
    all_ = (
        n.select("src", "key", "m", "n", F.lit(None).cast(STATE).alias("state"))
        .unionByName(v.select("src", "key", "m", F.lit(0).cast("bigint").alias("n"), "state"))
        .unionByName(d.select("src", "key", "m", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(STATE).alias("state")))
        .groupBy("src", "key", "m").agg(F.sum("n").alias("n"), F.max("state").alias("state"))
    )
    w = W.partitionBy("src", "key").orderBy("m")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    all_ = all_.select("src", "key", "m", F.sum("n").over(run).alias("n"), F.last("state", ignorenulls=True).over(run).alias("state"))
    all_ = all_.withColumn("end", F.expr("m + interval 1 month - interval 1 microsecond"))
    all_ = all_.withColumn("open", F.when(_gone("state", "end"), F.col("n")).otherwise(0))
    delta = all_.select("src", "m", (F.col("open") - F.coalesce(F.lag("open").over(w), F.lit(0))).alias("d")).groupBy("src", "m").agg(F.sum("d").alias("d"))
    new = orphans(versions, r).groupBy("src", "ym").agg(F.count("*").alias("new_orphans"))
    total = delta.select("src", F.date_format("m", "yyyy-MM").alias("ym"), F.sum("d").over(W.partitionBy("src").orderBy("m").rowsBetween(W.unboundedPreceding, 0)).alias("open_at_end"))
    return total.join(new, ["src", "ym"], "left").select("src", "ym", F.coalesce("new_orphans", F.lit(0)).alias("new_orphans"), "open_at_end")


#: Most periods of a timeline; more are taken for a mistake in the times and raise.
MOST_PERIODS = 10_000


def step(keyed: DataFrame, versions: DataFrame, refs: DataFrame, end: datetime) -> DataFrame:
    """The keyed state after one period: (src, key, state, n, open, was_open, n_new, before).

    keyed (src, key, state, n, open) has one row per target that was ever loaded or referred to: its latest version, how many references it has, and whether they wait.
    versions and refs (each reference once) are those of the period, which ends at `end`. Arriving targets resolve what waits for them, deletions and passed drop
    times reopen it. before is the version at the start and n_new the references of the period, for those targets that have any. No column holds a list, so
    a target with very many references is one row.
    """
    none = F.lit(None).cast(STATE)
    new = versions.select("src", "key", "state", F.lit(0).cast("bigint").alias("n_new")).unionByName(refs.select("src", "key", none.alias("state"), F.lit(1).cast("bigint").alias("n_new")))
    new = new.groupBy("src", "key").agg(F.max("state").alias("later"), F.sum("n_new").alias("n_new"))
    j = keyed.select("src", "key", F.col("state").alias("before"), "n", "open").join(new, ["src", "key"], "full")
    j = j.withColumn("state", F.coalesce("later", "before")).withColumn("n_new", F.coalesce("n_new", F.lit(0))).withColumn("n", F.coalesce("n", F.lit(0)) + F.col("n_new")).withColumn("end", F.lit(end).cast("timestamp_ntz"))
    return j.select("src", "key", "state", "n", _gone("state", "end").alias("open"), F.coalesce("open", F.lit(False)).alias("was_open"), "n_new", "before")


def ledger(versions: DataFrame, refs: DataFrame, period: str = "quarter", sweep: str = "day") -> tuple[DataFrame, DataFrame]:
    """References kept in keyed state over a timeline, period by period: (found, counts).

    found (src, ym, owner_id, key, t): the references that find no target when they are loaded, each once. They probe the index of targets, which is the state at the
    start of their period together with the versions loaded in it. counts (src, ends, new_orphans, resolved, reopened, open_at_end): for each period and table the
    references that arrive as orphans, those whose waiting ended or began again by the period's end, and those that wait then.

    versions come from parents(); refs (src, owner_id, key, t): rows without key or time are no references, copies count once, a null owner_id is kept. Without
    references nothing is found; without versions every reference is an orphan. The events are written once, by period; each period reads its own
    and the state before, and writes the state after it. Periods with no event of any table have no counts.
    """
    spark = refs.sparkSession
    r = refs.select("src", "owner_id", F.col("key").cast("bigint").alias("key"), F.col("t").cast("timestamp_ntz").alias("t")).where("key IS NOT NULL AND t IS NOT NULL").distinct()
    v = versions.select("src", "key", "t", "state")
    start = F.date_format(F.date_trunc(period, "t"), "yyyyMMdd").cast("int")
    events = v.select("src", F.lit(None).cast(r.schema["owner_id"].dataType).alias("owner_id"), "key", "t", "state", F.lit("version").alias("kind"), start.alias("per")).unionByName(
        r.select("src", "owner_id", "key", "t", F.lit(None).cast(STATE).alias("state"), F.lit("reference").alias("kind"), start.alias("per"))
    )
    path = write_table(events, "orphan-events", "per", "kind")
    events = spark.read.schema(events.schema).parquet(path)
    periods = [x["per"] for x in events.groupBy("per").count().orderBy("per").limit(MOST_PERIODS + 1).collect()]
    if len(periods) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods")
    keyed = spark.createDataFrame([], f"src string, key bigint, state {STATE}, n bigint, open boolean")
    if not periods:
        none = spark.createDataFrame([], "src string, ym string, owner_id bigint, key bigint, t timestamp_ntz")
        return none, spark.createDataFrame([], "src string, ends date, new_orphans bigint, resolved bigint, reopened bigint, open_at_end bigint")
    states = []
    for per in periods:
        e = events.where(F.col("per") == per)
        end = _end(per, period)
        after = step(keyed, e.where("kind = 'version'"), e.where("kind = 'reference'"), end - timedelta(microseconds=1)).withColumn("per", F.lit(per))
        states.append(write_table(after, "orphan-state"))
        keyed = spark.read.schema(after.schema).parquet(states[-1]).select("src", "key", "state", "n", "open")
    after = spark.read.schema(after.schema).parquet(*states)
    # All probes run together: each reference meets the state at the start of its period and the versions of that period for what is referred to in it.
    one = F.concat_ws("|", F.col("per").cast("string"), "src").alias("src")
    asked = after.where("n_new > 0").select("src", "key", "per", "before")
    index = asked.where("before IS NOT NULL").select(one, "key", F.col("before.t").alias("t"), F.col("before").alias("state"))
    seen = events.where("kind = 'version'").join(asked.drop("before"), ["src", "key", "per"], "left_semi").select(one, "key", "t", "state")
    found = orphans(index.unionByName(seen), events.where("kind = 'reference'").select(one, "owner_id", "key", "t"), sweep)
    found = materialize(found.select(F.substring("src", 10, 1 << 30).alias("src"), "ym", "owner_id", "key", "t", F.substring("src", 1, 8).cast("int").alias("per")), "orphans-found")
    n = after.groupBy("src", "per").agg(
        F.sum(F.when(F.col("was_open") & ~F.col("open"), F.col("n") - F.col("n_new")).otherwise(0)).alias("resolved"),
        F.sum(F.when(~F.col("was_open") & F.col("open"), F.col("n") - F.col("n_new")).otherwise(0)).alias("reopened"),
        F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("open_at_end"),
    )
    ends = spark.createDataFrame([(per, (_end(per, period) - timedelta(days=1)).date()) for per in periods], "per int, ends date")
    n = n.join(F.broadcast(ends), "per").join(found.groupBy("src", "per").agg(F.count("*").alias("new_orphans")), ["src", "per"], "left")
    return found.drop("per"), n.select("src", "ends", F.coalesce("new_orphans", F.lit(0)).alias("new_orphans"), "resolved", "reopened", "open_at_end")


def _end(per: int, period: str) -> datetime:
    """The start of the period after the one that starts on the day `per` (yyyymmdd)."""
    k = per // 10_000 * 12 + per // 100 % 100 - 1 + {"month": 1, "quarter": 3, "year": 12}[period]
    return datetime(k // 12, k % 12 + 1, 1)


def advance(state: DataFrame, pending: DataFrame, versions: DataFrame, refs: DataFrame, until: datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the incremental form: the next state, the next references and what this batch reported.

    state (src, key, state) is the latest version of each target, pending (src, owner_id, key, t, open) are all references so far, those that wait
    being open (without that column all are); versions and refs are those of a batch that is later than every batch before. Closed references are kept, as
    they open again when their target is deleted or its drop time passes. The report has (src, what, owner_id, key) with what = 'orphan' for a new
    reference that finds no target, 'resolved' for an open one whose target is there at the end of the batch, 'reopened' for a closed one whose target is
    gone there, and 'waiting' for all that are open then. The batch ends with its last event, or at `until` if that is later.
    Each frame may be empty. Feed it from foreachBatch, writing the first two frames as tables.
    """
    old = state.select("src", "key", F.col("state.t").alias("t"), "state")
    seen = old.unionByName(versions.select("src", "key", "t", "state"))
    refs = refs.select("src", "owner_id", "key", F.col("t").cast("timestamp_ntz").alias("t")).where("key IS NOT NULL AND t IS NOT NULL").distinct()
    new = orphans(seen, refs).select("src", F.lit("orphan").alias("what"), "owner_id", "key")
    after = seen.groupBy("src", "key").agg(F.max("state").alias("state"))
    now = refs.agg(F.max("t").alias("a")).crossJoin(versions.agg(F.max("t").alias("b"))).select(F.greatest("a", "b", F.lit(until).cast("timestamp_ntz")).alias("now"))
    was = F.col("open") if "open" in pending.columns else F.lit(True)
    every = pending.select("src", "owner_id", "key", "t", was.alias("was")).unionByName(refs.withColumn("was", F.lit(None).cast("boolean")))
    gone = F.when(F.col("now").isNull(), F.col("was")).otherwise(_gone("state", "now"))
    judged = every.join(after, ["src", "key"], "left").join(F.broadcast(now)).select("src", "owner_id", "key", "t", "was", gone.alias("open"))
    change = F.array_compact(F.array(F.expr("CASE WHEN was AND NOT open THEN 'resolved' WHEN NOT was AND open THEN 'reopened' END"), F.expr("CASE WHEN open THEN 'waiting' END")))
    changed = judged.select("src", F.explode(change).alias("what"), "owner_id", "key")
    return after, judged.drop("was"), new.unionByName(changed)
