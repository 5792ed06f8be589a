"""Mixing sources to target weights along a time-varying curriculum.

Shares that caps on repetition allow are found by filling up: sources that can't reach their share give all they may, the rest share what is
left in proportion. Each source has a schedule of weights over training time from 0 to 1; its integral is the source's cumulative demand for tokens.
The tokens of a source stand in a shuffled order, once per repetition; inverting the demand gives each document the time at which it
is due, and the mixture is the documents sorted by it in ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Blocks of a source's shuffled order whose sums are carried on, as a power of two.
BLOCK_BITS = 12
#: Copies of a row that are told apart at once.
STRIDE = 10_000


def source_name(c: Column) -> Column:
    """A source's name without differences of case, outer blanks and the kind of joint."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


def targets(mix: DataFrame) -> DataFrame:
    """(source, share, cap): one row per source, shares summing to 1. Null or negative shares count as 0, a null cap as 1; copied rows count once."""
    m = mix.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeat", F.lit(1.0)), F.lit(0.0)).alias("cap"))
    m = m.where("source IS NOT NULL").groupBy("source").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
    return m.select("source", F.coalesce(F.try_divide("share", F.sum("share").over(W.partitionBy())), F.lit(0.0)).alias("share"), "cap")


def shares(sizes: DataFrame, mix: DataFrame, total: float | None = None) -> DataFrame:
    """(source, n_docs, tokens, target_share, cap, planned, repeats, planned_share) for every source with a target or documents.

    sizes (source, n_docs, tokens) holds one row per source, mix is targets(). total: tokens of the mixture; without it, as many as all
    sources with a target have. planned tokens are min(level * share, cap * tokens) with the level at which they sum to the total, or
    all that the caps allow. A source without documents or without a target plans 0.
    """
    s = mix.join(sizes, "source", "full").select("source", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("cap", F.lit(0.0)).alias("cap"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    s = s.withColumn("most", F.when(F.col("share") > 0, F.col("cap") * F.col("tokens")).otherwise(0.0))
    everyone = W.partitionBy()
    want = F.lit(float(total)) if total is not None else F.sum(F.when(F.col("share") > 0, F.col("tokens")).otherwise(0)).over(everyone)
    s = s.withColumn("want", F.least(want.cast("double"), F.sum("most").over(everyone)))
    # Sources by the level at which they are exhausted: before each, the exhausted ones give all they may.
    full = F.try_divide("most", "share")
    w = W.partitionBy().orderBy(F.coalesce(full, F.lit(-1.0)), "source")
    s = s.withColumn("full", full)
    s = s.withColumn("given", F.sum("most").over(w) - F.col("most")).withColumn("left", F.sum("share").over(everyone) - F.sum("share").over(w) + F.col("share"))
    s = s.withColumn("level", F.try_divide(F.col("want") - F.col("given"), F.col("left")))
    # The first source that isn't exhausted sets the level; computed for later ones it only falls.
    level = F.coalesce(F.max(F.when((F.col("share") > 0) & (F.col("level") <= F.col("full") * (1 + 1e-12)), F.col("level"))).over(everyone), F.max("full").over(everyone), F.lit(0.0))
    s = s.withColumn("planned", F.least(F.col("most"), level * F.col("share")))
    return s.select(
        "source", "n_docs", "tokens", F.col("share").alias("target_share"), "cap", "planned",
        F.coalesce(F.try_divide("planned", "tokens"), F.lit(0.0)).alias("repeats"), F.coalesce(F.try_divide("planned", F.sum("planned").over(everyone)), F.lit(0.0)).alias("planned_share"),
    )


def curriculum(plan: DataFrame, strength: float = 0.5) -> DataFrame:
    """plan with `slope`: the weight of a source at time t is planned_share * (1 + slope * (2 t - 1)).

    Sources that are used over and over come late, those used once or less come early: the slope grows with the repeats, from -strength to
    strength, less its mean, so that the weights sum to 1 at every time; all slopes shrink together where one would leave -1..1, so that no weight is negative. 0 is a constant mixture.
    """
    raw = strength * (2 * F.col("repeats") / (1 + F.col("repeats")) - 1)
    p = plan.withColumn("raw", F.when(F.col("planned") > 0, raw).otherwise(0.0))
    mean = F.sum(F.col("raw") * F.col("planned_share")).over(W.partitionBy())
    p = p.withColumn("raw", F.when(F.col("planned") > 0, F.col("raw") - mean).otherwise(0.0))
    return p.withColumn("slope", F.col("raw") / F.greatest(F.lit(1.0), F.max(F.abs("raw")).over(W.partitionBy()))).drop("raw")


def due(part: Column, slope: Column) -> Column:
    """The time at which a source has given this part of its tokens: t with t + slope * (t^2 - t) = part."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - slope) * (1 - slope) + 4 * slope * part))
    return F.when(F.abs(slope) < 1e-9, part).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * part / (1 - slope + root))))


def mix(documents: DataFrame, mix_target: DataFrame, total: float | None = None, strength: float = 0.5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    documents (doc_id, source, n_tokens). The mixture (doc_id, source, copy_no, n_tokens, due) has a row for each use of a document, sorted by the time at
    which it is due in 0..1; copy_no counts from 0. The report has, per source, what shares() gives with used_tokens, used_share and uses.
    No source exceeds its planned tokens: the document that would is left out, so each misses less than its longest document. Documents of
    null source, of sources without a target or without tokens are in no mixture, but in the report. No documents: an empty mixture.
    Repeated documents are documents of their own.
    """
    d = documents.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    sizes = d.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    plan = curriculum(shares(sizes.where("source IS NOT NULL"), targets(mix_target), total), strength)
    # Shuffled order: blocks of hashes; sums of blocks are carried on, so no source is ever sorted as a whole.
    # Copied rows stand next to each other in it, so they are one row with a count until the end.
    d = d.where("source IS NOT NULL AND n_tokens > 0").groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("c")).withColumn("size", F.col("c") * F.col("n_tokens"))
    d = d.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "n_tokens")).withColumn("block", F.shiftrightunsigned("h", 64 - BLOCK_BITS))
    sums = d.groupBy("source", "block").agg(F.sum("size").alias("s"))
    carried = sums.select("source", "block", (F.sum("s").over(W.partitionBy("source").orderBy("block")) - F.col("s")).alias("carried"))
    inner = W.partitionBy("source", "block").orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    placed = d.withColumn("start", F.sum("size").over(inner) - F.col("size")).join(carried, ["source", "block"])
    placed = placed.join(plan.select("source", F.col("tokens").alias("all"), "planned", "slope").where("planned > 0"), "source").withColumn("start", F.col("start") + F.col("carried"))
    # Copies one by one, in two steps, so that no array is longer than STRIDE.
    placed = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1, F.lit(STRIDE).cast("bigint"))))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("c"), F.col("from") + STRIDE) - 1)))
    placed = placed.withColumn("end", F.col("start") + (F.col("copy") + 1) * F.col("n_tokens"))
    # Uses whose last token is within the plan: one per repetition of the source.
    uses = F.floor((F.col("planned") * (1 + 1e-12) - F.col("end")) / F.col("all")) + 1
    used = placed.withColumn("uses", uses).where("uses > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("uses") - 1)))
    part = (F.col("copy_no") * F.col("all") + F.col("end") - F.col("n_tokens") / 2) / F.col("planned")
    used = used.select("doc_id", "source", "copy_no", "n_tokens", due(part, F.col("slope")).alias("due"))
    reached = used.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("uses"))
    nameless = sizes.where("source IS NULL").select("source", "n_docs", "tokens", *[F.lit(0.0).alias(c) for c in ("target_share", "cap", "planned", "repeats", "planned_share")])
    report = plan.drop("slope").unionByName(nameless).join(reached, "source", "left")
    report = report.select(*plan.drop("slope").columns, F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"))
    report = report.withColumn("used_share", F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(W.partitionBy())), F.lit(0.0)))
    return used, report


def in_order(used: DataFrame) -> DataFrame:
    """The mixture range-sorted by the time at which documents are due."""
    return used.repartitionByRange("due", "doc_id", "copy_no").sortWithinPartitions("due", "doc_id", "copy_no")
