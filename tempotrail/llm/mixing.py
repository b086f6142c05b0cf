"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a budget of words.  The whole epochs of the budget take every document; the remainder is a
weighted sample without replacement: a document's key is -ln(u) / w, u a hash of the document in (0, 1) and w
its quality weight, and documents are taken in the order of their keys until the budget is used up.

The order is never made for a whole source at once: keys fall into 4096 bins a source, bins are summed with
map-side combination, and only the bin in which a budget ends is sorted.  A source with a third of all rows
therefore costs one sorted bin.

Defined cases: a null source is a source of its own, last in order; a null text has size 0 and takes nothing;
null or missing qualities count as unknown; repeated rows are documents of their own; ties of keys go by id;
an empty table gives an empty result; other columns are kept where the result has room for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempotrail.llm.common import small, stored, tidied

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_EPOCHS = 1.5, 2.0
BINS = 4096
#: Labelled documents whose weights are broadcast at most; beyond it a shuffled join.
BROADCAST_LABELS = 1_000_000
#: Weight by quality label: good, unknown, bad.
QUALITY = {1: 2.0, None: 1.0, 0: 0.5}
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> and target.

    Sources in code-point order, null last, have the weights in turn and share so much of all sizes by them;
    no target exceeds most times its source's size, and what is over is shared again.  That is a common level
    per weight: with sources in the order of cap / weight, the level after the first j have met their caps.
    The table has a row a source; the windows over all of it see no documents.
    """
    alone = Window.partitionBy(F.lit(0))
    order = alone.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = alone.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left", F.sum("source_size").over(alone) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("nth", F.row_number().over(by_level))
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("nth", "level"))).over(alone)["level"]
    return t.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def sampling_key(identity: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), identity), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.ln(u) / weight


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """The rows that mix takes: doc_id, source, size and identity (what the sampling key hashes)."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(identity).alias("identity"), *keep)


def mix(rows: DataFrame, weight: Column | None = None, budgets: DataFrame | None = None, cut: bool = True, seed: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """Per row of sized(): doc_id, source, size, source_size, target, taken.

    budgets: source, source_size and target; by default those of targets().  cut: the document in which a
    budget ends gives the words up to it; otherwise it is taken whole where that comes nearer to the budget.
    keep: further columns to pass on.
    """
    weight = F.lit(1.0) if weight is None else weight
    rows = rows.select("doc_id", "source", "size", sampling_key(F.col("identity"), weight, seed).alias("key"), *keep)
    # bins of equal width in exp(-key), which is u^(1/w)
    rows = stored(rows.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-F.col("key"))) * BINS)).cast("int")), "mix")
    bins = stored(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    if budgets is None:
        budgets = stored(targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))), "mix-targets")
    budgets = budgets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budgets = budgets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumnRenamed("source", "of")
    sums = bins.withColumn("before", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size"))
    last = sums.join(budgets, F.col("source").eqNullSafe(F.col("of"))).filter("before <= rest and before + bin_size > rest")
    last = last.groupBy(F.col("source").alias("ends")).agg(F.min(F.struct("bin", "before")).alias("end"))
    plan = budgets.join(last, F.col("of").eqNullSafe(F.col("ends")), "left")
    plan = stored(plan.select("of", "source_size", "target", "epochs", "rest", F.col("end.bin").alias("end_bin"), F.col("end.before").alias("end_before")), "mix-plan")
    planned = F.broadcast(plan) if small(plan, BROADCAST_SOURCES) else plan
    out = rows.join(planned, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    within = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ending = F.coalesce(F.col("bin") == F.col("end_bin"), F.lit(False))
    sorted_bin = out.filter(ending).withColumn("room", F.col("rest") - F.col("end_before") - F.sum("size").over(within) + F.col("size"))
    if cut:
        part = F.greatest(F.lit(0), F.least("size", "room"))
    else:
        part = F.when(F.col("size") <= 2 * F.col("room"), F.col("size")).otherwise(0)
    before_end = (F.col("rest") > 0) & (F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin")))
    whole = out.filter(~ending).withColumn("part", F.when(before_end, F.col("size")).otherwise(0))
    taken = whole.unionByName(sorted_bin.withColumn("part", part).drop("room"))
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *keep)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column quality_weight from labels (doc_id, quality)."""
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("doc_id is not null")
    best = best.select(F.col("doc_id").alias("_labelled"), F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(QUALITY[None]).alias("quality_weight"))
    best = stored(best, "mix-quality")
    best = F.broadcast(best) if small(best, BROADCAST_LABELS) else best
    return docs.join(best, docs["doc_id"] == best["_labelled"], "left").drop("_labelled").withColumn("quality_weight", F.coalesce("quality_weight", F.lit(QUALITY[None])))


@tidied
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    rows = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(labelled(rows, labels), F.col("quality_weight")).select("doc_id", "size", "source_size", "target", "taken")
