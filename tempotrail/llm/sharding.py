"""Sharding into contiguous ranges of groups with the least possible largest shard, with DataFrame functions only.

Groups of equal texts are atomic and ordered by the SHA-256 of their text.  Shards are contiguous runs of
groups; the capacity is the smallest for which taking groups greedily needs no more shards than there are,
found by binary search; the cuts are where the greedy walk ends its shards.

Running totals don't pass through one task: hashes fall evenly into bins, bins are totalled, the totals of the
bins before are added to a running total inside each bin.  The binary search looks only at a bounded summary:
running totals in 16384 steps, each with its least and greatest total.  It leaves a narrow range of
capacities and so of places for each cut; these ranges are summed up finer, until the totals in them are few
enough to look at one by one.

Slots number a shard's rows from 0 in the order of text hash and id.  A group of many rows is numbered in
parts of about 512 rows, dealt by row whatever the ids; there the order is by id within each part.  So a text
that makes up a third of all rows is no task's own.

Defined cases: a null text counts as empty, and groups with empty texts; a null id comes first in a group (or
part); repeated rows are rows of their own, in any order among themselves; a text larger than the mean shard is
placed whole; with fewer groups than shards some shards are empty; an empty table gives an empty result; other
columns are kept where asked for, and ignored else.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempotrail.llm.common import small, stored, tidied

SHARDS = 16
STEPS = 16_384
#: Running totals that are looked at one by one.
FINE = 200_000
#: Rows of a part of a large group, and parts that are totalled together.
PART_ROWS, JOINT_PARTS = 512, 4096
#: Rows whose slots are broadcast at most; beyond it the wide rows are shuffled once.
BROADCAST_ROWS = 500_000


def _in_bin(*order: str) -> F.Column:
    return Window.partitionBy("bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_totals(groups: DataFrame) -> DataFrame:
    """groups (hash: binary, size, rows) with upto and rows_upto, the totals of the groups up to each by hash."""
    binned = groups.withColumn("bin", F.conv(F.substring(F.hex("hash"), 1, 3), 16, 10).cast("int"))
    bins = binned.groupBy("bin").agg(F.sum("size").alias("s"), F.sum("rows").alias("r"))  # 4096 rows at most
    before = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    binned = binned.withColumn("upto", F.sum("size").over(_in_bin("hash"))).withColumn("rows_upto", F.sum("rows").over(_in_bin("hash")))
    return binned.join(F.broadcast(bins), "bin").select("hash", "size", "rows", (F.col("upto") + F.col("s0")).alias("upto"), (F.col("rows_upto") + F.col("r0")).alias("rows_upto"))


class Summary:
    """Running totals as ranges: each has its least and greatest total, and perhaps unknown ones between."""

    def __init__(self, ranges: Iterable[tuple[int, int]]):
        self.low, self.high = [0], [0]
        for a, b in sorted(ranges, key=lambda r: (r[0], r[1])):
            self.low.append(a)
            self.high.append(max(b, self.high[-1]) if a < self.high[-1] else b)

    def floor(self, x: int, most: bool) -> int:
        """The greatest total up to x; of what it may be, the most or the least."""
        i = bisect_right(self.low, x) - 1
        if self.high[i] <= x:
            return self.high[i]
        return x if most else self.low[i]

    def shards(self, capacity: int, count: int, most: bool) -> list[int]:
        """Where the greedy walk ends each shard."""
        at, ends = 0, []
        for _ in range(count):
            at = max(at, self.floor(at + capacity, most))
            ends.append(at)
        return ends

    def least(self, low: int, high: int, count: int, most: bool) -> int:
        """The smallest capacity from low to high with which count shards hold everything."""
        total = self.high[-1]
        while low < high:
            mid = (low + high) // 2
            if self.shards(mid, count, most)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low


Span = tuple[int, int]


def search(total: int, largest: int, shards: int, summed: Callable[[list[Span], int], list[tuple[int, int, int]]], fetched: Callable[[list[Span]], list[int]], steps: int, fine: int) -> tuple[int, list[int]]:
    """The least capacity and each shard's end, from summed(spans, width), which gives the least and greatest
    running total and their number in each step of this width inside the spans, and fetched(spans), which
    gives all running totals in the spans."""
    low, high = max(largest, -(-total // shards)), total // shards + largest + 1
    spans, known, steps = [(0, total)], set(), max(steps, 4 * shards)
    while True:
        found = summed(spans, sum(b - a for a, b in spans) // steps + 1)
        known |= {(x, x) for a, b, _ in found for x in (a, b)}
        unknown = {(a, b): n for a, b, n in found if n > 2}
        summary = Summary(known | set(unknown))
        low, high = summary.least(low, high, shards, most=True), summary.least(low, high, shards, most=False)
        # the answer's ends lie between the least of the lowest capacity and the most of the highest
        reach = list(zip(summary.shards(low, shards, most=False), summary.shards(high, shards, most=True), strict=True))
        spans = [r for r in unknown if any(r[0] <= y and r[1] >= x for x, y in reach)]
        if sum(unknown[r] for r in spans) <= fine:
            known |= {(x, x) for x in (fetched(spans) if spans else ())}
            summary = Summary(known)
            low = summary.least(low, high, shards, most=False)
            return low, summary.shards(low, shards, most=False)


def minimax_cuts(totals: DataFrame, shards: int = SHARDS, steps: int = STEPS, fine: int = FINE) -> tuple[int, list[int]]:
    """The least capacity, and the running total at which each shard ends."""
    whole = totals.agg(F.max("upto").alias("total"), F.max("size").alias("largest")).first()
    if whole["total"] is None:
        return 0, [0] * shards

    def within(spans: list[Span]) -> DataFrame:
        """The totals in the spans, which come merged to a few ranges."""
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a - merged[-1][1] <= (whole["total"] // STEPS):
                merged[-1][1] = b
            else:
                merged.append([a, b])
        test = F.lit(False)
        for a, b in merged:
            test = test | F.col("upto").between(a, b)
        return totals.filter(test)

    def summed(spans: list[Span], width: int) -> list[tuple[int, int, int]]:
        steps = within(spans).groupBy(F.floor(F.col("upto") / width)).agg(F.min("upto"), F.max("upto"), F.count("*"))
        return [tuple(r)[1:] for r in steps.collect()]  # about as many rows as steps

    def fetched(spans: list[Span]) -> list[int]:
        return [r[0] for r in within(spans).select("upto").collect()]

    return search(whole["total"], whole["largest"], shards, summed, fetched, steps, fine)


def shard(docs: DataFrame, shards: int = SHARDS, keep: Sequence[str] = (), steps: int = STEPS, fine: int = FINE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, shard, slot, and the columns of keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("hash"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"), *keep)
    hashed = stored(hashed, "shard-rows")
    rows = hashed.drop(*keep)
    groups = rows.groupBy("hash").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    totals = stored(running_totals(groups), "shard-totals")
    _, cuts = minimax_cuts(totals, shards, steps, fine)
    number = F.lit(0)
    for cut in cuts[:-1]:
        number = number + (F.col("upto") > cut).cast("int")
    placed = totals.select("hash", "rows", F.col("rows_upto"), number.alias("shard"))
    starts = placed.groupBy("shard").agg(F.min(F.col("rows_upto") - F.col("rows")).alias("first"))  # a row a shard
    placed = placed.join(F.broadcast(starts), "shard").select("hash", "rows", "shard", (F.col("rows_upto") - F.col("rows") - F.col("first")).alias("base"))
    parts = F.ceil(F.col("rows") / PART_ROWS)
    part = F.when(F.col("rows") > PART_ROWS, F.pmod(F.xxhash64("row"), parts)).otherwise(0).cast("int")
    dealt = stored(rows.join(stored(placed, "shard-groups"), "hash").withColumn("part", part), "shard-dealt")
    sizes = dealt.filter(F.col("rows") > PART_ROWS).groupBy("hash", "part").agg(F.count("*").alias("n")).withColumn("joint", F.floor(F.col("part") / JOINT_PARTS))
    upto_before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joints = sizes.groupBy("hash", "joint").agg(F.sum("n").alias("n")).select("hash", "joint", upto_before("hash", "joint").alias("skip_joint"))
    sizes = sizes.withColumn("skip", upto_before("hash", "joint", "part")).join(joints, ["hash", "joint"]).select("hash", "part", (F.col("skip") + F.col("skip_joint")).alias("skip"))
    nth = F.row_number().over(Window.partitionBy("hash", "part").orderBy("doc_id", "row"))
    single = dealt.filter("rows = 1").withColumn("slot", F.col("base"))
    several = dealt.filter("rows > 1").withColumn("nth", nth - 1).join(sizes, ["hash", "part"], "left")
    several = several.withColumn("slot", F.col("base") + F.coalesce("skip", F.lit(0)) + F.col("nth")).drop("nth", "skip")
    out = single.unionByName(several).withColumn("slot", F.col("slot").cast("long"))
    if not keep:
        return out.select("doc_id", "size", "text_crc32", "shard", "slot")
    slots = stored(out.select("row", "shard", "slot"), "shard-slots")
    slots = F.broadcast(slots) if small(slots, BROADCAST_ROWS) else slots
    return hashed.join(slots, "row").select("doc_id", "size", "text_crc32", "shard", "slot", *keep)


@tidied
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
