"""Checks of imported data and digests of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: plausible finish times in seconds by family
BOUNDS = {"long": (14_400, 86_400), "short": (5_400, 54_000)}
SEQUENCE_TOLERANCE = 60


def digest(rows: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """SHA-256 of each group's rows, whatever their order: first of the rows of each of 4096 parts (by the hash's first
    digits), then of the parts in order."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    rows = rows.select(by, row.alias("_row")).withColumn("_part", F.left("_row", F.lit(3)))
    joined = lambda of: F.sha2(F.array_join(F.sort_array(F.collect_list(of)), ""), 256)
    parts = rows.groupBy(by, "_part").agg(joined("_row").alias("_digest"))
    return parts.groupBy(by).agg(joined(F.concat("_part", "_digest")).alias("digest"))


def bound(family: Column, upper: bool) -> Column:
    out = F.lit(None).cast("int")
    for name, limits in BOUNDS.items():
        out = F.when(family == name, limits[upper]).otherwise(out)
    return out


def rule_for(races: DataFrame) -> DataFrame:
    """races (race_key, family) with least and most seconds, by family and never by distance."""
    return races.withColumns({"least": bound(F.col("family"), False), "most": bound(F.col("family"), True)})


def issues(rows: DataFrame, key: Sequence[str], codes: dict[str, Column]) -> DataFrame:
    """A row for each condition that holds: the key and the code."""
    found = F.array_compact(F.array(*(F.when(condition, F.lit(code)) for code, condition in codes.items())))
    return rows.select(*key, F.explode(found).alias("code"))


def result_issues(results: DataFrame) -> DataFrame:
    """race_id, id, code of results (status, finish_seconds, family)."""
    t = F.col("finish_seconds")
    return issues(results, ["race_id", "id"], {
        "finished_without_time": (F.col("status") == "FINISHED") & t.isNull(),
        "too_fast": t < bound(F.col("family"), False),
        "too_slow": t > bound(F.col("family"), True),
    })


def sequence_issues(splits: DataFrame, finish: DataFrame) -> DataFrame:
    """result_id, sequence_no, code, severity of passages against the one before and the finish.

    A segment that differs from the elapsed times is an error behind the control right before, else a warning.
    """
    w = Window.partitionBy("result_id").orderBy("sequence_no")
    rows = splits.join(finish.select(F.col("id").alias("result_id"), "finish_seconds"), "result_id", "left")
    rows = rows.withColumns({"_before": F.lag("elapsed_seconds").over(w), "_no": F.lag("sequence_no").over(w)})
    gap = F.col("elapsed_seconds") - F.coalesce("_before", F.lit(0))
    close = F.col("sequence_no") == F.coalesce("_no", F.lit(0)) + 1
    differs = F.col("segment_seconds").isNotNull() & (F.col("segment_seconds") != gap)
    out = issues(rows, ["result_id", "sequence_no"], {
        "non_positive": F.col("elapsed_seconds") <= 0,
        "not_increasing": F.col("elapsed_seconds") <= F.col("_before"),
        "after_finish": F.col("elapsed_seconds") > F.col("finish_seconds"),
        "segment_mismatch": differs & close,
        "segment_gap": differs & ~close,
    })
    return out.withColumn("severity", F.when(F.col("code") == "segment_gap", "warning").otherwise("error"))


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def refuse(rows: DataFrame, what: str) -> None:
    """Raise if there is any row."""
    first = rows.head(3)
    if first:
        raise ValueError(f"{what}: {[r.asDict() for r in first]}")
