"""Writing results: upserts as joins, provenance, exports."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempotrail.sources.scratch import replace


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """old with the rows of new put in by key; what new leaves null stays as it was."""
    a = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in columns))
    b = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return a.join(b, list(keys), "full").select(*keys, *(F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in columns))


def upsert_actions(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """new with the action each row means: insert, noop or update."""
    a = old.select(*keys, F.struct(*columns).alias("_old"))
    rows = new.join(a, list(keys), "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    return rows.withColumn("action", F.when(F.col("_old").isNull(), "insert").when(same, "noop").otherwise("update")).drop("_old")


def upsert_catalogue(old: DataFrame, new: DataFrame, used: DataFrame) -> DataFrame:
    """Controls (race_id, checkpoint_key, name, sequence_no, distance_km): races with results keep their geometry.

    New controls that clash get the next free number of their race.
    """
    keys = ["race_id", "checkpoint_key"]
    a = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in ("name", "sequence_no", "distance_km")))
    rows = a.join(new, keys, "full").join(used.select("race_id", F.lit(True).alias("_used")).distinct(), "race_id", "left")
    keep = F.col("_used").isNotNull() & F.col("_old_name").isNotNull()
    picked = lambda c: F.when(keep, F.coalesce(f"_old_{c}", c)).otherwise(F.coalesce(c, f"_old_{c}"))
    rows = rows.select(*keys, F.coalesce("name", "_old_name").alias("name"), picked("sequence_no").alias("sequence_no"), picked("distance_km").alias("distance_km"), F.col("_old_name").isNull().alias("_fresh"))
    by_no = F.row_number().over(Window.partitionBy("race_id", "sequence_no").orderBy("_fresh", "checkpoint_key"))
    rows = rows.withColumns({"_nth": by_no, "_most": F.max("sequence_no").over(Window.partitionBy("race_id"))})
    extra = F.row_number().over(Window.partitionBy("race_id", F.col("_nth") > 1).orderBy("sequence_no", "checkpoint_key"))
    return rows.withColumn("sequence_no", F.when(F.col("_nth") > 1, F.col("_most") + extra).otherwise(F.col("sequence_no"))).drop("_fresh", "_nth", "_most")


def record(seen: DataFrame, pages: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Provenance rows of pages that weren't seen with this content."""
    rows = pages.withColumn("sha256", F.sha2(content, 256)).select(*keys, "sha256").distinct()
    return rows.join(seen.select(*keys, "sha256"), [*keys, "sha256"], "left_anti")


def replace_source(old: DataFrame, new: DataFrame, scope: Sequence[str]) -> DataFrame:
    """All old rows but those of the scopes (source, year) that new has, and new."""
    return old.join(new.select(*scope).distinct(), list(scope), "left_anti").unionByName(new)


def subset(results: DataFrame, splits: DataFrame, ids: Sequence[int], most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The payload of a few runners for another window."""
    chosen = list(dict.fromkeys(ids))
    if len(chosen) > most:
        raise ValueError(f"at most {most} runners")
    return results.filter(F.col("id").isin(chosen)), splits.filter(F.col("result_id").isin(chosen))


def atomic(df: DataFrame, target: str, write: Callable[[DataFrame, str], None] | None = None) -> None:
    """Write beside the target, then put the whole result in its place; a failed write leaves the target as it was."""
    made = f"{target.rstrip('/')}.new-{uuid.uuid4().hex}"
    (write or (lambda x, path: x.write.parquet(path)))(df, made)
    replace(df.sparkSession, made, target)


def export_json(tables: dict[str, DataFrame], folder: str, wrapper: str | None = None) -> DataFrame:
    """Each table as JSON without its nulls, and a manifest of their rows and bytes; each appears whole.

    wrapper: the name of a script's global; beside each table then stands a script that appends its rows there.
    """
    spark, counts = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))
        atomic(lines, f"{folder}/{name}", lambda x, path: x.write.text(path))
        written = spark.read.text(f"{folder}/{name}")
        if wrapper:
            script = F.concat(F.lit(f"(window.{wrapper}=window.{wrapper}||{{}}),(window.{wrapper}.{name}=window.{wrapper}.{name}||[]).push("), F.col("value"), F.lit(");"))
            atomic(written.select(script.alias("value")), f"{folder}/{name}.js", lambda x, path: x.write.text(path))
        counts.append((name, *written.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()))
    manifest = spark.createDataFrame(counts, "table string, rows long, bytes long")
    atomic(manifest.coalesce(1), f"{folder}/manifest", lambda x, path: x.write.json(path))
    return manifest


def enrich(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], others: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """old with the rows of new put in, and the counts of actions of this pass and of a second one, which must do nothing.

    others: tables that an enrichment must leave alone; an error if their content isn't the same afterwards.
    """
    before = {n: content(t) for n, t in (others or {}).items()}
    first = upsert_actions(old, new, keys, columns).groupBy("action").agg(F.count("*").alias("n"))
    merged = upsert(old, new, keys, columns)
    second = upsert_actions(merged, new, keys, columns).groupBy("action").agg(F.count("*").alias("n"))
    changed = [n for n, t in (others or {}).items() if content(t) != before[n]]
    if changed:
        raise RuntimeError(f"changed by the enrichment: {changed}")
    return merged, first, second


def content(table: DataFrame) -> tuple:
    """What a table holds, as a count and sums of two hashes; rows in any order."""
    columns = [F.col(c) for c in sorted(table.columns)]
    hashes = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(table.agg(F.count("*"), *hashes).first())


def route_document(points: DataFrame) -> DataFrame:
    """One JSON text a route: its points in order as arrays of lat, lon and km."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon", "km"))), lambda p: F.array(p["lat"], p["lon"], p["km"]))
    return points.groupBy("route_id").agg(F.to_json(F.struct(ordered.alias("points"))).alias("document"))


def track_xml(points: DataFrame, note: str) -> DataFrame:
    """One GPX text a route."""
    point = lambda p: F.concat(F.lit('<trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lon"].cast("string"), F.lit('">'), F.coalesce(F.concat(F.lit("<ele>"), p["elev"].cast("string"), F.lit("</ele>")), F.lit("")), F.lit("</trkpt>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon", "elev"))), point), "\n")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="tempotrail" xmlns="http://www.topografix.com/GPX/1/1"><trk><desc>' + json.dumps(note)[1:-1] + "</desc><trkseg>\n"
    return points.groupBy("route_id").agg(F.concat(F.lit(head), body, F.lit("\n</trkseg></trk></gpx>\n")).alias("gpx"))


def archives(texts: DataFrame, folder: str, inner: str) -> None:
    """texts (name, text) as zip archives of the folder, each with its text under the inner name."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = pafs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"], strict=True):
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(inner, text)
                with files.open_output_stream(f"{at}/{name}", compression=None) as out:
                    out.write(packed.getvalue())
            yield batch[["name"]]

    texts.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
