"""Jobs over a store: a folder of Parquet tables races, checkpoints, results and splits.

A job reads the tables that it changes, makes them anew with what it brings, and puts each in place as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.functions.text import any_seconds
from tempotrail.operators.quality import orphans, result_issues
from tempotrail.sources import feeds, pages, readers, sinks

SCHEMAS = {
    "races": "race_id long, race_key string, family string, year int, distance_km double",
    "checkpoints": "race_id long, checkpoint_key string, name string, sequence_no int, distance_km double",
    "results": "race_id long, source string, source_id string, name string, bib string, sex string, age_class string, nationality string, club string, city string, status string, finish_seconds long, overall_place long, gender_place long, class_place long",
    "splits": "race_id long, source string, source_id string, checkpoint_key string, elapsed_seconds long, segment_seconds long",
}
KEYS = {"races": ["race_id"], "checkpoints": ["race_id", "checkpoint_key"], "results": ["race_id", "source", "source_id"], "splits": ["race_id", "source", "source_id", "checkpoint_key"]}


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, null where df has none."""
    kinds = dict(c.split() for c in SCHEMAS[table].split(", "))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def read(spark: SparkSession, store: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{store.rstrip('/')}/{table}")


def init(spark: SparkSession, store: str) -> None:
    """Empty tables."""
    for table, schema in SCHEMAS.items():
        sinks.atomic(spark.createDataFrame([], schema), f"{store.rstrip('/')}/{table}")


def put(spark: SparkSession, store: str, table: str, new: DataFrame) -> None:
    """Upsert rows; those of one key in new count once."""
    keys = KEYS[table]
    rest = [c for c in _columns(table) if c not in keys]
    single = _shaped(new, table).groupBy(*keys).agg(*(F.min(c).alias(c) for c in rest))
    sinks.atomic(_shaped(sinks.upsert(read(spark, store, table), single, keys, rest), table), f"{store.rstrip('/')}/{table}")


def load_catalogue(spark: SparkSession, store: str, path: str) -> None:
    """Races and their controls from a JSON file."""
    rows = readers.catalogue(spark, path)
    put(spark, store, "races", rows.select(*(c for c in _columns("races") if c in rows.columns)).distinct())
    inner = rows.select("race_id", "sequence_no", "checkpoint.*") if "sequence_no" not in rows.select("checkpoint.*").columns else rows.select("race_id", "checkpoint.*")
    put(spark, store, "checkpoints", inner)


def import_csv(spark: SparkSession, store: str, path: str, race_id: int, source: str = "csv", mapping: dict[str, str] | None = None, encoding: str = "UTF-8", delimiter: str | None = None) -> None:
    rows = readers.flexible_csv(spark, path, encoding, delimiter)
    controls = [r[0] for r in read(spark, store, "checkpoints").filter(F.col("race_id") == race_id).select("checkpoint_key").collect()]  # the controls of one race
    results, splits = readers.mapped(rows, readers.header_map(rows.columns, controls, mapping))
    known = F.col("finish") if "finish" in results.columns else F.lit(None).cast("string")
    of = {"race_id": F.lit(race_id), "source": F.lit(source)}
    results = results.withColumns(of).withColumn("finish_seconds", any_seconds(known))
    put(spark, store, "results", results.withColumn("status", F.col("status") if "status" in results.columns else F.when(F.col("finish_seconds").isNotNull(), "FINISHED")))
    put(spark, store, "splits", splits.withColumns(of))


def import_pages(spark: SparkSession, store: str, path: str, race_id: int, source: str = "pages") -> None:
    """Participant pages that were fetched before."""
    controls = [r[0] for r in read(spark, store, "checkpoints").filter(F.col("race_id") == race_id).orderBy("sequence_no").select("checkpoint_key").collect()]  # the controls of one race
    found = pages.participants(pages.cached(spark, path), controls, "page_id").withColumnRenamed("id", "source_id").withColumns({"race_id": F.lit(race_id), "source": F.lit(source)})
    put(spark, store, "results", found)
    put(spark, store, "splits", found.select("race_id", "source", "source_id", F.explode("splits").alias("s")).filter("not s.is_synthetic").select("race_id", "source", "source_id", "s.checkpoint_key", "s.elapsed_seconds", "s.segment_seconds"))


def import_feed(spark: SparkSession, store: str, path: str, source: str = "feed", years: tuple[int, int] | None = None) -> None:
    """JSON files of any shape; a result goes to the race of its year."""
    records = feeds.collections(feeds.payloads(spark, path)).select(F.posexplode("records").alias("index", "record"))
    races = read(spark, store, "races").groupBy("year").agg(F.min("race_id").alias("race_id"))
    found = feeds.results(records, years=years).join(races, "year").withColumnRenamed("external_id", "source_id").withColumn("source", F.lit(source))
    put(spark, store, "results", found)
    put(spark, store, "splits", found.select("race_id", "source", "source_id", F.explode("splits").alias("s")).select("race_id", "source", "source_id", "s.*"))


def export(spark: SparkSession, store: str, folder: str, wrapper: str | None = None) -> DataFrame:
    return sinks.export_json({t: read(spark, store, t) for t in SCHEMAS}, folder, wrapper)


def validate(spark: SparkSession, store: str) -> DataFrame:
    """code and n of what is wrong in the store."""
    results = read(spark, store, "results").join(read(spark, store, "races").select("race_id", "family"), "race_id", "left")
    keyed = results.withColumn("id", F.concat_ws("|", "race_id", "source", "source_id"))
    splits = read(spark, store, "splits").withColumn("result_id", F.concat_ws("|", "race_id", "source", "source_id"))
    lost = orphans(splits, "result_id", keyed, "id").select(F.lit("orphan").alias("code"))
    return result_issues(keyed).select("code").unionByName(lost).groupBy("code").agg(F.count("*").alias("n"))


def main(arguments: Sequence[str] | None = None) -> int:
    import argparse
    import json

    p = argparse.ArgumentParser(prog="tempotrail", description="Jobs over a store of race results, and queries.")
    jobs = p.add_subparsers(dest="job", required=True)
    job = lambda name, *names: [jobs.add_parser(name)] + list(names)
    for name, *places in (job("init", "store"), job("catalogue", "store", "path"), job("import-csv", "store", "path"), job("import-pages", "store", "path"), job("import-feed", "store", "path"), job("export", "store", "folder"), job("validate", "store"), job("query", "name", "folder")):
        for place in places:
            name.add_argument(place)
        if name.prog.endswith(("import-csv", "import-pages")):
            name.add_argument("--race", type=int, required=True)
        if name.prog.endswith("import-csv"):
            name.add_argument("--mapping", type=json.loads, help="JSON: column to field")
            name.add_argument("--encoding", default="UTF-8")
            name.add_argument("--delimiter")
        if name.prog.endswith("export"):
            name.add_argument("--wrapper", help="name of a script's global")
        if name.prog.endswith("query"):
            name.add_argument("--out", help="Parquet folder; without it the first rows are shown")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName(f"tempotrail {a.job}").getOrCreate()
    if a.job == "init":
        init(spark, a.store)
    elif a.job == "catalogue":
        load_catalogue(spark, a.store, a.path)
    elif a.job == "import-csv":
        import_csv(spark, a.store, a.path, a.race, mapping=a.mapping, encoding=a.encoding, delimiter=a.delimiter)
    elif a.job == "import-pages":
        import_pages(spark, a.store, a.path, a.race)
    elif a.job == "import-feed":
        import_feed(spark, a.store, a.path)
    elif a.job == "export":
        export(spark, a.store, a.folder, a.wrapper).show(truncate=False)
    elif a.job == "validate":
        found = validate(spark, a.store)
        found.show(truncate=False)
        return 0 if found.isEmpty() else 2
    else:
        from tempotrail.registry import QUERIES

        out = QUERIES[a.name](spark, a.folder)
        out.write.mode("overwrite").parquet(a.out) if a.out else out.show()
    return 0
