"""A corpus made ready for training: five stages, each a table of documents for the next.

Every stage takes and gives (but for the last, which adds shard and slot) the columns of documents; other columns,
whatever their names, are left behind.  An empty table gives an empty table.  Repeated rows are rows of their own.
Texts are read whole, however long.  What a stage does with nulls, empty texts and ties stands at the stage.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.llm import language, mixing, sharding, simhash, winnowing
from tempotrail.llm.common import delete, noted, small, stored, tidied

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction below this is no language; with four languages, chance is 0.25.
LEAST_LANGUAGE_SCORE = 0.4
#: Words of a shingle, and the least similarity of near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Rows to drop that are broadcast at most; beyond it, a shuffled join.
BROADCAST_ROWS = 1_000_000


#: Tables that a stage's result reads, by thread and folder: they can go when the next stage has that result as written.
_read = threading.local()


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage gets the rows of its predecessor as written, so what that one stored for itself can go."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, vars(_read).pop(sf_dir, []))
        with noted() as paths:
            out = tidied(function)(spark, docs, sf_dir)
        vars(_read)[sf_dir] = paths
        return out

    return run_stage


@stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are in no language: a null or empty text, one without letters, or a prediction
    below the least score.  A null lang isn't learned from; a null id counts as the empty string in the fold."""
    model = language.fit(docs, language.fold(F.col("doc_id")) != 0)
    found = language.identify(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null and empty texts are one group.  A null id comes after all others; of rows with the least id one stays.
    """
    found = simhash.similar_documents(docs, SHINGLE, SIMILARITY, keep=COLUMNS)
    return found.filter(F.col("row") == F.col("first_row")).select(*COLUMNS)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark: a window of 10 words, or a whole shorter item.

    Null and empty texts hold none and stay; rows with a null id, or the same id, are judged by their own text.
    """
    docs = docs.select(*COLUMNS)
    found = winnowing.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = stored(found.filter("hits is not null").select(F.col("doc_id").alias("hit_id"), "key1", "key2").distinct(), "pipeline-contaminated")
    hit = F.broadcast(hit) if small(hit, BROADCAST_ROWS) else hit
    keys = winnowing.keys(docs["text"])
    same = docs["doc_id"].eqNullSafe(F.col("hit_id")) & (keys[0] == F.col("key1")) & (keys[1] == F.col("key2"))
    return docs.join(hit, same, "left_anti").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; whole documents only.

    Documents without words (null and empty texts) are never taken; a null source is a source of its own; documents
    without label, and those with a null id, have the weight of unknown quality; ties of keys go by id.
    """
    rows = mixing.sized(docs, "text", "lang", "n_chars")
    labelled = mixing.labelled(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixing.mix(labelled, F.col("quality_weight"), cut=False, keep=("text", "lang", "n_chars"))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.withColumn("nth", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


@stage
def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; null and empty texts are one group, and a null id comes first in it."""
    placed = sharding.shard(docs, keep=("text", "lang", "source", "n_chars"))
    return placed.select(*COLUMNS, "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]
#: No SQL for a fitted language model and SimHash groups; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, stored(step(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            delete(spark, [x for x in {f.rpartition("/")[0] for f in before.inputFiles()} if "/pipeline-" in x])
    delete(spark, vars(_read).pop(sf_dir, []))
    return docs
