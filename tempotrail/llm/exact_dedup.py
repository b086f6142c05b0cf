"""Exact deduplication as a stateful stream.

The stream keys its state by content digest, in RocksDB, without expiry.  A state entry holds the digest,
the stable identifier of the row that stays (the largest id so far), how many rows had the digest, and the
locator of that row's content (file and row index).  The aggregation combines on the map side first, so a
text that makes up a third of the input sends one row a task.

A digest seen again is a hit; hits are compared byte for byte (grouping by the text itself) in a pass behind the
stream: a state that held full contents to compare on arrival would be as large as the input, and one that
fetched them by locator would read at random once a hit.  If one digest turns out to have several contents,
those rows are grouped by their content instead.

Defined cases: a null text counts as empty; an id of null is less than any other; of rows with the same id
and text, the one that is later in (file, row index) stays, one row only; very long texts are hashed whole;
columns beside id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.llm.common import delete, release, shared_folder, small, stored, tidied

#: Digests of repeated texts that are broadcast at most (32 bytes each); beyond it, a shuffled join.
BROADCAST_DIGESTS = 400_000
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside for their logs
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    locator = F.struct(F.col(id_col).cast("long").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(digest(text).alias("digest"), locator.alias("locator"), text.alias("content"))


def update_state(spark: SparkSession, folder: str, table: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 10_000) -> None:
    """Run the stream over all files of folder/table that the checkpoint's state hasn't seen yet, then stop."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        schema = spark.read.parquet(f"{folder}/{table}").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{{{table}}}")
        state = _rows(stream, digest, id_col, text_col).groupBy("digest").agg(F.count("*").alias("n"), F.max("locator").alias("locator"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state: digest, n, locator (id, file, row)."""
    return spark.read.format("statestore").load(checkpoint).select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("locator"))


def exact_dedup(spark: SparkSession, folder: str, table: str = "documents.parquet", digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, files_per_batch: int = 10_000) -> DataFrame:
    """Per row of folder/table: id, keep_id, group_size, kept, digest, content_sha256.

    Give the checkpoint of an earlier run to go on from its state.
    """
    own, checkpoint = not checkpoint, checkpoint or shared_folder(spark, "dedup-state")
    if not spark.read.parquet(f"{folder}/{table}").isEmpty():
        update_state(spark, folder, table, checkpoint, digest, id_col, text_col, files_per_batch)
        release(spark)
        state = stored(read_state(spark, checkpoint), "dedup-groups")
        if own:
            delete(spark, [checkpoint])
    else:
        rows = _rows(spark.read.parquet(f"{folder}/{table}"), digest, id_col, text_col)
        state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("locator").alias("locator"))
    rows = _rows(spark.read.parquet(f"{folder}/{table}"), digest, id_col, text_col)
    groups = state.select("digest", "n", F.col("locator").alias("keep"))
    mixed = _mixed_digests(rows, state)
    slim = rows.select("digest", "locator", sha256(F.col("content")).alias("sha"))
    if mixed is None:
        out = slim.join(groups, "digest", "left")
    else:  # one digest, several contents: these rows by their content
        by_content = rows.join(mixed, "digest", "left_semi")
        kept = by_content.groupBy("digest", "content").agg(F.count("*").alias("n"), F.max("locator").alias("keep"))
        apart = by_content.join(kept, ["digest", "content"]).select("digest", "locator", sha256(F.col("content")).alias("sha"), "n", "keep")
        out = slim.join(mixed, "digest", "left_anti").join(groups, "digest", "left").unionByName(apart)
    return out.select(
        F.col("locator.id").alias("id"),
        F.col("keep.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("locator") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
        F.lower(F.hex("sha")).alias("content_sha256"),
    )


def _mixed_digests(rows: DataFrame, state: DataFrame) -> DataFrame | None:
    """The digests of the hits that stand for more than one content, if any."""
    repeated = state.filter("n > 1").select("digest")
    if small(repeated, BROADCAST_DIGESTS):
        repeated = F.broadcast(repeated)
    contents = rows.select("digest", "content").join(repeated, "digest", "left_semi").groupBy("digest", "content").agg(F.lit(1).alias("one"))
    mixed = stored(contents.groupBy("digest").agg(F.count("*").alias("contents")).filter("contents > 1").select("digest"), "dedup-mixed")
    return None if mixed.isEmpty() else mixed


@tidied
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one it is a copy of."""
    out = exact_dedup(spark, sf_dir)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("content_sha256").alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
