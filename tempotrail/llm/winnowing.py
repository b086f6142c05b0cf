"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are hashed in k-grams of 5; of every 6 consecutive k-grams, those with the least hash are fingerprints.
A span of 10 = 5 + 6 - 1 words has the same least hash wherever it stands, so two texts that share 10 words
share a fingerprint inside them.  Document fingerprints carry the words up to 5 before and 5 behind; they
join the items' fingerprints, and each hit is extended word by word to the windows of 10 it lies in.  Items
of fewer words than a window are one window, found by the hash of as many words.

The documents' side isn't shuffled where the items' table is small enough to broadcast (its rows are counted
first); beyond that the same join is shuffled on the fingerprint.

Defined cases: a null or empty text has no words and no hits; an item without words is never found; equal
item_ids count once, each text of theirs is looked for; rows that repeat both id and text get equal results; a
null id is a value like any other, of documents and of items (it counts as an item, and the joined ids pass it
over); very long texts are read whole; other columns are ignored; an empty table gives an empty result, and
without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.llm.common import lower_ascii, stored, tidied

WINDOW, K = 10, 5
#: k-grams a fingerprint is chosen from.
SPAN = WINDOW - K + 1
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
NOT_WORD_YET = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MOST_LONGS = 8192
#: Rows of the items' table up to which it is broadcast (under 300 bytes each).
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def keys(text: Column) -> tuple[Column, Column]:
    """Two hashes that stand for a text beside its id."""
    return F.xxhash64(text, F.lit(1)), F.xxhash64(F.lit(2), text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once; named columns may be computed again at each use in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(tokens: Column, k: int) -> Column:
    """The hash of every k consecutive words; tokens is a bound value."""
    starts = F.when(F.size(tokens) >= k, F.sequence(F.lit(0), F.size(tokens) - k))
    return F.coalesce(F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(k)))), F.array().cast("array<bigint>"))


def fingerprints(tokens: Column, k: int = K, span: int = SPAN, maybe: Callable[[Column], Column] | None = None) -> Column:
    """(at, hash, lead, near) of each fingerprint: its position from 0, its hash, how many words near has before it, and the words of all windows that it lies in.  maybe: leave out hashes for which it is false."""
    window = k + span - 1

    def chosen(hashes: Column) -> Column:
        last = F.size(hashes) - span
        is_least = lambda i: F.exists(F.sequence(F.greatest(F.lit(0), i - (span - 1)), F.least(i, last)), lambda j: F.array_min(F.slice(hashes, j + 1, span)) == F.get(hashes, i))
        wanted = is_least if maybe is None else lambda i: maybe(F.get(hashes, i)) & is_least(i)
        lead = lambda i: F.least(i, F.lit(span - 1))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), wanted), lambda i: F.struct(i.alias("at"), F.get(hashes, i).alias("hash"), lead(i).alias("lead"), F.slice(tokens, i - lead(i) + 1, lead(i) + window).alias("near")))

    return F.when(F.size(tokens) >= window, let(grams(tokens, k), chosen))


def bit_test(hashes: DataFrame, rows: int) -> Callable[[Column], Column]:
    """A test that every value of column hash passes, and few others: a bitmap of 32 bits a row, at most MOST_LONGS longs.

    It only saves work before the join; where it is full, everything passes.
    """
    longs = 1 << min(MOST_LONGS.bit_length() - 1, max(4, (rows // 2).bit_length()))
    place = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(longs - 1).cast("int")
    bit = lambda h: h.bitwiseAND(63).cast("int")
    words = hashes.groupBy(place(F.col("hash")).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits"))
    bits = dict(map(tuple, words.collect()))
    bitmap = F.expr("array(" + ",".join(f"{bits.get(i, 0)}L" if bits.get(i, 0) != -(1 << 63) else "bigint(-9223372036854775808)" for i in range(longs)) + ")")
    return lambda h: F.getbit(F.get(bitmap, place(h)), bit(h)) == 1


def _hits(left: DataFrame, items: DataFrame, rows: int) -> DataFrame:
    return left.join(F.broadcast(items) if rows <= BROADCAST_ROWS else items, "hash")


def _short_hits(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits of items of so many words, each a window of its own; found in one pass, by the hash of as many words."""
    whole = lambda n: F.get(let(F.col("words"), lambda w: grams(w, n)), F.lit(0))
    with_hash = F.coalesce(*(F.when(F.col("n") == n, whole(n)) for n in lengths))
    right = stored(items.select("item_id", with_hash.alias("hash"), F.col("words").alias("item_words")), "benchmark-short")
    rows = right.count()
    maybe = bit_test(right.select("hash"), rows)

    def places(w: Column, n: int) -> Column:
        found = lambda hashes: F.transform(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: maybe(F.get(hashes, i))), lambda i: F.struct(i.alias("at"), F.get(hashes, i).alias("hash"), F.slice(w, i + 1, n).alias("near")))
        return F.when(F.size(w) >= n, let(grams(w, n), found))

    every = lambda w: F.flatten(F.array_compact(F.array(*(places(w, n) for n in lengths))))
    left = docs.select("doc_id", "key1", "key2", F.explode(let(words(F.col("text")), every)).alias("g")).select("doc_id", "key1", "key2", "g.*")
    found = _hits(left, right, rows).filter(F.col("near") == F.col("item_words"))
    return found.select("doc_id", "key1", "key2", "item_id", F.sequence(F.col("at"), F.col("at") + F.size("near") - 1).alias("hit"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, key1, key2, n_words, hits (positions, null for none), item_ids (a null id too)."""
    span = window - k + 1
    docs = docs.select("doc_id", "text", *(key.alias(name) for key, name in zip(keys(F.col("text")), ("key1", "key2"), strict=True)))
    items = stored(items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0), "benchmark-words")
    right = items.select("item_id", F.explode(let(F.col("words"), lambda w: fingerprints(w, k, span))).alias("f"))
    right = stored(right.select("item_id", F.col("f.hash").alias("hash"), F.col("f.lead").alias("item_lead"), F.col("f.near").alias("item_near")), "benchmark-fingerprints")
    fine = right.count()
    maybe = bit_test(right.select("hash"), fine)
    left = docs.select("doc_id", "key1", "key2", F.explode(let(words(F.col("text")), lambda w: fingerprints(w, k, span, maybe))).alias("f")).select("doc_id", "key1", "key2", "f.*")
    found = _hits(left, right, fine)
    # windows around the hit, by how far before the k-gram they start
    same = lambda back: F.slice("near", F.col("lead") - back + 1, window) == F.slice("item_near", F.col("item_lead") - back + 1, window)
    inside = lambda back: (back <= F.least("lead", "item_lead")) & (F.col("lead") - back + window <= F.size("near")) & (F.col("item_lead") - back + window <= F.size("item_near"))
    backs = F.filter(F.array(*(F.lit(b) for b in range(span))), lambda b: F.when(inside(b), same(b)).otherwise(False))
    found = found.withColumn("backs", backs).filter(F.size("backs") > 0)
    parts = [found.select("doc_id", "key1", "key2", "item_id", F.flatten(F.transform("backs", lambda b: F.sequence(F.col("at") - b, F.col("at") - b + (window - 1)))).alias("hit"))]

    # items shorter than a window: one window of their length
    short = items.filter(F.size("words") < window).select("item_id", "words", F.size("words").alias("n"))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # fewer than window values
    if lengths:
        parts.append(_short_hits(docs, short, lengths))

    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    by_doc = every.groupBy("doc_id", "key1", "key2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hits"), F.collect_set(F.struct("item_id")).alias("items"))
    by_doc = stored(by_doc, "benchmark-hits").select(F.col("doc_id").alias("hit_id"), F.col("key1").alias("hit1"), F.col("key2").alias("hit2"), "hits", F.col("items.item_id").alias("item_ids"))
    slim = docs.select("doc_id", "key1", "key2", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), NOT_WORD_YET), "")).cast("long").alias("n_words"))
    same_row = (F.col("key1") == F.col("hit1")) & (F.col("key2") == F.col("hit2")) & F.col("doc_id").eqNullSafe(F.col("hit_id"))
    return slim.join(by_doc, same_row, "left").select("doc_id", "key1", "key2", "n_words", "hits", "item_ids")


@tidied
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document stand in a benchmark item, and in which items."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.transform(F.coalesce("item_ids", F.array().cast("array<long>")), lambda x: x.cast("string")))
    n_hit = F.coalesce(F.size("hits"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda x: array_to_string(list_slice(w, x, x + 9), ' '))) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, s.n, unnest(range(1, len(w) - s.n + 2)) AS p, unnest(list_transform(range(1, len(w) - s.n + 2), lambda x: array_to_string(list_slice(w, x, x + s.n - 1), ' '))) AS g FROM d, sizes s WHERE len(w) >= s.n),
h AS (SELECT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
