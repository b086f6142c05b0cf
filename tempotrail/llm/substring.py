"""Removal of repeated spans, found by fixed-block anchors.

The index: every text is cut into blocks of 10 words that don't overlap, and the hashes of the blocks go into
a Bloom filter, those seen twice into a second one.  The probe: every rolling window of 10 words.  A span of
20 words that stands elsewhere too holds a whole block of the other place, whatever the alignment, so it has a
rolling window off its own blocks that hits the index, or a block of its own that was seen twice.  Hits are
extended to all windows of 20 words around them.  The filters never miss, they only let some windows pass for
nothing; the rest is exact: windows of 20 words are brought together by their hash (128 bits, two halves of
independent word hashes), the earliest keeps its words, and every other is removed.  Runs of such windows are
the maximal exact repeats.

Windows travel as packed arrays in buckets by hash.  A task sends only its own earliest place of a window:
later ones in the task are removed whatever the others hold.  So a passage that a third of all texts share
sends one place a task.  Windows to remove go back to the texts by id and text, so that copies of one text
spread.  The filters have 16 bits a block up to MOST_BITS; fuller filters let more windows pass, which costs
volume and never results.

Defined cases: a null text has no words; a text shorter than a window loses nothing; a null id comes after all
others, and the largest long counts as the same id; rows with the same id are no earlier than each other at the
same start; equal rows get equal results; very long texts are read whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.llm.common import bounded_batches, partitions, release, stored, tidied

WINDOW = 20
SEGMENTS = 256
BITS_A_BLOCK, MOST_BITS, PROBES = 16, 1 << 30, 4
#: Bits of a filter up to which both come to the driver at once, without a stored table (16 MB).
COLLECT_BITS = 1 << 26
#: Windows in a bucket, and windows that a task brings together before it sends them.
BUCKET_WINDOWS, TASK_WINDOWS = 2_000_000, 1_000_000
#: Rows of removed spans that are broadcast at most, and their bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 24 << 20
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Stands for a null id, which comes last.
_LAST = np.iinfo(np.int64).max


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, self.seed)
        return out


def _word_hashes(words: list[bytes], memo: _Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """The hash of every run of size values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= base
        out += hashes[i : i + n]
    return _mixed(out)


class Filter:
    """Bloom filters of the blocks (first) and of blocks seen twice (second), in segments by the hash's top bits."""

    def __init__(self, bits: int):
        self.size = bits // SEGMENTS
        self.first, self.second = (np.zeros(bits // 8, np.uint8) for _ in range(2))

    @staticmethod
    def bits_for(blocks: int) -> int:
        return min(MOST_BITS, max(1 << 16, 1 << (blocks * BITS_A_BLOCK - 1).bit_length()))

    @staticmethod
    def places(h: np.ndarray, size: int) -> list[np.ndarray]:
        step = _mixed(h) | np.uint64(1)
        return [(h + step * np.uint64(i)) & np.uint64(size - 1) for i in range(PROBES)]

    @staticmethod
    def _test(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    @classmethod
    def add(cls, first: np.ndarray, second: np.ndarray, h: np.ndarray, size: int) -> None:
        """Put the hashes of one segment into its bits."""
        values, counts = np.unique(h, return_counts=True)
        places = cls.places(values, size)
        twice = (counts > 1) | np.logical_and.reduce([cls._test(first, p) for p in places])
        for p in places:
            np.bitwise_or.at(first, p >> np.uint64(3), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))
            p = p[twice]
            np.bitwise_or.at(second, p >> np.uint64(3), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))

    def hits(self, h: np.ndarray, second: bool) -> np.ndarray:
        bits, left = (self.second if second else self.first), np.arange(len(h))
        start, step, mask = (h >> np.uint64(56)) * np.uint64(self.size), _mixed(h) | np.uint64(1), np.uint64(self.size - 1)
        for i in range(PROBES):  # most fall out at the first
            left = left[self._test(bits, start[left] + ((h[left] + step[left] * np.uint64(i)) & mask))]
        found = np.zeros(len(h), bool)
        found[left] = True
        return found


def block_index(rows: DataFrame, window: int = WINDOW) -> tuple[Filter, int]:
    """The filters over all blocks of rows (id, check, text), and the number of words."""
    spark, block = rows.sparkSession, window // 2

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Hashes(1)
        for batch in batches:
            found, words = [], 0
            for text in batch["text"]:
                w = (text or "").encode().split()
                words += len(w)
                if len(w) >= block:
                    found.append(rolling(_word_hashes(w, memo), block, _BASES[0])[::block])
            h = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            edges = np.searchsorted(h >> np.uint64(56), np.arange(SEGMENTS + 1))
            full = [s for s in range(SEGMENTS) if edges[s] < edges[s + 1]]
            yield pd.DataFrame({"segment": [-1, *full], "n": [words, *(int(edges[s + 1] - edges[s]) for s in full)], "hashes": [b"", *(h[edges[s] : edges[s + 1]].tobytes() for s in full)]})

    bounded_batches(spark)
    cut = stored(rows.select("text").mapInPandas(blocks, "segment int, n long, hashes binary"), "anchor-blocks")
    sums = cut.groupBy((F.col("segment") < 0).alias("words")).agg(F.sum("n").alias("n")).collect()
    n = {r["words"]: r["n"] for r in sums}
    filters = Filter(Filter.bits_for(n.get(False) or 1))
    size = filters.size

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, group in batch.groupby("segment"):
                first, second = own.setdefault(int(segment), (np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)))
                Filter.add(first, second, np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]]), size)
        for segment, (first, second) in own.items():
            yield pd.DataFrame({"segment": [segment], "first": [first.tobytes()], "second": [second.tobytes()]})

    bounded_batches(spark)
    built = cut.filter("segment >= 0").repartition(min(SEGMENTS, max(16, partitions(spark))), "segment").mapInPandas(build, "segment int, first binary, second binary")
    if size * SEGMENTS <= COLLECT_BITS:
        rows_of_bits = built.collect()  # COLLECT_BITS / 4 bytes at most
    else:
        rows_of_bits = stored(built, "anchor-filters").toLocalIterator()  # MOST_BITS / 4 bytes at most, a part at a time
    for r in rows_of_bits:
        at = slice(r["segment"] * size // 8, (r["segment"] + 1) * size // 8)
        filters.first[at], filters.second[at] = np.frombuffer(r["first"], np.uint8), np.frombuffer(r["second"], np.uint8)
    return filters, n.get(True) or 0


def candidates(hashes: np.ndarray, filters: Filter, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows that may stand elsewhere too: those around a hit."""
    block, n = window // 2, len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    probes = rolling(hashes, block, _BASES[0])
    hit = filters.hits(probes, second=False)
    own = np.arange(0, len(probes), block)
    hit[own] = filters.hits(probes[own], second=True)
    upto = np.concatenate(([0], np.cumsum(hit)))
    return np.flatnonzero(upto[block + 1 :][:n] > upto[:-1][:n])


def _spans(starts: np.ndarray, window: int) -> bytes:
    """First and last word, exclusive, of each run of windows with these starts, which are in order."""
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + window]).astype(np.int32).T.tobytes()


def _spread(ids: np.ndarray, checks: np.ndarray) -> np.ndarray:
    return _mixed(checks.view(np.uint64) ^ _mixed(ids.view(np.uint64) * _BASES[0]))


def by_destination(removed: list[tuple[np.ndarray, np.ndarray, np.ndarray]], destinations: int) -> pd.DataFrame:
    """Windows to remove, packed by text, a row for each destination of ids and texts."""
    ids, checks, start = (np.concatenate(x) for x in zip(*removed, strict=True))
    to = (_spread(ids, checks) % np.uint64(destinations)).astype(np.int32)
    order = np.lexsort((start, ids, checks, to))
    ids, checks, start, to = ids[order], checks[order], start[order], to[order]
    texts = np.flatnonzero(np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(checks) != 0))))[: len(ids)]
    times = np.diff(np.append(texts, len(ids))).astype(np.int32)
    edges = np.flatnonzero(np.concatenate(([True], np.diff(to) != 0)))[: len(ids)]
    rows = []
    for x, y in zip(edges, np.append(edges[1:], len(ids)), strict=True):
        g = slice(*np.searchsorted(texts, [x, y]))
        rows.append((int(to[x]), ids[texts[g]].tobytes(), checks[texts[g]].tobytes(), times[g].tobytes(), start[x:y].tobytes()))
    return pd.DataFrame(rows, columns=["destination", "id", "check", "n", "start"])


def packed_rows(parts: list[tuple], held: dict[tuple[int, int], None], buckets: int) -> Iterator[pd.DataFrame]:
    """The windows of parts (which is emptied): those to remove by text, the others by bucket."""
    a, b, row, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    of_row = np.array(list(held), np.int64).reshape(-1, 2)
    order, earliest = _ranked(a, b, of_row[row, 0], start)
    yield _by_text(row[order][~earliest], start[order][~earliest], of_row, buckets)
    sent = order[earliest]
    bucket = (a[sent] % np.uint64(buckets)).astype(np.int32)
    sent = sent[np.lexsort((start[sent], row[sent], bucket))]
    a, b, row, start = a[sent], b[sent], row[sent], start[sent]
    bucket = (a % np.uint64(buckets)).astype(np.int32)
    of = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(bucket) != 0))))
    counts = np.diff(np.append(of, len(row))).astype(np.int32)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for x, y in zip(edges, edges[1:], strict=False):
        g0, g1 = np.searchsorted(of, [x, y])
        texts = of_row[row[of[g0:g1]]]
        yield pd.DataFrame({"bucket": [int(bucket[x])], "a": [a[x:y].tobytes()], "b": [b[x:y].tobytes()], "start": [start[x:y].tobytes()], "id": [texts[:, 0].tobytes()], "check": [texts[:, 1].tobytes()], "n": [counts[g0:g1].tobytes()]})


def repeats(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of rows (id: _LAST for null, check, text) that has repeats: id, check and the spans of words to remove; stored."""
    spark = rows.sparkSession
    filters, words = block_index(rows, window)
    buckets = max(partitions(spark), -(-words // BUCKET_WINDOWS))
    shared = spark.sparkContext.broadcast(filters)  # MOST_BITS / 4 bytes at most

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, other, held, parts, n = _Hashes(1), _Hashes(2), {}, [], 0
        for batch in batches:
            for i, check, text in zip(batch["id"], batch["check"], batch["text"], strict=True):
                if (i, check) in held:  # an equal row, which gets the same result
                    continue
                words = (text or "").encode().split()
                hashes = _word_hashes(words, memo) if len(words) >= window else ()
                starts = candidates(hashes, shared.value, window) if len(hashes) else ()
                if len(starts):
                    lo = int(starts[0])
                    hi = int(starts[-1]) + window
                    second = _word_hashes(words[lo:hi], other)
                    parts.append((rolling(hashes[lo:hi], window, _BASES[0])[starts - lo], rolling(second, window, _BASES[1])[starts - lo], np.full(len(starts), len(held), np.int32), starts.astype(np.int32)))
                    held[i, check] = None
                    n += len(starts)
                if n >= TASK_WINDOWS:
                    yield from packed_rows(parts, held, buckets)
                    held, parts, n = {}, [], 0
        if parts:
            yield from packed_rows(parts, held, buckets)

    schema = "bucket int, a binary, b binary, start binary, id binary, check binary, n binary"
    bounded_batches(spark)
    packed = rows.select("id", "check", "text").mapInPandas(probe, schema)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}
        removed, n = [], 0  # ids, checks and starts of windows to remove
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.a is None:  # removed already
                    start = np.frombuffer(r.start, np.int32)
                    removed.append((np.full(len(start), np.frombuffer(r.id, np.int64)[0]), np.full(len(start), np.frombuffer(r.check, np.int64)[0]), start))
                    n += len(start)
                    if n >= TASK_WINDOWS:
                        yield by_destination(removed, destinations)
                        removed, n = [], 0
                else:
                    waiting.setdefault(r.bucket, []).append(r)
        for bucket in list(waiting):
            got = waiting.pop(bucket)
            a, b = (np.concatenate([np.frombuffer(getattr(r, c), np.uint64) for r in got]) for c in "ab")
            start = np.concatenate([np.frombuffer(r.start, np.int32) for r in got])
            times = np.concatenate([np.frombuffer(r.n, np.int32) for r in got])
            ids, checks = (np.repeat(np.concatenate([np.frombuffer(getattr(r, c), np.int64) for r in got]), times) for c in ("id", "check"))
            del got, times
            order, earliest = _ranked(a, b, ids, start)
            at = order[~earliest]
            removed.append((ids[at], checks[at], start[at]))
            n += len(at)
            if n >= TASK_WINDOWS:
                yield by_destination(removed, destinations)
                removed, n = [], 0
        if removed:
            yield by_destination(removed, destinations)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [r for batch in batches for r in batch.itertuples(index=False)]
        if not got:
            return
        times = np.concatenate([np.frombuffer(r.n, np.int32) for r in got])
        ids, checks = (np.repeat(np.concatenate([np.frombuffer(getattr(r, c), np.int64) for r in got]), times) for c in ("id", "check"))
        start = np.concatenate([np.frombuffer(r.start, np.int32) for r in got])
        order = np.lexsort((start, checks, ids))
        ids, checks, start = ids[order], checks[order], start[order]
        edges = np.concatenate(([0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(checks) != 0)) + 1, [len(ids)]))
        for at in range(0, len(edges) - 1, 10_000):
            part = edges[at : at + 10_001]
            yield pd.DataFrame({"id": ids[part[:-1]], "check": checks[part[:-1]], "spans": [_spans(start[x:y], window) for x, y in zip(part, part[1:], strict=False)]})

    destinations = max(partitions(spark), -(-words // (2 * BUCKET_WINDOWS)))
    bounded_batches(spark)
    found = packed.repartition(buckets, "bucket").mapInPandas(settle, "destination int, id binary, check binary, n binary, start binary")
    out = stored(found.repartition(destinations, "destination").mapInPandas(gather, "id long, check long, spans binary"), "anchor-repeats")
    shared.unpersist()
    release(spark)
    return out


def _ranked(a: np.ndarray, b: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and which of it stand at the earliest place of their hash."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():  # one half of the hash alone agrees
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    del x, y
    new = np.concatenate(([True], ~same))[: len(order)]
    first, group = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - np.int32(1)
    ids, start = ids[order], start[order]
    if not len(first):
        return order, np.zeros(0, bool)
    least = ids == np.minimum.reduceat(ids, first)[group]
    at = np.where(least, start, np.iinfo(np.int32).max)
    return order, least & (start == np.minimum.reduceat(at, first)[group])


def _by_text(row: np.ndarray, start: np.ndarray, of_row: np.ndarray, buckets: int) -> pd.DataFrame:
    """Starts to remove, a row a text; they pass through a bucket of the id and text."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1, [len(row)])) if len(row) else np.zeros(1, int)
    texts = of_row[row[edges[:-1]]]
    return pd.DataFrame({
        "bucket": (_spread(texts[:, 0], texts[:, 1]) % np.uint64(buckets)).astype(np.int64), "a": None, "b": None, "start": [start[x:y].astype(np.int32).tobytes() for x, y in zip(edges, edges[1:], strict=False)],
        "id": [x.tobytes() for x in texts[:, 0]], "check": [x.tobytes() for x in texts[:, 1]], "n": None,
    })


def kept_words(text: str | None, spans: bytes | None) -> tuple[int, int, str]:
    """Words, words removed, and the rest joined by spaces."""
    words = (text or "").encode().split()
    kept, at = [], 0
    for lo, hi in np.frombuffer(spans or b"", np.int32).reshape(-1, 2).tolist():
        kept += words[at:lo]
        at = hi
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the text that is left)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.col(text_col)).alias("check"), F.col(text_col).alias("text"))
    spans = repeats(rows, window)
    size = spans.select(F.count("*").alias("n"), F.sum(F.octet_length("spans")).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        spans = F.broadcast(spans)

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kept_words(t, s) for t, s in zip(text, spans, strict=True)], columns=["n_words", "n_removed", "kept"])

    bounded_batches(docs.sparkSession)
    return rows.join(spans, ["check", "id"], "left").select(F.col("doc").alias("id"), kept("text", "spans").alias("k")).select("id", "k.*")


@tidied
def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the spans that stand earlier."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT r, doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(list_slice(w, i, i + 19), ' '))) AS t FROM d WHERE len(w) >= 20),
f AS (SELECT r, s, (doc_id, s) > min((doc_id, s)) OVER (PARTITION BY t) AS later FROM g),
x AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(s, s + 20)) AS p FROM f WHERE later) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(x.gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN x.gone IS NULL THEN d.w ELSE list_filter(d.w, lambda v, i: NOT list_contains(x.gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""
