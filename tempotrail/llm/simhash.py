"""SimHash fingerprints, and near-duplicates by joining a binary trie with itself.

The trie of all distinct fingerprints is walked by node pairs: a pair starts at the same node, both sides
step down a bit at a time, a step to different children costs a bit, and a pair whose cost exceeds the budget
is dropped with everything below it.

To spread the walk, fingerprints are cut into blocks: with k differing bits allowed, k + r blocks have at
least r that agree, so for each choice of r blocks the trie is built with these bits on top, where the walk
allows no difference; the node below is a bucket, and buckets go to tasks.  r follows the number of distinct
fingerprints, so that buckets stay small.  A bucket that is large all the same (a dense cluster) is dealt in
chunks, and each pair of chunks is a task's unit.  A unit returns only links that join two of its groups, at
most one less than it has fingerprints, so a dense cluster never makes all its pairs.

Links become groups by repeated large-star and small-star steps, each stored in the shared folder.

Similar texts (similar_documents) are those whose sets of shingles have a Jaccard similarity of at least so
much.  So few bits don't find them: at 0.8, 64 bits differ in 4 to 16.  A text there has a sketch of three
fingerprints of its set, and the tries are more: each has other bits on top, as many as keep buckets small, and
there are so many tries that a pair at the least similarity, and with less luck than most, agrees in the top bits
of one but for a stated share (MISSED).  The walk has a budget for the bits of its fingerprint, and pairs that pass are held against the
budget of the whole sketch, which unrelated texts never meet.  A bucket that is large all the same is dealt
again by further bits, then in chunks; the rows a sketch makes follow the logarithm of the bucket, never its
size.  Candidates' groups are then searched by the sets themselves, so only pairs that hold join, and whatever
holds inside a group is found.  What tries and chunks leave apart is found exactly (rest_links): similar texts
share one of their first shingles in any order that holds for all texts, so every text is listed under each of its
first shingles, the rare before the frequent, and all pairs of a list that aren't joined yet are searched.  The
sketches thus save work and decide nothing.  A group's pair is passed over only where its two members are joined already, or
where it can't be similar: by the sizes of the sets, or because the rarest shingles of the one, of which similar
texts share at least one, aren't among those of the other.  A large group is searched in chunks, dealt in
three ways, which joins what is dense; then the texts still apart are brought together by the rare shingles
that they share.

Defined cases: a null or empty text, or one of white space, has fingerprint zero, linked like any other (as a set
it is the hash of nothing); a text of fewer words than a shingle is one shingle; equal texts share a fingerprint
and a group; a null id never is a component's id unless all its ids are null; of rows with the least id, one is
the first; very long texts are read whole; an empty table gives an empty result; other columns are ignored, or
kept where asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempotrail.llm.common import bounded_batches, partitions, sliced, small, stored, tidied

SEED = 42
#: A bucket's mean size up to which r stays, and the size from which a bucket is cut into chunks.
MEAN_BUCKET, CHUNK, MOST_CHOICES = 256, 8192, 256
#: Rows of buckets that a task holds at once.
TASK_ROWS = 1_000_000
#: Node pairs that the walk holds at once.
SLAB = 200_000
#: Node pairs with so many leaf pairs or fewer are compared outright.
LEAVES = 64
#: Fingerprints that are broadcast at most; beyond it, shuffled joins.
BROADCAST_ENDS = 300_000
#: Fingerprints of a sketch, bits of one and of all that may differ between candidates, and the mean size of buckets.
SKETCH_WORDS, WORD_BITS, SKETCH_BITS, MEAN_SKETCHES = 3, 20, 46, 1024
#: The share of pairs that the tries may leave apart, of pairs at the least similarity whose sketches differ by
#: UNLIKE standard deviations more than the mean.
MISSED, UNLIKE, LEAST_TRIES = 0.01, 1.65, 24
#: Texts, and shingles of them, from which a group whose texts are compared is cut into chunks.
PAIRED, PAIRED_SHINGLES = 1024, 1_500_000
#: Ways in which a large group is dealt in chunks.
DEALT = 3
#: Texts that are held against one at first; then ever more.
FIRST_TEXTS = 16
#: Counters of shingles at most (of 4 bytes), and the pairs of a list that are written out; a longer list is searched as a whole.
COUNTERS, LISTED_PAIRS = 1 << 22, 8192
#: Bins of a set's counts at least; a set has two to four shingles a bin beyond it.
LEAST_BINS = 32
#: Bins of pairs that are held at once.
CELLS = 1_000_000
_TEXT = "_text"


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hash of every shingle, repeats included; one for a text of fewer words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1 if n else np.zeros(1, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, n - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[-m:].tolist(), strict=True)), np.uint64, m)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return _majority(_shingles(text, shingle)) if (text or "").encode().split() else 0


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(_shingles(text, shingle))


def sketch(hashes: np.ndarray) -> list[int]:
    """Independent fingerprints of a set of hashes."""
    out = [_majority(hashes)]
    for i in range(1, SKETCH_WORDS):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        out.append(_majority((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text") -> DataFrame:
    """The rows with a column fp (the fingerprint's 64 bits as a signed long) instead of the text."""

    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in text], np.uint64).view(np.int64))

    bounded_batches(docs.sparkSession)
    return docs.withColumn("fp", of(text_col)).drop(text_col)


def _blocks(k: int, n: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bit ranges of the blocks, and the choices of blocks that lie on top."""
    r = 1
    while r < 4 and n / 2 ** (64 * r // (k + r)) > MEAN_BUCKET and len(list(combinations(range(k + r + 1), r + 1))) < MOST_CHOICES:
        r += 1
    edges = np.linspace(0, 64, k + r + 1).astype(int).tolist()
    return list(zip(edges, edges[1:], strict=False)), list(combinations(range(k + r), r))


def _turned(fp: np.ndarray, blocks: list, choice: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """The bits of the chosen blocks first, then the rest; and how many bits the chosen have."""
    out, top = np.zeros_like(fp), 0
    for i in [*choice, *(i for i in range(len(blocks)) if i not in choice)]:
        a, b = blocks[i]
        out = (out << np.uint64(b - a)) | ((fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1))
        top += (b - a) * (i in choice)
    return out, top


class Groups:
    """Union-find over positions, with labels that are flattened after each slab."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join the pairs, which come nearest first; returns those that joined two groups."""
        label, used = self.label, []
        la, lb = label[a], label[b]
        apart = np.flatnonzero(la != lb)
        if not len(apart):
            return used
        _, first = np.unique(np.minimum(la[apart], lb[apart]) * len(label) + np.maximum(la[apart], lb[apart]), return_index=True)
        for i in np.sort(apart[first]).tolist():
            x, y = int(a[i]), int(b[i])
            while label[x] != x:
                x = int(label[x])
            while label[y] != y:
                y = int(label[y])
            if x != y:
                label[max(x, y)] = min(x, y)
                used.append((int(a[i]), int(b[i])))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        return used


def trie_links(keys: np.ndarray, roots: np.ndarray, depth: int, k: int, further: Sequence[np.ndarray] = (), most: int = 64) -> list[tuple[int, int]]:
    """Spanning links between positions of keys that differ in at most k bits, and with the further words in at most so many.

    keys: sorted within each root; roots: the first position of each root, and the end.  All keys of a root
    agree on the bits above depth (counted from the lowest).
    """
    groups, links = Groups(len(keys)), []
    ones: dict[int, np.ndarray] = {}

    def set_before(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return ones[bit]

    lo, hi = roots[:-1], roots[1:]
    stack = [(depth - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, cost = stack.pop()
        if len(a0) > SLAB:
            cut = len(a0) // 2
            stack += [(bit, *(x[:cut] for x in (a0, a1, b0, b1, cost))), (bit, *(x[cut:] for x in (a0, a1, b0, b1, cost)))]
            continue
        few = ((a1 - a0) * (b1 - b0) <= LEAVES) | (bit < 0)
        if few.any():
            links += _leaves(keys, groups, *(x[few] for x in (a0, a1, b0, b1)), k, further, most)
            a0, a1, b0, b1, cost = (x[~few] for x in (a0, a1, b0, b1, cost))
        if not len(a0):
            continue
        before = set_before(bit)
        am, bm = a1 - (before[a1] - before[a0]), b1 - (before[b1] - before[b0])
        same, can = a0 == b0, cost < k
        parts = [(a0, am, b0, bm, cost, None), (am, a1, bm, b1, cost, None), (a0, am, bm, b1, cost + 1, can), (am, a1, b0, bm, cost + 1, can & ~same)]
        rows = [[], [], [], [], []]
        for *part, keep in parts:
            full = (part[1] > part[0]) & (part[3] > part[2])
            full = full if keep is None else full & keep
            for to, x in zip(rows, part, strict=True):
                to.append(x[full])
        stack.append((bit - 1, *map(np.concatenate, rows)))
    return links


def _leaves(keys: np.ndarray, groups: Groups, a0, a1, b0, b1, k: int, further: Sequence[np.ndarray], most: int) -> list[tuple[int, int]]:
    links = []
    for at in range(0, len(a0), max(1, SLAB // 8)):
        s = slice(at, at + max(1, SLAB // 8))
        na, nb = a1[s] - a0[s], b1[s] - b0[s]
        size = na * nb
        pair = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i, j = a0[s][pair] + nth // nb[pair], b0[s][pair] + nth % nb[pair]
        cost = np.bitwise_count(keys[i] ^ keys[j])
        near = np.flatnonzero((i < j) & (cost <= k))
        i, j, cost = i[near], j[near], cost[near].astype(np.int64)
        for word in further:
            cost += np.bitwise_count(word[i] ^ word[j])
        near = np.flatnonzero(cost <= most)
        near = near[np.argsort(cost[near], kind="stable")]
        links += groups.join(i[near], j[near])
    return links


def near_links(fps: DataFrame, k: int = 4) -> DataFrame:
    """Links (a, b) that span the groups of the distinct fingerprints in column fp; stored."""
    spark, n = fps.sparkSession, fps.count()
    blocks, choices = _blocks(k, n)

    def bucketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            for c, choice in enumerate(choices):
                turned, top = _turned(fp.view(np.uint64), blocks, choice)
                yield pd.DataFrame({"bucket": ((turned >> np.uint64(64 - top)) << np.uint64(8) | np.uint64(c)).view(np.int64), "fp": fp})

    rows = fps.select("fp").mapInPandas(bucketed, "bucket long, fp long")
    hot = stored(rows.groupBy("bucket").count().filter(F.col("count") > CHUNK), "simhash-hot")
    units = rows.select("bucket", F.lit(0).alias("unit"), "fp")
    if not hot.isEmpty():
        dealt = rows.join(hot, "bucket", "left")
        chunks = F.ceil(F.col("count") / CHUNK).cast("int")
        mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        pair = lambda other: F.least(mine, other) * chunks + F.greatest(mine, other)
        units = dealt.select("bucket", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(chunks, F.lit(1)) - 1), pair))).alias("unit"), "fp")

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if not held:
            return
        got = {c: np.concatenate([x[c].to_numpy() for x in held]) for c in ("bucket", "unit", "fp")}
        for c, choice in enumerate(choices):
            own = (got["bucket"] & 255) == c
            bucket, unit, fp = (got[x][own] for x in ("bucket", "unit", "fp"))
            if not len(fp):
                continue
            turned, top = _turned(fp.view(np.uint64), blocks, choice)
            order = np.lexsort((turned, unit, bucket))
            bucket, unit, fp, turned = bucket[order], unit[order], fp[order], turned[order]
            new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(unit) != 0)) + 1
            links = trie_links(turned, np.concatenate(([0], new, [len(fp)])), 64 - top, k)
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            yield pd.DataFrame({"a": np.minimum(fp[a], fp[b]), "b": np.maximum(fp[a], fp[b])})

    tasks = max(partitions(spark), -(-n * len(choices) // TASK_ROWS))
    return stored(units.repartition(tasks, "bucket", "unit").mapInPandas(walked, "a long, b long").distinct(), "simhash-links")


def components(links: DataFrame) -> DataFrame:
    """node and root (the group's smallest node) of every node that has a link (a, b)."""

    def state(edges: DataFrame) -> tuple:
        """What a table of edges holds: its size and sums of two hashes."""
        hashes = (F.sum(F.xxhash64(F.lit(seed), "v", "u").cast("decimal(38,0)")) for seed in (1, 2))
        return tuple(edges.agg(F.count("*"), *hashes).first())

    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "components")
    before = state(edges)
    while before[0]:
        # large-star: every larger neighbour of a node moves to the node's smallest neighbour
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small-star: a node and its smaller neighbours move to the smallest of them
        large = stored(large, "components")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = stored(moved.unionByName(least.select("v", F.col("m").alias("u"))).filter("v <> u").distinct(), "components")
        before, after = state(edges), before
        if before == after:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def agreement(least: float) -> float:
    """The share of bits in which the sketches of two texts of this similarity agree, near the lower end of its spread."""
    differ = math.acos(2 * least / (1 + least)) / math.pi
    return 1 - differ - UNLIKE * math.sqrt(differ * (1 - differ) / (64 * SKETCH_WORDS))


def tables(n: int, agree: float, mean: int, seed: int) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """How many bits are on top of the tries, and each trie's fingerprint and order of bits.

    n: sketches; agree: the share of bits in which a pair agrees that is to be found.
    """
    top = min(40, max(6, math.ceil(math.log2(max(1, n / mean)))))
    count = max(LEAST_TRIES, math.ceil(math.log(MISSED) / math.log1p(-(agree**top))))
    rng, out = np.random.default_rng(seed), []
    while len(out) < count:
        orders = [rng.permutation(64) for _ in range(SKETCH_WORDS)]
        out += [(w, np.roll(orders[w], -cut * top)) for cut in range(64 // top) for w in range(SKETCH_WORDS)]
    return top, out[:count]


def _ordered(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bits at these places, the first on top."""
    out = np.zeros_like(fp)
    for place in order:
        out = (out << np.uint64(1)) | ((fp >> np.uint64(place)) & np.uint64(1))
    return out


def sketch_links(sketches: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of first fingerprints that join the distinct sketches (f0, f1, ..) of similar texts into groups; stored."""
    spark, n = sketches.sparkSession, sketches.count()
    names = [f"f{i}" for i in range(SKETCH_WORDS)]
    agree = agreement(least)
    top, first = tables(n, agree, MEAN_SKETCHES, 1)
    words = lambda df: [df[c].to_numpy(np.int64).view(np.uint64) for c in names]
    schema = "bucket long, trie int, " + ", ".join(f"{c} long" for c in names)

    def bucketed(tries: list, top: int, start: int):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                fps = words(batch)
                # a bucket that is dealt again keeps its parts apart
                before = batch["bucket"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if "bucket" in batch else np.uint64(0)
                for t, (w, order) in enumerate(tries, start):
                    bucket = (_ordered(fps[w], order[:top]) << np.uint64(20) | np.uint64(t)) ^ before
                    yield pd.DataFrame({"bucket": bucket.view(np.int64), "trie": np.int32(t), **{c: f.view(np.int64) for c, f in zip(names, fps, strict=True)}})

        return of

    def hot_of(rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("bucket").count().filter(F.col("count") > CHUNK), "simhash-hot")

    def part_in(hot: DataFrame) -> DataFrame:
        return F.broadcast(hot) if small(hot, BROADCAST_ENDS) else hot

    bounded_batches(spark)
    rows = sketches.select(*names).mapInPandas(bucketed(first, top, 0), schema)
    units, tries = rows.withColumn("unit", F.lit(0)), first
    hot = hot_of(rows)
    if not hot.isEmpty():
        largest = hot.agg(F.max("count")).first()[0]
        finer_top, finer = tables(largest, agree, MEAN_SKETCHES, 2)
        tries = first + finer
        again = rows.join(part_in(hot), "bucket", "left_semi").select("bucket", *names).mapInPandas(bucketed(finer, finer_top, len(first)), schema)
        chunks = F.ceil(F.coalesce("count", F.lit(1)) / CHUNK).cast("int")
        again = again.join(part_in(hot_of(again)), "bucket", "left").withColumn("unit", F.pmod(F.xxhash64("bucket", *names), chunks).cast("int"))
        units = units.join(part_in(hot), "bucket", "left_anti").unionByName(again.drop("count"))
    tops = [top] * len(first) + [finer_top if len(tries) > len(first) else top] * (len(tries) - len(first))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if not held:
            return
        got = pd.concat(held)
        for t, own in got.groupby("trie"):
            w, order = tries[t]
            fps, bucket, unit = words(own), own["bucket"].to_numpy(), own["unit"].to_numpy()
            turned = _ordered(fps[w], order)
            by = np.lexsort((turned, unit, bucket))
            fps, bucket, unit, turned = [f[by] for f in fps], bucket[by], unit[by], turned[by]
            new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(unit) != 0)) + 1
            further = [f for i, f in enumerate(fps) if i != w]
            links = trie_links(turned, np.concatenate(([0], new, [len(turned)])), 64 - tops[t], WORD_BITS, further, SKETCH_BITS)
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            ends = fps[0].view(np.int64)
            yield pd.DataFrame({"a": np.minimum(ends[a], ends[b]), "b": np.maximum(ends[a], ends[b])})

    tasks = max(partitions(spark), -(-n * len(first) // TASK_ROWS))
    return stored(units.repartition(tasks, "bucket", "unit").mapInPandas(walked, "a long, b long").distinct(), "simhash-links")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many positions from each start."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def verified_links(fp: np.ndarray, sets: list[np.ndarray], cut: int, least: float, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links between positions that share at least so much of their sets.

    fp: a fingerprint, by which nearer pairs come first; cut: only pairs of a position before it and one from it
    on, 0 for all pairs; joined: positions with equal values are joined already.
    """
    n = len(fp)
    size = np.fromiter(map(len, sets), np.int64, n)
    ends = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    # of the rarest shingles, similar texts share one: at most the others can be missing
    heads = prefix(size, least)
    head = np.arange(len(token)) - np.repeat(ends[:-1], size) < np.repeat(heads, size)
    by_token = np.argsort(token[head], kind="stable")
    holders, first = owner[head][by_token], np.searchsorted(token[head][by_token], np.arange(len(often) + 1))
    groups, links, mark, held = Groups(n), [], np.zeros(len(often), bool), np.zeros(n, bool)
    label = groups.label
    if joined is not None:
        _, at, code = np.unique(joined, return_index=True, return_inverse=True)
        label[:] = at[code]

    for i in range(cut or n):
        js = np.arange(cut or i + 1, n)
        js = js[label[js] != label[i]]
        js = js[np.minimum(size[js], size[i]) >= least * np.maximum(size[js], size[i])]
        if not len(js):
            continue
        mine = token[ends[i] : ends[i + 1]]
        rare = mine[: heads[i]]
        counts = first[rare + 1] - first[rare]
        if counts.sum() < size[js].sum():
            of = holders[_spread(first[rare], counts)]
            held[of] = True
            js = js[held[js]]
            held[of] = False
        js = js[np.argsort(np.bitwise_count(fp[js] ^ fp[i]), kind="stable")]
        mark[mine] = True
        texts = FIRST_TEXTS
        while len(js):
            now, js = js[:texts], js[texts:]
            shared = np.add.reduceat(mark[token[_spread(ends[now], size[now])]], np.cumsum(size[now]) - size[now], dtype=np.int64)
            now = now[shared >= least * (size[now] + size[i] - shared)]
            links += groups.join(np.full(len(now), i), now)
            js, texts = js[label[js] != label[i]], texts * 4
        mark[mine] = False
    return links


def prefix(size, least: float):
    """Of so many rarest shingles of a set, every similar set has one."""
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def binned(tokens: np.ndarray) -> bytes:
    """How many of these hashes start with the same bits, a byte each; nothing where a byte doesn't hold it."""
    bits = max(LEAST_BINS, 1 << max(0, math.ceil(math.log2(max(1, len(tokens) / 4))))).bit_length() - 1
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def can_be_similar(a: Sequence[bytes], b: Sequence[bytes], least: float) -> np.ndarray:
    """Whether pairs of sets can share at least so much: of a bin, they share no more than the lesser count."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.ones(len(sizes), bool)
    for m, n in {(m, n) for m, n in sizes.tolist() if m and n}:
        at = np.flatnonzero((sizes == (m, n)).all(axis=1))
        for part in np.array_split(at, -(-len(at) * max(m, n) // CELLS)):
            x, y = (np.frombuffer(b"".join(of[i] for i in part), np.uint8).reshape(len(part), min(m, n), -1).sum(axis=2, dtype=np.int64) for of in (a, b))
            shared = np.minimum(x, y).sum(axis=1)
            out[part] = shared >= least * (x.sum(axis=1) + y.sum(axis=1) - shared)
    return out


LINKS = "fp_a long, check_a long, fp_b long, check_b long"


def _searched(units: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of units' texts (root, unit, part, joined, fp, check, set); texts of two parts make a pair only across them."""

    def search(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values("part", kind="stable")
        part, fp, check = unit["part"].to_numpy(), unit["fp"].to_numpy(np.int64), unit["check"].to_numpy(np.int64)
        joined = unit["joined"].to_numpy(np.int64) if unit["joined"].notna().all() else None
        links = verified_links(fp.view(np.uint64), unit["set"].tolist(), int(np.argmax(part != part[0])), least, joined)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"fp_a": fp[a], "check_a": check[a], "fp_b": fp[b], "check_b": check[b]})

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            root, unit = batch["root"].to_numpy(), batch["unit"].to_numpy()
            new = np.flatnonzero((np.diff(root) != 0) | (np.diff(unit) != 0)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(batch)], strict=True):
                if lo == hi:
                    continue
                if last != (root[lo], unit[lo]) and held:
                    yield search(pd.concat(held))
                    held = []
                held.append(batch.iloc[lo:hi])
                last = root[lo], unit[lo]
        if held:
            yield search(pd.concat(held))

    bounded_batches(units.sparkSession)
    dealt = units.select("root", "unit", "part", "joined", "node.fp", "node.check", "set").repartition(partitions(units.sparkSession), "root", "unit").sortWithinPartitions("root", "unit")
    links = dealt.mapInPandas(walked, LINKS).distinct()
    node = lambda end: F.struct(F.col(f"fp_{end}").alias("fp"), F.col(f"check_{end}").alias("check")).alias(end)
    return stored(links.select(node("a"), node("b")), "simhash-similar")


def _with_joined(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with joined, a hash that stands for what the links join a text to."""
    roots = components(links).withColumnRenamed("root", "joined_to")
    return sets.join(roots, "node", "left").withColumn("joined", F.xxhash64(F.coalesce("joined_to", "node"))).drop("joined_to")


def _large_links(sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) in large groups (root, node, set, chunks)."""
    # dealt in chunks by several hashes, what is dense is joined whatever chunk it falls in
    dealt = F.array(*(F.pmod(F.xxhash64("node", F.lit(seed)), F.col("chunks")).cast("long") * DEALT + seed for seed in range(DEALT)))
    chunked = sets.select("root", F.explode(dealt).alias("unit"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("joined"), "node", "set")
    links = _searched(chunked, least)
    rest = stored(_with_joined(sets, links).select("root", "node", "joined", "set"), "simhash-apart")
    several = rest.groupBy("root").agg(F.min("joined").alias("x"), F.max("joined").alias("y")).filter("x <> y").select("root")
    apart = rest.join(several, "root", "left_semi")
    tokens = apart.select("root", "node", "joined", F.size("set").alias("size"), F.explode("set").alias("token"))
    often = tokens.groupBy("root", "token").agg(F.count("*").alias("often"))
    nth = F.row_number().over(Window.partitionBy("root", "node").orderBy("often", "token"))
    heads = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    rare = tokens.join(often, ["root", "token"]).withColumn("nth", nth).filter((F.col("nth") <= heads) & (F.col("often") > 1))
    rare = stored(rare.select("root", "token", "node", "joined"), "simhash-rare")
    shared = rare.groupBy("root", "token").agg(F.min("joined").alias("x"), F.max("joined").alias("y"), F.count("*").alias("texts")).filter("x <> y")
    shared = stored(shared.select("root", "token", F.ceil(F.col("texts") / PAIRED).cast("int").alias("chunks")), "simhash-shared")
    if shared.isEmpty():
        return links
    # a list of one rare shingle is a unit; one that is long all the same is dealt in chunks, each pair of them a unit
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pair = lambda other: F.least(mine, other) * F.col("chunks") + F.greatest(mine, other)
    lists = rare.join(shared, ["root", "token"]).select("root", "node", mine.alias("part"), F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.xxhash64("token", pair(other)))).alias("unit"))
    units = lists.join(rest, ["root", "node"]).select("root", "unit", "part", "joined", "node", "set")
    return links.unionByName(_searched(units, least))


def similar_links(members: DataFrame, prints: DataFrame, least: float, shingle: int, text_col: str = "text") -> DataFrame:
    """Links (a, b) that span the groups of texts that share at least so much of all their shingles (Jaccard).

    members: node (fp, and the check of the text's set), the root of the group of candidates it is in, and a row
    of prints that has its text.
    """
    several = members.groupBy("root").agg(F.count("*").alias("texts")).filter("texts > 1")
    ends = stored(members.join(several, "root", "left_semi"), "simhash-ends")
    texts = prints.select("row", F.col(text_col).alias("text")).join(F.broadcast(ends) if small(ends, BROADCAST_ENDS) else ends, "row")

    bounded_batches(prints.sparkSession)
    sets = stored(texts.select("root", "node", _sets_of(shingle)("text").alias("set")), "simhash-sets")
    chunks = F.greatest(F.ceil(F.count("*") / PAIRED), F.ceil(F.sum(F.size("set")) / PAIRED_SHINGLES)).cast("int")
    large = stored(sets.groupBy("root").agg(chunks.alias("chunks")).filter("chunks > 1"), "simhash-large")
    part_in = F.broadcast(large) if small(large, BROADCAST_ENDS) else large
    whole = sets.join(part_in, "root", "left_anti")
    links = _searched(whole.select("root", F.lit(0).cast("long").alias("unit"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("joined"), "node", "set"), least)
    return links if large.isEmpty() else links.unionByName(_large_links(sets.join(part_in, "root"), least))


def _different(batches: Iterator[pd.DataFrame], shingle: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Checks and shingle sets of texts (check, text), batch by batch, each check once."""
    seen: set[int] = set()
    for batch in batches:
        new = [(c, t) for c, t in dict(zip(batch["check"].tolist(), batch["text"], strict=True)).items() if c not in seen]
        if new:
            seen.update(c for c, _ in new)
            yield np.array([c for c, _ in new], np.int64), [shingle_set(t, shingle) for _, t in new]


def _shingle_counts(texts: DataFrame, n: int, shingle: int) -> np.ndarray:
    """In how many texts the shingles are that start with the same bits."""
    bits = min(int(math.log2(COUNTERS)), max(12, math.ceil(math.log2(n + 1)) + 2))
    part = 1 << 12

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, np.uint32)
        for _, sets in _different(batches, shingle):
            np.add.at(counts, np.concatenate(sets) >> np.uint64(64 - bits), np.uint32(1))
        full = [at for at in range(0, len(counts), part) if counts[at : at + part].any()]
        yield pd.DataFrame({"at": np.array(full, np.int32), "counts": [counts[at : at + part].tobytes() for at in full]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch["at"].tolist(), batch["counts"], strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        yield pd.DataFrame({"at": np.array(list(sums), np.int32), "counts": [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]})

    out = np.zeros(1 << bits, np.uint32)
    for r in texts.mapInPandas(count, "at int, counts binary").repartition("at").mapInPandas(total, "at int, counts binary").collect():
        out[r["at"] : r["at"] + part] = np.frombuffer(r["counts"], np.uint32)
    return out


def _listed(texts: DataFrame, n: int, least: float, shingle: int) -> DataFrame:
    """The lists (token) of different texts (check, size) that have it among their first shingles, at this place; those of one text are left out."""
    spark = texts.sparkSession
    counts = _shingle_counts(texts, n, shingle)
    shift, rows = np.uint64(64 - int(math.log2(len(counts)))), int(counts.sum(dtype=np.int64) * (1 - least)) + n
    shared = spark.sparkContext.broadcast(counts)  # COUNTERS at most

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for checks, sets in _different(batches, shingle):
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            many = prefix(size, least)
            # any order is right that holds for all texts; rare shingles first make short lists
            tokens = np.concatenate([s[np.lexsort((s, often[s >> shift]))[:k]] for s, k in zip(sets, many.tolist(), strict=True)])
            at = _spread(np.zeros_like(many), many)
            yield from sliced(pd.DataFrame({"token": tokens.view(np.int64), "check": np.repeat(checks, many), "size": np.repeat(size, many).astype(np.int32), "at": at.astype(np.int32)}))

    def of_several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if not held:
            return
        got = pd.concat(held).sort_values(["token", "check"], kind="stable", ignore_index=True)
        token, check = got["token"].to_numpy(), got["check"].to_numpy()
        new = np.concatenate(([True], (np.diff(token) != 0) | (np.diff(check) != 0)))
        got, token = got[new], token[new]
        start = np.concatenate(([True], token[1:] != token[:-1]))
        alone = start & np.concatenate((start[1:], [True]))
        yield from sliced(got[~alone])

    schema = "token long, check long, size int, at int"
    out = texts.mapInPandas(heads, schema).repartition(max(partitions(spark), -(-rows // TASK_ROWS)), "token").mapInPandas(of_several, schema)
    out = stored(out, "simhash-listed")
    shared.unpersist()
    return out


def _listed_pairs(lists: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts of a list that aren't joined and may be similar, by their sizes and the place of the shingle."""

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if not held:
            return
        got = pd.concat(held).sort_values(["token", "joined"], kind="stable", ignore_index=True)
        token, joined, check, size, at = (got[c].to_numpy(np.int64) for c in ("token", "joined", "check", "size", "at"))
        after = lambda new: np.append(np.flatnonzero(new), len(got))[np.cumsum(new)]
        new = np.concatenate(([True], np.diff(token) != 0))
        own = after(new | np.concatenate(([True], np.diff(joined) != 0)))
        counts = after(new) - own
        # rows after a row's own group of joined texts, a slab at a time
        slabs = np.searchsorted(np.cumsum(counts), np.arange(SLAB, counts.sum() + SLAB, SLAB), side="right")
        for lo, hi in zip([0, *slabs.tolist()], [*slabs.tolist(), len(got)], strict=True):
            i, j = np.repeat(np.arange(lo, hi), counts[lo:hi]), _spread(own[lo:hi], counts[lo:hi])
            # at the first shingle that a pair shares, it can share no more than what follows in both
            most = np.minimum(size[i] - at[i], size[j] - at[j])
            can = most >= least / (1 + least) * (size[i] + size[j]) - 1e-6
            a, b = check[i[can]], check[j[can]]
            yield from sliced(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates())

    return lists.select("token", "joined", "check", "size", "at").repartition("token").mapInPandas(paired, "a long, b long").distinct()


def _that_can_be_similar(pairs: DataFrame, distinct: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that their counts by bins don't rule out, so that only their sets need be brought together; stored."""

    @F.pandas_udf("boolean")
    def can(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(can_be_similar(a.tolist(), b.tolist(), least))

    part_in = lambda df: F.broadcast(df) if small(df, BROADCAST_ENDS) else df
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("check")).distinct(), "simhash-wanted")
    ends = stored(distinct.select("node.check", "least.row").join(part_in(wanted), "check", "left_semi"), "simhash-ends")
    bins = stored(prints.select("row", "bins").join(part_in(ends), "row").select("check", "bins"), "simhash-bins")
    side = lambda end: part_in(bins.select(F.col("check").alias(end), F.col("bins").alias(f"bins_{end}")))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").filter(can("bins_a", "bins_b")).select("a", "b"), "simhash-pairs")


def rest_links(distinct: DataFrame, prints: DataFrame, groups: DataFrame, least: float, shingle: int, text_col: str = "text") -> DataFrame | None:
    """Links (a, b) that, with the groups (node, root), span the groups of all similar texts; none where nothing is apart.

    distinct: node and least.row, a row of prints that has its text.
    """
    spark = prints.sparkSession
    bounded_batches(spark)
    part_in = lambda df: F.broadcast(df) if small(df, BROADCAST_ENDS) else df
    listed = _listed(prints.select("node.check", F.col(text_col).alias("text")), distinct.count(), least, shingle)
    known = stored(groups.select("node.check", F.xxhash64("root").alias("group")).dropDuplicates(["check"]), "simhash-known")
    joined = listed.join(part_in(known), "check", "left").withColumn("joined", F.coalesce("group", F.xxhash64("check"))).drop("group")
    sizes = joined.groupBy("token", "joined").agg(F.count("*").alias("texts"), F.sum("size").alias("shingles")).groupBy("token")
    square = (F.pow(F.sum("texts"), 2) - F.sum(F.col("texts").cast("double") * F.col("texts"))) / 2
    lists = sizes.agg(square.alias("pairs"), F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles")).filter("pairs > 0.5")
    chunks = F.greatest(F.ceil(F.col("texts") / PAIRED), F.ceil(F.col("shingles") / PAIRED_SHINGLES)).cast("int")
    lists = stored(lists.select("token", "pairs", chunks.alias("chunks")), "simhash-lists")
    if lists.isEmpty():
        return None
    apart = stored(joined.join(part_in(lists), "token"), "simhash-apart")
    pairs = _that_can_be_similar(stored(_listed_pairs(apart.filter(F.col("pairs") <= LISTED_PAIRS), least), "simhash-pairs"), distinct, prints, least)
    # a text with those after it is a unit, in chunks where they are many
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRED).alias("chunks"))
    pairs = pairs.join(many, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), "chunks")).alias("unit"))
    units = pairs.select(F.lit(0).alias("root"), "unit", F.lit(0).alias("part"), F.col("a").alias("check")).distinct()
    units = units.unionByName(pairs.select(F.lit(0).alias("root"), "unit", F.lit(1).alias("part"), F.col("b").alias("check")))
    # a list of many pairs is a unit; one that is long all the same is dealt in chunks, each pair of them a unit
    mine = F.pmod(F.xxhash64("check"), F.col("chunks")).cast("int")
    pair = lambda other: F.least(mine, other) * F.col("chunks").cast("long") + F.greatest(mine, other)
    each = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.xxhash64("token", pair(other))))
    units = units.unionByName(apart.filter(F.col("pairs") > LISTED_PAIRS).select(F.lit(1).alias("root"), each.alias("unit"), mine.alias("part"), "check"))
    units = stored(units, "simhash-units")
    ends = distinct.select("node", "node.check", "least.row").join(part_in(stored(units.select("check").distinct(), "simhash-wanted")), "check", "left_semi")
    ends = stored(ends.join(part_in(known), "check", "left").select("check", "node", "row", F.coalesce("group", F.xxhash64("check")).alias("joined")), "simhash-ends")
    texts = prints.select("row", F.col(text_col).alias("text")).join(part_in(ends), "row")
    sets = stored(texts.select("check", "node", "joined", _sets_of(shingle)("text").alias("set")), "simhash-sets")
    return _searched(units.join(sets, "check"), least)


def _sets_of(shingle: int) -> Callable[..., Column]:
    @F.pandas_udf("array<long>")
    def sets_of(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, shingle).view(np.int64) for x in text])

    return sets_of


def _named(prints: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """prints (node) with component_id and first_row, from each node's least row and its group's root."""
    rooted = distinct.join(groups, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("least"))
    named = stored(rooted.drop("least").join(ids, "root").select("node", F.col("least.id").alias("component_id"), F.col("least.row").alias("first_row")), "simhash-groups")
    return prints.join(F.broadcast(named) if small(named, BROADCAST_ENDS) else named, "node")


def _least_row() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")


def near_duplicates(docs: DataFrame, shingle: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp, row, component_id (the smallest id among all rows that links of at most k bits reach) and
    first_row (one row of the component with that id)."""
    rows = docs.select(F.col(id_col).alias("id"), text_col, F.monotonically_increasing_id().alias("row"))
    prints = stored(fingerprints(rows, shingle, text_col).withColumn("node", F.col("fp")), "simhash")
    distinct = stored(prints.groupBy("node").agg(_least_row()), "simhash-distinct")
    groups = components(near_links(distinct.select(F.col("node").alias("fp")), k))
    return _named(prints, distinct, groups).select("id", "fp", "row", "component_id", "first_row")


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: id, row, component_id (the smallest id among all rows that pairs of similar texts reach), first_row
    (one row of the component with that id), and the columns of keep."""
    names = [f"f{i}" for i in range(SKETCH_WORDS)]

    @F.pandas_udf(", ".join(f"{c} long" for c in [*names, "check"]) + ", bins binary")
    def sketched(text: pd.Series) -> pd.DataFrame:
        words, bins = np.empty((len(text), SKETCH_WORDS + 1), np.uint64), []
        for i, x in enumerate(text):
            own = shingle_set(x, shingle)
            words[i] = [*sketch(own), xxhash.xxh64_intdigest(own.tobytes(), SEED)]
            bins.append(binned(own))
        return pd.DataFrame(words.view(np.int64), columns=[*names, "check"]).assign(bins=bins)

    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(_TEXT), F.monotonically_increasing_id().alias("row"), *(c for c in keep if c != text_col))
    prints = own.withColumn("sketch", sketched(_TEXT)).withColumn("node", F.struct(F.col("sketch.f0").alias("fp"), F.col("sketch.check").alias("check")))
    prints = stored(prints.withColumn("bins", F.col("sketch.bins")).withColumn("sketch", F.struct(*(F.col(f"sketch.{c}").alias(c) for c in names))), "simhash")
    distinct = stored(prints.groupBy("node").agg(_least_row(), F.first("sketch").alias("sketch")), "simhash-distinct")
    groups = components(sketch_links(distinct.select(*(f"sketch.{c}" for c in names)).distinct(), least))
    members = distinct.select("node", "node.fp", "least.row").join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"), "row")
    groups = stored(components(similar_links(members, prints, least, shingle, _TEXT)), "simhash-similar")
    rest = rest_links(distinct, prints, groups, least, shingle, _TEXT)
    if rest is not None and not rest.isEmpty():
        groups = components(rest.unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return _named(prints, distinct, groups).select("id", "row", "component_id", "first_row", *(F.col(_TEXT).alias(c) if c == text_col else c for c in keep))


@tidied
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
