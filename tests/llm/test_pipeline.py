"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempotrail.llm import common, simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, over the documents and a few planted ones."""
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    long = max((r["text"] for r in docs.select("text").collect()), key=len)
    words = long.split()
    words[len(words) // 2] = "changed"
    planted = [(10_001, long, "en", "src1", 0), (10_002, " ".join(words), "en", "src1", 0), (10_003, "12 34 ...", None, "src2", 0), (10_004, f"before {item} after", "en", None, 0), (10_005, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    out, at = {}, f"{path}/0"
    docs.write.parquet(at)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = spark.read.parquet(at)
        at = f"{path}/{n + 1}"
        stage(spark, before, FOLDER).write.parquet(at)
        out[name] = [r.asDict() for r in before.collect()], [r.asDict() for r in spark.read.parquet(at).collect()]
    return out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_columns(stages):
    for name, (_, after) in stages.items():
        assert set(after[0]) - {"shard", "slot"} == set(corpus_pipeline.COLUMNS), name


def test_language(stages):
    before, after = stages["language"]
    assert ids(before) - ids(after) == Counter([10_003, 10_005])


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    least = least_of_groups(len(before), near_pairs([r["text"] for r in before]))
    first = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(before):
        first[least[i]] = min(first[least[i]], r["doc_id"])
    assert ids(after) == Counter(first.values())
    assert 10_001 not in ids(after) and 10_002 not in ids(after)


def near_pairs(texts):
    """All pairs that are similar, by an inverted index."""
    shingles = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    by_shingle = defaultdict(list)
    for i, s in enumerate(shingles):
        for x in s:
            by_shingle[x].append(i)
    shared = Counter((i, j) for at in by_shingle.values() for n, j in enumerate(at) for i in at[:n])
    return {(i, j) for (i, j), n in shared.items() if n >= corpus_pipeline.SIMILARITY * (len(shingles[i]) + len(shingles[j]) - n)}


def least_of_groups(n, pairs):
    least = list(range(n))
    while True:
        before = list(least)
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            return least


def similar(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["id"]: r["component_id"] for r in simhash.similar_documents(docs, 5, corpus_pipeline.SIMILARITY).collect()}
    return [found[i] for i in range(len(texts))]


@pytest.mark.parametrize(("paired", "chunk"), [(4096, 8192), (50, 8192), (20, 40)])
def test_near_duplicates_in_a_dense_cluster(spark, monkeypatch, paired, chunk):
    """Texts that share a passage are candidates of each other; only the few copies among them are similar."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    random = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in random.integers(0, 1_000_000, n)]
    passage = words(300)
    texts = [passage + words(100) for _ in range(250)]
    for i in range(40):
        copy = list(texts[i])
        for at in random.integers(300, 400, 4):
            copy[at] = "other"
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    pairs = near_pairs(texts)
    assert len(pairs) >= 30
    assert similar(spark, texts) == least_of_groups(len(texts), pairs)


@pytest.mark.parametrize("chunk", [8192, 30])
def test_pairs_at_the_least_similarity_are_found(spark, monkeypatch, chunk):
    """Pairs between 0.8 and 0.82, short and long, among texts that are unlike; buckets as small as they get."""
    monkeypatch.setattr(simhash, "MEAN_SKETCHES", 8)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    random = np.random.default_rng(12)
    texts = []
    for i in range(300):
        words = [f"w{x}" for x in random.integers(0, 1_000_000, 30 + 7 * (i % 40))]
        n = len(words) - 4
        new = int(n * 0.2 / 1.8)  # shingles that a changed end takes: J = (n - new) / (n + new) at least 0.8
        texts += [" ".join(words), " ".join(words[: len(words) - new] + [f"x{x}" for x in random.integers(0, 1_000_000, new)])]
    pairs = near_pairs(texts)
    assert len(pairs) >= 300
    found = similar(spark, texts)
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.98 * len(pairs) and all(found[i] in (i, i - 1) for i in range(len(texts)))


@pytest.mark.parametrize(("chunk", "listed"), [(8192, 8192), (8, 8192), (8, 0)])
def test_no_similar_pair_is_lost_by_sketches_and_chunks(spark, monkeypatch, chunk, listed):
    """Texts of 4 and 5 shingles have unlike sketches; chunks of full buckets aren't held against each other."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "LISTED_PAIRS", listed, raising=False)
    random = np.random.default_rng(31)
    words = lambda n: [f"w{x}" for x in random.integers(0, 1_000_000, n)]
    passage, texts = words(60), []
    for _ in range(200):
        short, long = words(8), words(30)
        texts += [short, [*short, "more"], long + passage, long[:5] + words(3) + long[8:] + passage]
    texts = [" ".join(t) for t in texts]
    pairs = near_pairs(texts)
    assert len(pairs) == 400
    assert similar(spark, texts) == least_of_groups(len(texts), pairs)


def test_pairs_of_a_list_leave_out_what_is_joined(spark):
    rows = [(1, 1, 7, 10, 0), (1, 2, 7, 10, 0), (1, 3, 8, 10, 1), (1, 4, 9, 13, 0), (1, 5, 6, 10, 2), (2, 1, 7, 10, 1), (2, 3, 8, 10, 0)]
    lists = spark.createDataFrame(rows, "token long, check long, joined long, size int, at int")
    assert {tuple(r) for r in simhash._listed_pairs(lists, 0.8).collect()} == {(1, 3), (2, 3)}


def test_sets_of_pairs_that_share_too_little_are_not_brought_together(spark, monkeypatch):
    """Neighbours share a tenth of their shingles, so many share one of their first."""
    random, searched, search = np.random.default_rng(41), [], simhash._searched
    monkeypatch.setattr(simhash, "_searched", lambda units, least: searched.append(units.count()) or search(units, least))
    words = [[f"w{x}" for x in random.integers(0, 1_000_000, 34)] for _ in range(401)]
    rest = lambda: [f"w{x}" for x in random.integers(0, 1_000_000, 236)]
    texts = [" ".join([*words[i], *rest(), *words[i + 1]]) for i in range(400)]
    assert similar(spark, texts) == list(range(400))
    assert len(searched) == 2 and searched[1] == 0


def test_bins_rule_out_no_similar_pair():
    random = np.random.default_rng(42)
    some = lambda n: random.integers(0, 2**64, n, np.uint64)
    alike, unlike = [], []
    for n in [*range(1, 60), 100, 127, 128, 129, 500, 512, 513, 900, 5000, 20_000]:
        a = some(n)
        for new in range(0, 1 + n // 4, max(1, n // 40)):
            for b in (a[new:], np.concatenate((a, some(new))), np.concatenate((a[new:], some(new)))):
                if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                    alike.append((simhash.binned(a), simhash.binned(b)))
        unlike.append((simhash.binned(a), simhash.binned(some(n))))
    full, empty = np.arange(2000, dtype=np.uint64), np.zeros(0, np.uint64)
    assert simhash.binned(full) == b""
    alike += [(b"", simhash.binned(some(2000))), (b"", b""), (simhash.binned(empty), simhash.binned(empty))]
    assert len(alike) > 500 and simhash.can_be_similar(*zip(*alike, strict=True), 0.8).all()
    assert simhash.can_be_similar(*zip(*unlike, strict=True), 0.8).sum() <= 2 and len(simhash.can_be_similar([], [], 0.8)) == 0


def test_similar_links_of_equal_and_tiny_sets():
    sets = [np.array(x, np.uint64) for x in ([1], [1], [2], [1, 2, 3, 4], [1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11])]
    assert simhash.verified_links(np.zeros(6, np.uint64), sets, 0, 0.8) == [(0, 1), (3, 4)]
    assert simhash.verified_links(np.zeros(6, np.uint64), sets, 0, 0.8, np.array([1, 1, 2, 3, 4, 5])) == [(3, 4)]
    assert simhash.verified_links(np.zeros(6, np.uint64), sets, 4, 0.8) == [(3, 4)]


def test_no_similar_pair_is_lost_at_a_larger_scale(spark):
    """All pairs of the documents of sf0.01, by an inverted index."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    pairs = near_pairs(texts)
    found = similar(spark, texts)
    assert len(pairs) >= 50 and found == least_of_groups(len(texts), pairs)


def test_different_texts_of_one_fingerprint(spark):
    """A word repeated often settles all bits, whatever else the text says."""
    random = np.random.default_rng(6)
    texts = [" ".join(["spam"] * 300 + [f"w{x}" for x in random.integers(0, 1_000_000, 150)]) for _ in range(3)]
    texts += [texts[0], texts[1] + " tail", texts[2].upper(), "", None, "  "]
    assert len({simhash.fingerprint(t, 5) for t in texts[:6]}) == 1
    assert similar(spark, texts) == [0, 1, 2, 0, 1, 2, 6, 6, 6]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).count() == 4


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = [r["doc_id"] for r in before if not any(tuple(w[i : i + 10]) in windows for w in [words(r["text"])] for i in range(len(w) - 9))]
    assert ids(after) == Counter(clean) and 10_004 not in ids(after)


def test_mixing(stages):
    before, after = stages["mixing"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 2
    size = lambda r: len(r["text"].split())
    whole, mixed, largest = Counter(), Counter(), Counter()
    for r in before:
        whole[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in after:
        mixed[r["source"]] += size(r)
    names = sorted(whole, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(whole.values()), set(names)
    while over := [s for s in free if left / sum(weight[x] for x in free) * weight[s] > 2 * whole[s]]:
        for s in over:
            target[s] = 2 * whole[s]
            free.remove(s)
        left = 1.5 * sum(whole.values()) - sum(target.values())
    target |= {s: left / sum(weight[x] for x in free) * weight[s] for s in free}
    assert all(abs(mixed[s] - target[s]) <= largest[s] / 2 + 1 for s in names)


def test_sharding(stages):
    before, after = stages["sharding"]
    assert ids(before) == ids(after)
    groups, placed, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in after:
        groups[hashlib.sha256(r["text"].encode()).digest()] += len(r["text"].encode()) + 1
        placed[r["text"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in placed.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes, shards = Counter(), {hashlib.sha256(t.encode()).digest(): min(s) for t, s in placed.items()}
    for h, n in groups.items():
        sizes[shards[h]] += n

    def fits(capacity):
        used, now = 1, 0
        for _, n in sorted(groups.items()):
            if now + n > capacity:
                used, now = used + 1, 0
            now += n
        return used <= 16

    assert fits(max(sizes.values())) and not (max(sizes.values()) > max(groups.values()) and fits(max(sizes.values()) - 1))


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*corpus_pipeline.COLUMNS, "shard", "slot"] and out.filter(F.col("shard").between(0, 15)).count() == out.count() > 100


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, row long, node string, size int, key string, hash string, shard int, slot int, unit int, taken long, score double, lang_pred string, key1 long, key2 long, n_words long, hits int, bin int, check string, part int, _text string, component_id long, first_row long"
STAGES = dict(corpus_pipeline.STAGES)


def edge_rows():
    long = " ".join(f"the house number {i} and water of {i % 91}" for i in range(20_000))
    item = "one two three"
    base = [
        (1, None, "en", "a", None), (None, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", None, None, 0), (4, long, "en", "a", 1), (5, long + " tail", "en", "b", 1), (None, "no id here but the words of a text", "en", None, 3),
        (6, "the house and the water of the town", "en", "a", 2), (6, "the house and the water of the town", "en", "a", 2), (7, "the house and the water of the town", "en", "a", 2), (8, f"here {item} there", "en", "b", 2), (9, "½ ² ①", "en", "b", 2),
    ]
    return [(*r, *([None if t.endswith("string") else 1.0 if t.endswith("double") else 1 for t in CLASHING.split(", ")[5:]])) for r in base]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    path = tmp_path_factory.mktemp("edges")
    for name, rows in (("documents", edge_rows()), ("empty", [])):
        spark.createDataFrame(rows, CLASHING).repartition(3).write.parquet(f"{path}/{name}.parquet")
    spark.createDataFrame([(1, "one two three"), (None, "four five"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(6, 1, 0), (None, 1, 0), (5, None, None), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_of_an_empty_table(spark, edges, name):
    out = STAGES[name](spark, spark.read.parquet(f"{edges}/empty.parquet"), edges)
    assert out.collect() == [] and set(out.columns) - {"shard", "slot"} == set(corpus_pipeline.COLUMNS)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_at_the_edges(spark, edges, name):
    rows = [r[:5] for r in edge_rows()]
    out = STAGES[name](spark, spark.read.parquet(f"{edges}/documents.parquet"), edges)
    assert [c for c in out.columns if c not in ("shard", "slot")] == list(corpus_pipeline.COLUMNS)
    got = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in out.collect()]
    kept, given = Counter(got), Counter(rows)
    assert all(r in given for r in kept)
    if name == "language":  # only English is learned
        assert kept == Counter(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    if name == "near_duplicates":
        assert sorted(str(r[0]) for r in got) == ["1", "4", "6", "8", "9", "None"]
        assert sum(r[1] is not None and "no id" in r[1] for r in got) == 1
    if name == "decontamination":
        assert kept == Counter(r for r in rows if r[0] != 8)
    if name == "mixing":
        assert all((r[1] or "").split() for r in got) and all(n <= 2 * given[r] for r, n in kept.items())
    if name == "sharding":
        assert kept == given


def test_the_pipeline_leaves_nothing_but_its_result(spark, edges, tmp_path, monkeypatch):
    count = iter(range(1000))
    monkeypatch.setattr(common, "shared_folder", lambda spark, name: f"{tmp_path.as_uri()}/{name}-{next(count)}")
    out = corpus_pipeline.run(spark, edges)
    assert [x.name.partition("-")[2].rpartition("-")[0] for x in tmp_path.iterdir()] == ["sharding"] and out.count() > 0
