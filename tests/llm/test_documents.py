"""Operators on whole texts against brute force, and their edge cases."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempotrail.llm import exact_dedup, language, lattice_lm, mixing, sanitise, sharding, simhash, substring, warc, winnowing
from tempotrail.llm.common import noted

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, rows int, id int, check string, hash string, key string"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "the quick brown fox jumps over the lazy dog"), (6, "the quick brown fox jumps over the lazy dog"), (7, LONG), (8, LONG + " tail"),
    (9, f"lead in {PASSAGE} and out"), (10, f"{PASSAGE} again {PASSAGE}"), (11, "A b C d e f g h i j k l m n o p q r s t u v w x y z " * 3), (None, "no id at all here"), (12, "é ü ñ ö  å"), (5, "the quick brown fox jumps over the lazy dog"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents table with nulls, repeats, a very long text and columns whose names clash with inner ones."""
    path = tmp_path_factory.mktemp("docs")
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None, n, "r", 3, n, "c", "h", "k") for n, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/empty/documents.parquet")
    for sub in ("", "/empty"):
        spark.createDataFrame([(5, 1, 0), (5, None, 0), (None, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}{sub}/labels.parquet")
        items = [(1, " ".join(PASSAGE.split()[5:40])), (2, "QUICK brown fox"), (3, ""), (4, None), (2, "nowhere to be found at all in any of the texts here"), (None, "lazy dog"), (5, "one"), (6, "over the lazy dog"), (7, "a b c d e f g h i")]
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}{sub}/benchmark.parquet")
        pages = [(1, "http://a/ b\n", "x" * 1500), (2, None, "x" * 1500), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", "x" * 1500), (6, "u", "é" * 700), (2, None, "x" * 1500)]
        spark.createDataFrame(pages if not sub else [], "page_id long, url string, html string").write.parquet(f"{path}{sub}/pages.parquet")
    return str(path)


def collected(df):
    return [r.asDict() for r in df.collect()]


OPS = [exact_dedup.op1_exact_dedup, warc.op2_warc, simhash.op3_simhash, mixing.op4_mixing, lattice_lm.op5_lattice_lm, sanitise.op6_sanitise, winnowing.op7_winnowing, sharding.op8_sharding, language.op9_language, substring.op10_substring]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_empty_table(spark, folder, op):
    assert collected(op(spark, f"{folder}/empty")) == []


def test_exact(spark, folder):
    out = collected(exact_dedup.op1_exact_dedup(spark, folder))
    assert len(out) == len(TEXTS)
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    for r in out:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in out) == len(groups)


def test_exact_compares_bytes(spark, folder):
    """A digest of one letter collides everywhere; contents still decide."""
    weak = collected(exact_dedup.exact_dedup(spark, folder, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("binary")))
    strong = collected(exact_dedup.exact_dedup(spark, folder))
    row = lambda r: (str(r["id"]), r["content_sha256"], str(r["keep_id"]), r["group_size"], r["kept"])
    assert sorted(map(row, weak)) == sorted(map(row, strong))


def test_exact_goes_on_from_its_state(spark, folder, tmp_path):
    data, state = tmp_path / "d" / "documents.parquet", (tmp_path / "state").as_uri()
    for part in range(2):
        spark.createDataFrame([(part, "same"), (10 + part, f"own {part}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(data))
        exact_dedup.update_state(spark, str(tmp_path / "d"), "documents.parquet", state)
    got = {r["n"]: r["locator"]["id"] for r in exact_dedup.read_state(spark, state).collect()}
    assert got[2] == 1


def test_warc(spark, folder):
    out = {(r["page_id"], r["record_type"]): r for r in collected(warc.op2_warc(spark, folder))}
    assert out[1, "revisit"]["refers_to"] == 2 and out[2, "response"]["refers_to"] is None and out[None, "revisit"]["refers_to"] == 2
    assert out[3, "response"] and out[4, "response"] and out[5, "response"]["payload_bytes"] == 0
    assert out[6, "response"]["payload_bytes"] == 1400 and out[1, "revisit"]["payload_digest"] == hashlib.sha1(b"x" * 1500).hexdigest()


def test_warc_frames_and_lookup(spark, folder, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (i % 50 + 1)) for i in range(300)], "page_id long, url string, html string").repartition(2)
    index = warc.write_archive(warc.classify(pages), (tmp_path / "w").as_uri(), frame_bytes=4000, bundle_bytes=3000)
    assert index.select("bundle").distinct().count() > 2 and index.agg(F.max("frame")).first()[0] > 0
    assert sorted(r["payload"].decode() for r in collected(warc.read_archive(index))) == sorted(f"page {i} " * (i % 50 + 1) for i in range(300))
    some = warc.lookup(index, spark.createDataFrame([("<urn:page:7>",), ("<urn:page:299>",), ("<urn:page:7>",)], "record_id string"))
    assert sorted(r["record_id"] for r in collected(some)) == ["<urn:page:299>", "<urn:page:7>"]


def brute_fingerprint(text, k=4):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(values, k):
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= k:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash(spark, folder):
    out = collected(simhash.op3_simhash(spark, folder))
    prints = [brute_fingerprint(t) for _, t in TEXTS]
    groups = brute_components(prints, 4)
    least = {g: min((i for (i, _), h in zip(TEXTS, groups, strict=True) if h == g and i is not None), default=None) for g in groups}
    want = sorted((str(i), f"{p:016x}", str(least[g])) for (i, _), p, g in zip(TEXTS, prints, groups, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out) == want


@pytest.mark.parametrize(("k", "r_bits", "chunk"), [(4, 256, 8192), (4, 1, 20), (10, 4, 50)])
def test_trie_joins(spark, monkeypatch, k, r_bits, chunk):
    """Dense clusters and lone values, with small buckets and with buckets cut into chunks."""
    monkeypatch.setattr(simhash, "MEAN_BUCKET", r_bits)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 2**63, 60, np.uint64)]
    for centre in values[:3]:
        for _ in range(40):
            v = centre
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    links = simhash.near_links(df, k)
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for v, g in zip(values, brute_components(values, k), strict=True):
        want[g].add(signed[v])
        got[roots.get(signed[v], signed[v])].add(signed[v])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert links.count() < len(values) * 60


def test_mixing(spark, folder):
    out = collected(mixing.op4_mixing(spark, folder))
    again = collected(mixing.op4_mixing(spark, folder))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(TEXTS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["source_size"], r["target"]].append(r)
    for (size, target), rows in by.items():
        assert sum(r["size"] for r in rows) == size and abs(sum(r["taken"] for r in rows) - target) <= 1
    sizes = spark.createDataFrame([("a", 100), ("b", 100), (None, 100), ("B", 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights B 3, a 1, b 2, null 3: the small three stop at 200 each, and B gets what is left of 1950
    assert got == pytest.approx({"B": 1350.0, "a": 200.0, "b": 200.0, None: 200.0})


def test_mixing_takes_documents_in_the_order_of_their_keys(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, "w " * int(rng.integers(0, 30)), "ab"[i % 3 > 0], [0.5, 1.0, 2.0][i % 5 % 3]) for i in range(3000)], "doc_id long, text string, source string, weight double")
    rows = mixing.sized(docs, "weight").withColumn("key", mixing.sampling_key(F.col("identity"), F.col("weight"), 7)).collect()
    out = {r["doc_id"]: r for r in mixing.mix(mixing.sized(docs, "weight"), F.col("weight")).collect()}
    for source in "ab":
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["key"], r["doc_id"]))
        target, whole = out[own[0]["doc_id"]]["target"], sum(r["size"] for r in own)
        epochs = int(target // whole)
        room = round(target - epochs * whole)
        for r in own:
            part = max(0, min(r["size"], room))
            assert out[r["doc_id"]]["taken"] == epochs * r["size"] + part
            room -= r["size"]
    # -ln(u) / w is exponential with rate w
    keys = {w: np.mean([r["key"] for r in rows if r["weight"] == w]) for w in (0.5, 1.0, 2.0)}
    assert all(keys[w] == pytest.approx(1 / w, rel=0.12) for w in keys)


def test_whole_documents_only(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "s") for i in range(200)], "doc_id long, text string, source string")
    out = collected(mixing.mix(mixing.sized(docs), cut=False))
    assert all(r["taken"] in (r["size"], 2 * r["size"]) for r in out) and abs(sum(r["taken"] for r in out) - out[0]["target"]) <= 4


def test_lattice(spark, folder):
    lattice = lattice_lm.Lattice({"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -2.2, "▁a": -0.7, "▁ab": -3.0}, -4.0)

    def brute(text):
        if not text:
            return 1.0
        total = sum(math.exp(p) * brute(text[len(s) :]) for s, p in lattice.pieces.items() if text.startswith(s))
        return total + (math.exp(lattice.byte * len(text[0].encode())) * brute(text[1:]) if text[0] not in lattice.pieces else 0)

    for word in ("", "ab", "aabba", "aéb", "bbbb"):
        assert lattice.word(word) == pytest.approx(math.log(brute("▁" + word)))
    out = collected(lattice_lm.op5_lattice_lm(spark, folder))
    tokens = lambda t: [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t in TEXTS if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == want
    assert all(r["train_tokens"] == n for r in out)
    whole = lattice_lm.Lattice.load()

    def probability(word):
        """Summed over segmentations, without logarithms."""
        text, upto = "▁" + word, [1.0]
        for end in range(1, len(text) + 1):
            arcs = sum(upto[a] * math.exp(whole.pieces[text[a:end]]) for a in range(max(0, end - whole.longest), end) if text[a:end] in whole.pieces)
            upto.append(arcs + (math.exp(whole.byte * len(text[end - 1].encode())) * upto[end - 1] if text[end - 1] not in whole.pieces else 0))
        return upto[-1]

    score = {w: math.log10((c[w] + v * probability(w)) / (n + v)) for w in {w for _, t in TEXTS for w in tokens(t)}}
    want = sorted((str(i), len(tokens(t)), round(sum(score[w] for w in tokens(t)), 3)) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 3)) for r in out) == want


def test_lattice_scores_of_words_outside_the_head(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("held_out")).filter("doc_id is not null")
    few, all_words = (lattice_lm.score(docs, head_words=n).collect() for n in (3, 100_000))
    row = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
    assert sorted(map(row, few)) == sorted(map(row, all_words))


def test_frequent_words_have_a_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + 1000 // (i + 1)) for i in range(500)], "word string, n long")
    top = lattice_lm.frequent(counts, 50).collect()
    assert 0 < len(top) <= 50 and min(r["n"] for r in top) >= 1000 // 51


PII = "mail a.b+c@x-y.example.org, 1.2.3.4 or 999.1.1.1 or 1.2.3.4.5.6.7.8, card 4111 1111 1111 1111 not 4111 1111 1111 1112, +46 (0)70-123 45 67 @ no@dot x@y..z +1"


def test_personal_data(spark):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and sanitise._luhn(re.sub(r"\D", "", m)), "phone": lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15}
    rng = np.random.default_rng(3)
    parts = [PII, "a@b.c", "+4670", "1.2.3", "5500005555555559", "x" * 300, "@@", "0 1-2", ".", "-", "a.b@", "é7", "+1(2)3 4 5 6 7 8 9 0 1"]
    for _ in range(200):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "-", "."]) for _ in range(8))
        want = sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(base.items()) for m in re.finditer(p, text) if good[name](m[0]))
        assert sanitise.base_spans(text) == want
    assert sanitise.sanitised("x a@b.c y", [{"start": 2, "kind": 0, "end": 7}], [{"start": 8, "end": 9, "label": ""}]) == "x [EMAIL] " and sanitise.sanitised(None, [], None) is None


def test_long_runs_are_linear():
    assert sanitise.base_spans("a" * 200_000 + "@" + "1" * 200_000 + " " + "+1" + "(" * 100_000) == []


@pytest.mark.parametrize("few", [0, 1000])
def test_revealing_terms(spark, monkeypatch, few):
    monkeypatch.setattr(sanitise, "BROADCAST_TERMS", few)
    monkeypatch.setattr(sanitise, "HASHED_TERMS", few)
    monkeypatch.setattr(sanitise, "BROADCAST_COPIES", few)
    rows = [(i, f"filler{i} words here Zebulon Quark ann@example.org tail{i}") for i in range(5)] + [(10 + i, f"other{i} words here and there") for i in range(40)] + [(100, None), (101, "Zebulon alone")]
    out = {r["doc_id"]: r for r in sanitise.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = lambda r, t: [t[s["start"] : s["end"]] for s in r["terms"] or ()]
    assert terms(out[0], rows[0][1]) == ["Zebulon", "Quark"] and not out[10]["terms"] and not out[101]["terms"]


@pytest.mark.parametrize("few", [0, 1000])
def test_revealing_terms_far_from_the_entity(spark, monkeypatch, few):
    monkeypatch.setattr(sanitise, "BROADCAST_TERMS", few)
    monkeypatch.setattr(sanitise, "HASHED_TERMS", few)
    monkeypatch.setattr(sanitise, "BROADCAST_COPIES", few)
    far = lambda i: " ".join(f"filler{i}x{j}" for j in range(60))
    rows = [(i, f"Zebulon {far(i)} ann@example.org {far(i + 50)} zebulon") for i in range(5)] + [(10 + i, f"other{i} words") for i in range(40)] + [(60, "no address")]
    out = {r["doc_id"]: r for r in sanitise.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:5]:
        assert [text[s["start"] : s["end"]] for s in out[i]["terms"]] == ["Zebulon", "zebulon"]
    assert not any(out[i]["terms"] for i, _ in rows[5:])


def brute_terms(texts):
    """Places of revealing terms by text: all levels of entities, all counts over different texts."""
    found, words = {}, {t: {m.lower() for m in re.findall(r"[^\W\d_][\w'-]{2,}", t)} for t in set(texts)}
    for t in words:
        for start, k, end in sanitise.base_spans(t):
            v = t[start:end].lower() if k < 2 else re.sub("[^0-9]", "", t[start:end])
            short = [v.rpartition("@")[2], ".".join(v.split(".")[:2]), v[:6], v[:4]][k]
            for level, e in enumerate((v, short, "")):
                found.setdefault((k, level, e), set()).add(t)
    out = {}
    for t in words:
        spans = [(a, b) for a, _, b in sanitise.base_spans(t)]
        for m in re.finditer(r"[^\W\d_][\w'-]{2,}", "".join(" " if any(a <= i < b for a, b in spans) else c for i, c in enumerate(t))):
            term, labels = m[0].lower(), []
            for (k, level, _), holders in found.items():
                free = [h for h in holders if term in {x for x, _, _ in sanitise.free_terms(h, sanitise.base_spans(h))}]
                if t not in holders or len(holders) < 2 or len(free) < 2:
                    continue
                information = math.log(len(words) / len(holders))
                if information > 0 and math.log(len(free) / sum(term in w for w in words.values()) / (len(holders) / len(words))) >= 0.9 * information - 1e-12:
                    labels.append(f"[{sanitise.KINDS[k].upper()}]" if level < 2 else "")
            if labels:
                out.setdefault(t, []).append((m.start(), m.end(), max(labels)))
    return out


@pytest.mark.parametrize("few", [0, 1000])
def test_all_columns_of_personal_data(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(sanitise, "BROADCAST_TERMS", few)
    monkeypatch.setattr(sanitise, "HASHED_TERMS", few)
    monkeypatch.setattr(sanitise, "BROADCAST_COPIES", few)
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    # what stands beside a value: a term of its own, one that its prefix shares, one that its kind shares, or none
    data = {"ann@one.example": "Annika Onedom Mailing", "bob@one.example": "Onedom Mailing", "eve@two.example": "Mailing", "10.1.2.3": "Netten", "10.1.9.9": "Netten", "4111 1111 1111 1111": "", "+46 70 123 45 67": "Ringer", "+46 71 000 00 00": ""}
    texts = [" ".join([*rng.choice(words, 9), *((d := str(rng.choice(list(data)))), data[d]) * (i % 2), *rng.choice(words, 3)]) for i in range(160)]
    texts = [(i, t) for i, t in enumerate([*texts, *texts[:10], None, "", texts[0]])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, places = [], brute_terms([t or "" for _, t in texts])
    assert {x for p in places.values() for *_, x in p} >= {"[EMAIL]", "[IP]", "[PHONE]", ""}
    for i, t in texts:
        base = sanitise.base_spans(t or "")
        name = lambda s, kinds: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(s))
        every = [*base, *((a, 4, b) for a, b, _ in places.get(t, ()))]
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(name(base, sanitise.KINDS).encode()).hexdigest(), name(every, [*sanitise.KINDS, "term"])))
    out = sanitise.op6_sanitise(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) for r in out) == want
    cleaned = {r["doc_id"]: r["text"] for r in sanitise.sanitise(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    as_rows = lambda t: ([{"start": a, "kind": k, "end": b} for a, k, b in sanitise.base_spans(t)], [{"start": a, "end": b, "label": x} for a, b, x in places.get(t, ())])
    assert cleaned == {i: t if t is None else sanitise.sanitised(t, *as_rows(t)) for i, t in texts}


def test_copies_give_no_support(spark):
    rows = [(i, "Zebulon Quark ann@example.org") for i in range(9)] + [(20 + i, f"other{i}") for i in range(9)]
    assert all(not r["terms"] for r in sanitise.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect())


@pytest.mark.parametrize("few", [0, 200_000])
def test_winnowing(spark, folder, monkeypatch, few):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", few)
    out = collected(winnowing.op7_winnowing(spark, folder))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = []
    for i, t in TEXTS:
        w, hit, ids = words(t), set(), set()
        for item, v in items:
            n = min(len(v), 10)
            windows = {tuple(v[a : a + n]) for a in range(max(0, len(v) - n + 1))} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    ids.add(item)
        want.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(str(x) for x in ids if x is not None)).encode()).hexdigest(), bool(hit)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out) == sorted(want)


def test_sharding(spark, folder):
    docs = spark.createDataFrame([(i, ["hot", None, f"text {i}", "b" * (i % 40)][i % 4]) for i in range(4000)], "doc_id long, text string")
    for source, rows in ((docs, [tuple(r) for r in docs.collect()]), (spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), TEXTS)):
        out = collected(sharding.shard(source))
        assert len(out) == len(rows)
        slots, shard_of, sizes = defaultdict(list), defaultdict(set), Counter()
        by_id = defaultdict(list)
        for i, t in rows:
            by_id[i].append(t or "")
        for r in out:
            slots[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += r["size"]
            text = next(t for t in by_id[r["doc_id"]] if zlib.crc32(t.encode()) == r["text_crc32"])
            assert r["size"] == len(text.encode()) + 1
            shard_of[text].add(r["shard"])
        assert all(len(s) == 1 for s in shard_of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
        groups = Counter()
        for _, t in rows:
            groups[hashlib.sha256((t or "").encode()).digest()] += len((t or "").encode()) + 1
        ordered = [n for _, n in sorted(groups.items())]
        assert max(sizes.values()) == least_capacity(ordered, 16)


def test_a_hot_group_without_ids_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 16)
    monkeypatch.setattr(sharding, "JOINT_PARTS", 8)
    docs = spark.createDataFrame([(None if i % 2 else 1, "hot") for i in range(3000)] + [(i, f"t{i}") for i in range(50)], "doc_id long, text string").repartition(4)
    out = collected(sharding.shard(docs))
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 3050 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def least_capacity(sizes, shards):
    def fits(c):
        used, now = 1, 0
        for x in sizes:
            if now + x > c:
                used, now = used + 1, 0
            now += x
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_search_for_capacity():
    import random

    rng = random.Random(5)
    for _ in range(120):
        sizes = [rng.choice([1, rng.randint(1, 1000), rng.randint(1, 20)]) for _ in range(rng.choice([1, 2, 50, 2000]))]
        upto, k = np.cumsum(sizes), rng.choice([2, 7, 16])

        def inside(spans, upto=upto):
            return [u for u in upto.tolist() if any(a <= u <= b for a, b in spans)]

        def summed(spans, width, inside=inside):
            steps = defaultdict(list)
            for u in inside(spans):
                steps[u // width].append(u)
            return [(min(x), max(x), len(x)) for x in steps.values()]

        capacity, ends = sharding.search(int(upto[-1]), max(sizes), k, summed, inside, 64, rng.choice([5, 100]))
        assert capacity == least_capacity(sizes, k) and ends[-1] == upto[-1]


def test_language(spark, folder):
    docs = [(i, " ".join(np.random.default_rng(i).choice(["the", "and", "house", "water"] if i % 2 else ["und", "das", "haus", "wasser"], 12)), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame([*docs, (900, None, "en"), (901, "12 34 !", "de"), (902, "hauswasserung", None)], "doc_id long, text string, lang string")
    model = language.fit(df, language.fold(F.col("doc_id")) != 0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df.select("doc_id", "text"), model).collect()}
    assert all(got[i][0] == lang for i, _, lang in docs) and got[900] == ("und", 0.0) and got[901] == ("und", 0.0) and got[902][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    learn = [("en", t) for n, (i, t) in enumerate(TEXTS) if n % 5 and zlib.crc32(b"" if i is None else str(i).encode()) % 5]
    want = brute_language(learn, [t for _, t in TEXTS])
    out = collected(language.op9_language(spark, folder))
    assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in out) == sorted((str(i), *w) for (i, _), w in zip(TEXTS, want, strict=True))
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def brute_language(learned, texts):
    """Predictions from learned (lang, text) by the definition, word for word."""
    langs = sorted({lang for lang, _ in learned})
    words = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    grams = lambda w, k: [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]

    def logs(items):
        counts = {lang: Counter(x for of, t in learned if of == lang for w in words(t) for x in items(w)) for lang in langs}
        different = len(set().union(*counts.values()))
        return {x: [math.log((counts[lang][x] + 0.5) / (counts[lang].total() + 0.5 * (different + 1))) for lang in langs] for x in set().union(*counts.values())}

    known, parts = logs(lambda w: [w]), {k: logs(lambda w, k=k: grams(w, k)) for k in range(1, 6)}

    def of(word):
        if word in known:
            return known[word]
        for k in range(5, 0, -1):
            if found := [parts[k][g] for g in grams(word, k) if g in parts[k]]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    prior = [math.log(sum(x == lang for x, _ in learned) / len(learned)) for lang in langs]
    out = []
    for t in texts:
        w = words(t)
        if not w:
            out.append(("und", 0.0))
            continue
        sums = [sum(of(x)[i] for x in w) for i in range(len(langs))]
        best = max(range(len(langs)), key=lambda i: (sums[i] + prior[i], -i))
        sharp = [p + s * min(1, 20 / len(w)) for p, s in zip(prior, sums, strict=True)]
        out.append((langs[best], round(1 / sum(math.exp(s - sharp[best]) for s in sharp), 6)))
    return out


@pytest.mark.parametrize("cells", [4_000_000, 50])
def test_language_by_its_definition(spark, monkeypatch, cells):
    monkeypatch.setattr(language, "_CELLS", cells)
    rng = np.random.default_rng(2)
    vocabulary = {"en": ["the", "and", "house", "water", "street"], "de": ["und", "das", "haus", "wasser", "straße"], "sv": ["och", "det", "hus", "vatten", "gata"], "xx": ["𐌰𐌱", "ł"]}
    docs = [(i, " ".join([*rng.choice(vocabulary[lang], int(rng.integers(1, 40))), *(["unsehen", "housewater", "ég1x"] if i % 7 == 0 else [])]), lang) for i, lang in enumerate(rng.choice(list(vocabulary), 120))]
    docs += [(200, None, "en"), (201, "½ ² ① Ⅷ _ 12", None), (202, "½a", None), (203, "日本", None), (204, "hus " * 9000, None)]
    df = spark.createDataFrame([(i, t, None if lang is None else str(lang)) for i, t, lang in docs], "doc_id long, text string, lang string")
    learn = [(lang, t) for i, t, lang in docs if lang and zlib.crc32(str(i).encode()) % 5]
    model = language.fit(df, language.fold(F.col("doc_id")) != 0)
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language.identify(df.select("doc_id", "text"), model).collect()}
    assert [got[i] for i, _, _ in docs] == brute_language(learn, [t for _, t, _ in docs])
    assert got[201] == ("und", 0.0) and got[202][0] != "und"


def test_language_holds_the_words_of_a_part_of_a_batch():
    rng = np.random.default_rng(3)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (400_000, 8))]
    texts = [None, "", *(" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)), "½"]
    model = language.Model({"x": dict.fromkeys(words[:500], 2), "y": dict.fromkeys(words[300:900], 3)}, {"x": 4, "y": 5})
    tracemalloc.start()
    langs, scores = model.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # all words of these 3.6 million characters take over 60 MB
    at = [0, 1, 2, 150, 401, 402]
    assert [model.predict([texts[i]])[0][0] for i in at] == [langs[i] for i in at] and [model.predict([texts[i]])[1][0] for i in at] == [scores[i] for i in at]
    assert model.predict([])[0] == [] and len(langs) == len(scores) == len(texts)


def test_language_samples_have_a_bound(spark):
    df = spark.createDataFrame([(i, f"{''.join(chr(97 + int(d)) for d in str(10_000 + i))} same", f"l{i % 30}") for i in range(3000)], "doc_id long, text string, lang string")
    every = language.fit(df, F.lit(True))
    few = language.fit(df, F.lit(True), sample=300)
    fewer = language.fit(df, F.lit(True), words=60)
    assert len(every.langs) == len(few.langs) == len(fewer.langs) == 30
    entries = lambda m: len(m.words.lang)
    assert entries(few) < entries(every) / 3 and entries(fewer) <= 60


def test_language_held_out(spark):
    rows = language.op9_language(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def brute_repeats(docs, window=20):
    first, out = {}, []
    words = [(i, t.split() if t else []) for i, t in docs]
    key = lambda i, s: (math.inf if i is None else i, s)
    for i, w in words:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, (math.inf, math.inf)), key(i, s))
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < key(i, s):
                gone |= set(range(s, s + window))
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("few", [0, 200_000])
def test_substring(spark, folder, monkeypatch, few):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", few)
    out = collected(substring.op10_substring(spark, folder))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_repeats(TEXTS)


def test_substring_of_the_largest_id_and_of_repeated_rows(spark):
    last = 2**63 - 1
    docs = [(last, PASSAGE), (None, "lead " + PASSAGE), (1, "x y " + PASSAGE), (last, PASSAGE), (None, "lead " + PASSAGE)]
    out = collected(substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    assert sorted((str(r["id"]), r["n_removed"]) for r in out) == [("1", 0), (str(last), 60), (str(last), 60), ("None", 60), ("None", 60)]


def test_substring_at_every_alignment(spark, monkeypatch):
    """Shared passages at all offsets, a phrase with many continuations, and full filters."""
    monkeypatch.setattr(substring, "TASK_WINDOWS", 500)
    rng = np.random.default_rng(7)
    word = lambda: f"v{rng.integers(0, 10**6)}"
    shared, phrase = [word() for _ in range(45)], [word() for _ in range(12)]
    docs = []
    for i in range(60):
        lead = [word() for _ in range(i % 23)]
        docs.append((i * 3 % 61, " ".join(lead + (shared[i % 20 :] if i % 2 else phrase) + [word() for _ in range(15)] + phrase + shared[: 20 + i % 25])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for most in (1 << 30, 1 << 16):
        monkeypatch.setattr(substring, "MOST_BITS", most)
        out = collected(substring.remove_repeats(df))
        assert sorted((str(r["id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out) == brute_repeats(docs)


@pytest.mark.parametrize("most", [0, 1 << 26])
def test_substring_stores_no_small_filter(spark, folder, monkeypatch, most):
    """Large filters pass through a stored table, small ones come to the driver as they are."""
    monkeypatch.setattr(substring, "COLLECT_BITS", most)
    with noted() as paths:
        out = collected(substring.op10_substring(spark, folder))
    assert any("anchor-filters" in p for p in paths) == (not most)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == brute_repeats(TEXTS)


def test_substring_holds_a_task_s_windows_once():
    rng, n = np.random.default_rng(3), 200_000
    hashes = lambda: rng.integers(0, 2**63, n).astype(np.uint64)
    tracemalloc.start()
    parts = [(np.concatenate([a := hashes(), a[:1000]]), np.concatenate([b := hashes(), b[:1000]]), np.full(n + 1000, i, np.int32), np.arange(n + 1000, dtype=np.int32)) for i in range(5)]
    del a, b
    frames = substring.packed_rows(parts, {(i, i): None for i in range(5)}, 50)
    late = next(frames)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rest = list(frames)
    assert not parts and peak < 95e6  # 74 MB; 118 where parts and sorted hashes stay
    assert sum(len(x) for x in late["start"]) == 4 * 5000 and sum(len(x) for f in rest for x in f["start"]) == 4 * 5 * n


@pytest.mark.parametrize("op", [winnowing.op7_winnowing, sharding.op8_sharding], ids=lambda f: f.__name__)
def test_native(spark, folder, op):
    assert not re.search("Python|Pandas|Arrow", op(spark, folder)._jdf.queryExecution().executedPlan().toString())
