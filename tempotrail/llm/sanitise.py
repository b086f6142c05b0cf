"""Personal data, and terms that give it away.

Base spans are the e-mail addresses, IP addresses, card and phone numbers in a text.  The method adds terms:
the corpus tells how strongly a term reveals a protected entity.  Entities have three levels, all taken from the
spans themselves: a value, its prefix (an address's domain, an IP address's first two parts, a card's first six
and a phone's first four digits), and the kind.  With p(e) the share of texts that hold the entity and p(e|t)
its share among the texts with the term, the entity carries -log p(e) of information, and the term reveals
PMI = log p(e|t) / p(e) of it.  A term that stands with an entity in several different texts and reveals at
least THRESHOLD of its information is sanitised wherever it stands in the texts that hold the entity: it is
generalised to the kind where it reveals a value or prefix, and removed where it reveals the kind itself.

Texts count once however many copies there are (by a hash of the text): of copies the row read first counts.
Terms are looked for in the whole text, of the texts with an entity that enough different texts hold, first the
terms by themselves, then the pairs of those that enough such texts hold.  Frequencies in all texts are counted
only for the terms of pairs that can still pass.  Each task adds up its own texts before it sends counts, and knows
the terms that are wanted by their hashes, up to HASHED_TERMS; beyond that all terms are sent.

Defined cases: a null text counts as empty; spans that fail their check are dropped without another try; spans
of different kinds may overlap, terms don't overlap base spans; a term that reveals entities of several kinds is
generalised to the last kind by name; very long texts are read whole and in linear time; repeated rows get equal
results; a null id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.llm.common import bounded_batches, sliced, small, stored, tidied

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LEAST_TEXTS, THRESHOLD = 2, 0.9
#: Digits of a prefix by the kind's index.
PREFIX_DIGITS = {2: 6, 3: 4}
#: Rows of other tables that are broadcast at most.
BROADCAST_TERMS = 200_000
#: Copies (their row numbers) that go to every task at most; beyond it, a shuffled join.
BROADCAST_COPIES = 4_000_000
#: Terms whose hashes (8 bytes) go to every task at most, and counts that a task holds.
HASHED_TERMS, _HELD_COUNTS = 16_000_000, 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match always starts a run of digits, so no others are tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_][\w'-]{2,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards; the local part goes back to the last match or another character."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        at = text.find("@", found.end() if found else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdecimal, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def prefix(kind: int, value: str) -> str:
    """The coarser level of a value: domain, network, first digits."""
    if kind == 0:
        return value.rpartition("@")[2]
    return ".".join(value.split(".")[:2]) if kind == 1 else value[: PREFIX_DIGITS[kind]]


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """kind:value, kind~prefix and kind of the spans."""
    values = [(kind, text[start:end].lower() if kind < 2 else re.sub(r"[^0-9]", "", text[start:end])) for start, kind, end in spans]
    return sorted({e for kind, value in values for e in (f"{KINDS[kind]}:{value}", f"{KINDS[kind]}~{prefix(kind, value)}", KINDS[kind])})


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that lie in no span."""
    at = 0
    for start, end in [*((a, b) for a, _, b in spans), (len(text), len(text))]:
        if start > at:
            yield from ((m[0].lower(), m.start(), m.end()) for m in _TERM.finditer(text, at, start))
        at = max(at, end)


def terms_of(text: str) -> set[str]:
    return {m.lower() for m in _TERM.findall(text)}


FOUND = "row long, check long, text string, base array<struct<start:int,kind:int,end:int>>, entities array<string>"


def _found(docs: DataFrame) -> DataFrame:
    """The rows with base spans and entities; the text stays only with those that have some."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = base_spans(text or "")
                rows.append((text if spans else None, [{"start": a, "kind": k, "end": b} for a, k, b in spans], entities(text or "", spans)))
            out = pd.DataFrame(rows, columns=["text", "base", "entities"])
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), out], axis=1)

    bounded_batches(docs.sparkSession)
    return docs.mapInPandas(find, f"doc_id long, {FOUND}")


def _small_side(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast where it is small enough."""
    return F.broadcast(df) if small(df, BROADCAST_TERMS) else df


def _hashes(values: DataFrame) -> np.ndarray | None:
    """The sorted hashes of values (the only column) that are few enough to go to every task."""
    if not small(values, HASHED_TERMS):
        return None
    return np.sort(values.select(F.xxhash64(values.columns[0]).alias("h")).toArrow().column("h").to_numpy())


def _among(values: set[str], hashes: np.ndarray | None) -> set[str]:
    """Those of the values that are wanted; a few others may be among them."""
    if hashes is None or not values:
        return values
    every = list(values)
    h = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in every), np.uint64, len(every)).view(np.int64)
    at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
    found = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
    return {every[i] for i in np.flatnonzero(found)}


def _added(texts: DataFrame, schema: str, keys: list[str], of: Callable[[pd.DataFrame], Iterator[Iterator[tuple]]]) -> DataFrame:
    """Sums of ones a key, which of gives for each text of a batch; each task adds up first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in held.items()], columns=[*keys, "n"])
            held.clear()
            return out

        for batch in batches:
            for found in of(batch):
                held.update(found)
                if len(held) > _HELD_COUNTS:
                    yield from sliced(flushed())
        yield from sliced(flushed())

    bounded_batches(texts.sparkSession)
    return texts.mapInPandas(count, schema + ", n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def _free(text: str) -> set[str]:
    return {t for t, _, _ in free_terms(text, base_spans(text))}


def revealing(found: DataFrame, docs: DataFrame, least: int = LEAST_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """term, entity and disclosure of the pairs over the threshold; stored.

    A term stands in at least as many texts as it stands in with any entity, so that pairs which fail with that
    number are left out before terms are counted in all texts.
    """
    spark = docs.sparkSession
    first = found.groupBy("check").agg(F.min("row").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("check", "first")
    copies = stored(found.select("check", "row").join(_small_side(stored(first, "pii-copied")), "check").filter("row > first").select("row"), "pii-copies")
    copies = F.broadcast(copies) if small(copies, BROADCAST_COPIES) else copies
    texts = max(found.select("row").join(copies, "row", "left_anti").count(), 2)
    with_data = found.filter(F.size("entities") > 0).select("row", "text", "entities").join(copies, "row", "left_anti")
    holders = with_data.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity")).filter(F.col("with_entity") >= least)
    information = F.log(F.lit(float(texts)) / F.col("with_entity"))
    # no term of more texts than this reveals the entity
    holders = stored(holders.withColumns({"information": information, "most": F.col("with_entity") * F.exp(information * (1 - threshold))}).filter("information > 0"), "pii-holders")
    kinds = spark.sparkContext.broadcast(KINDS)

    # terms, and how many of their texts hold each kind
    def by_kind(batch: pd.DataFrame) -> Iterator[Iterator[tuple]]:
        for text, entities in zip(batch["text"], batch["entities"], strict=True):
            own = sum(1 << i for i, k in enumerate(kinds.value) if k in entities)
            yield ((t, own) for t in _free(text))

    near = _added(with_data, "term string, kinds int", ["term", "kinds"], by_kind)
    of_kind = lambda i: F.coalesce(F.sum(F.when(F.col("kinds").bitwiseAND(1 << i) > 0, F.col("n"))), F.lit(0)).alias(KINDS[i])
    near = near.groupBy("term").agg(F.sum("n").alias("near_any"), *map(of_kind, range(len(KINDS)))).filter(F.col("near_any") >= least)
    near = stored(near, "pii-near")
    pairs = near.select("term", "near_any", F.explode(F.array(*(F.struct(F.lit(k).alias("entity"), F.col(k).alias("together")) for k in KINDS))).alias("p")).select("term", "near_any", "p.*")

    # the same with each value and prefix that several texts hold
    finer = stored(holders.filter(~F.col("entity").isin(*KINDS)), "pii-finer")
    most = finer.agg(F.max("most")).first()[0]
    if most is not None:
        rare, several = near.filter(F.col("near_any") <= most + 1e-9), spark.sparkContext.broadcast(_hashes(finer.select("entity")))
        wanted = spark.sparkContext.broadcast(_hashes(rare.select("term")))  # HASHED_TERMS at most, like the entities

        def by_entity(batch: pd.DataFrame) -> Iterator[Iterator[tuple]]:
            held = _among({e for entities in batch["entities"] for e in entities if e not in kinds.value}, several.value)
            own = [[e for e in entities if e in held] for entities in batch["entities"]]
            terms = [_free(text) if e else set() for text, e in zip(batch["text"], own, strict=True)]
            known = _among(set().union(*terms), wanted.value)
            for found, entities in zip(terms, own, strict=True):
                yield ((t, e) for t in found & known for e in entities)

        together = _added(with_data, "term string, entity string", ["term", "entity"], by_entity).withColumnRenamed("n", "together")
        pairs = pairs.unionByName(together.filter(F.col("together") >= least).join(rare.select("term", "near_any"), "term"))
    disclosure = lambda with_term: 1 - F.log(with_term / F.col("together")) / F.col("information")
    pairs = pairs.filter(F.col("together") >= least).join(_small_side(holders), "entity").filter(disclosure(F.col("near_any")) >= threshold)
    pairs = stored(pairs.select("term", "entity", "together", "information"), "pii-pairs")
    candidates = spark.sparkContext.broadcast(_hashes(stored(pairs.select("term").distinct(), "pii-terms")))

    def in_all(batch: pd.DataFrame) -> Iterator[Iterator[tuple]]:
        sets = [terms_of(text or "") for text in batch["text"]]
        known = _among(set().union(*sets), candidates.value)
        for terms in sets:
            yield ((t,) for t in terms & known)

    frequencies = _added(docs.select("row", "text").join(copies, "row", "left_anti"), "term string", ["term"], in_all).withColumnRenamed("n", "with_term")
    counted = pairs.join(frequencies, "term").withColumn("disclosure", disclosure(F.col("with_term")))
    return stored(counted.filter(F.col("disclosure") >= threshold).select("term", "entity", "disclosure"), "pii-revealing")


PLACES = "array<struct<start:int,end:int,label:string>>"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("check"), "text")


def _places(found: DataFrame, rows: DataFrame, least: int, threshold: float) -> DataFrame:
    """check and terms (start, end, label) of the texts that hold revealing terms; stored."""
    pairs = revealing(found, rows, least, threshold)
    known = rows.sparkSession.sparkContext.broadcast(_hashes(pairs.select("term").distinct()))  # HASHED_TERMS at most

    # the pairs that stand in a text, which are few, and never all pairs of an entity for each text that holds it
    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [_free(text) for text in batch["text"]]
            wanted = _among(set().union(*sets), known.value)
            out = [(c, t, e) for c, terms, entities in zip(batch["check"], sets, batch["entities"], strict=True) for t in terms & wanted for e in entities]
            yield from sliced(pd.DataFrame(out, columns=["check", "term", "entity"]))

    bounded_batches(rows.sparkSession)
    with_data = found.filter("text is not null").select("check", "text", "entities")
    kind = F.upper(F.regexp_extract("entity", "^([a-z]+)[:~]", 1))
    label = F.when(kind != "", F.concat(F.lit("["), kind, F.lit("]"))).otherwise("")
    held = with_data.mapInPandas(inside, "check long, term string, entity string").distinct().join(pairs.select("term", "entity"), ["term", "entity"])
    held = held.groupBy("check", "term").agg(F.max(label).alias("label"))
    held = stored(held.groupBy("check").agg(F.map_from_entries(F.collect_list(F.struct("term", "label"))).alias("revealing")), "pii-sanitised")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("check")
            out = [[{"start": a, "end": b, "label": terms[t]} for t, a, b in free_terms(text or "", base_spans(text or "")) if t in terms] for text, terms in zip(batch["text"], map(dict, batch["revealing"]), strict=True)]
            yield pd.DataFrame({"check": batch["check"].to_numpy(), "terms": out})

    placed = with_data.select("check", "text").join(_small_side(held), "check").mapInPandas(places, f"check long, terms {PLACES}")
    terms = stored(placed.groupBy("check").agg(F.first("terms").alias("terms")), "pii-places")
    return _small_side(terms)


def find_personal(docs: DataFrame, least: int = LEAST_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, base (start, kind, end) and terms (start, end, label), both in order."""
    rows = _rows(docs)
    found = stored(_found(rows), "pii-found")
    terms = _places(found, rows, least, threshold)
    return found.select("doc_id", "check", "base").join(terms, "check", "left").select("doc_id", "base", "terms")


def sanitise(docs: DataFrame, least: int = LEAST_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and the text without personal data."""
    rows = _rows(docs)
    terms = _places(stored(_found(rows), "pii-found"), rows, least, threshold)

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, terms: pd.Series) -> pd.Series:
        base = ([{"start": a, "kind": k, "end": b} for a, k, b in base_spans(x or "")] for x in text)
        return pd.Series([sanitised(x, b, t) for x, b, t in zip(text, base, terms, strict=True)], dtype=object)

    bounded_batches(docs.sparkSession)
    return rows.join(terms, "check", "left").select("doc_id", cleaned("text", "terms").alias("text"))


def sanitised(text: str | None, base: list, terms: list | None) -> str | None:
    """The text with base spans generalised to their kind, and terms as their label says; of overlapping spans the first."""
    if text is None:
        return None
    spans = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base]
    spans = sorted(spans + [(s["start"], s["end"], s["label"]) for s in (() if terms is None else terms)])
    out, at = [], 0
    for start, end, label in spans:
        if start >= at:
            out += [text[at:start], label]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])


@tidied
def op6_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    out = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = F.array(*map(F.lit, KINDS))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.transform(F.coalesce("terms", F.array().cast(PLACES)), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    named = lambda spans, names: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return out.select("doc_id", *map(count, range(len(KINDS))), F.sha2(named(base, kinds), 256).alias("base_sha256"), named(F.concat(base, terms), F.array_append(kinds, F.lit(TERM))).alias("spans"))
