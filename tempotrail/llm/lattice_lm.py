"""Language-model scoring over subword lattices.

A word is a lattice: the vocabulary's pieces are its arcs, and its probability is the sum over all
segmentations, found by the forward recursion in log space.  Corpus counts add an arc for the whole word: with
c its count among the N training tokens and V their distinct number, a token has the probability
(c + V * lattice) / (N + V), so that the lattice is the prior of all words, seen or not, and V sets its weight
(the share of new words grows with the distinct ones seen).  A text's score is the marginal log10 probability
of its words and its end.

The vocabulary is an existing sentencepiece file, used as it is.  Scores of a unigram model are taken as log
probabilities.  Scores of a merge-ranked model are ranks; they become log probabilities by Zipf's law,
1 / (rank + 2.7), normalised.  A character that no piece has is spelled by its bytes, each as likely as the
last rank.

Counting covers the whole corpus.  The most frequent HEAD_WORDS words go to every task; all other words are
scored once each and joined by word, so memory doesn't grow with the vocabulary.

Defined cases: a null or empty text has only its end token; without training rows N and V are 0 and every
token has its lattice probability (and base probability 1); a null id counts as the empty string in the fold;
very long words and texts are scored whole; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.llm.common import bounded_batches, sliced, stored, tidied

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that go to every task.
HEAD_WORDS = 131_072
_HELD_WORDS = 300_000
#: The end of a text, as a token.
END = ""
LN10 = math.log(10)
ZIPF_SHIFT = 2.7


class Lattice:
    """Log probabilities of pieces, and of words over all their segmentations."""

    def __init__(self, pieces: dict[str, float], byte: float):
        self.pieces, self.byte = pieces, byte
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        scores = [model.get_score(i) for i in usable]
        if all(s == int(s) for s in scores):  # ranks
            raw = [-math.log(ZIPF_SHIFT - s) for s in scores]
            total = math.log(sum(map(math.exp, raw)))
            scores = [x - total for x in raw]
        return cls({model.id_to_piece(i): s for i, s in zip(usable, scores, strict=True)}, min(scores))

    def word(self, word: str) -> float:
        """ln of the sum over all segmentations of the product of piece probabilities."""
        text, pieces, longest, exp = "▁" + word, self.pieces, self.longest, math.exp
        upto = [0.0]
        for end in range(1, len(text) + 1):
            arcs = []
            for start in range(max(0, end - longest), end):
                p = pieces.get(text[start:end])
                if p is not None:
                    arcs.append(upto[start] + p)
            char = text[end - 1]
            if char not in pieces:
                arcs.append(upto[end - 1] + self.byte * len(char.encode()))
            most = max(arcs)
            upto.append(most if len(arcs) == 1 else most + math.log(sum([exp(x - most) for x in arcs])))
        return upto[-1]


class Scorer:
    """Base and model log10 probability of a token from its count."""

    def __init__(self, lattice: Lattice, tokens: int, distinct: int):
        self.lattice, self.n, self.v = lattice, tokens, distinct
        self.under = math.log10(tokens + 0.5 * (distinct + 1))

    def base(self, count: int) -> float:
        return math.log10(count + 0.5) - self.under

    def model(self, word: str, count: int) -> float:
        if not self.n:
            return self.lattice.word(word) / LN10
        prior = math.log(self.v) + self.lattice.word(word)
        if count:
            a, b = max(prior, math.log(count)), min(prior, math.log(count))
            prior = a + math.log1p(math.exp(b - a))
        return (prior - math.log(self.n + self.v)) / LN10


def tokens(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().lower().split()]


def token_counts(texts: DataFrame) -> DataFrame:
    """word and count over rows text, with END once a text; each task counts first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode() for w in held], "n": list(held.values())}).astype({"n": "int64"})
            held.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                held.update((text or "").encode().lower().split())
                held[b""] += 1
                if len(held) > _HELD_WORDS:
                    yield from sliced(flushed())
        yield from sliced(flushed())

    bounded_batches(texts.sparkSession)
    return texts.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most so many: those over a frequency that a histogram gives."""
    level = F.floor(F.log2("n") * 16).cast("int")
    total, least = 0, 1 << 30
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 16 levels for each doubling
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return counts.filter(level >= least)


def score(docs: DataFrame, held_out: str = "held_out", vocabulary: str = VOCABULARY, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per row of docs (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = stored(token_counts(docs.filter(~F.col(held_out))), "lm-counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    scorer = Scorer(Lattice.load(vocabulary), whole["n"] or 0, whole["v"])
    top = frequent(counts, head_words).collect()  # at most head_words
    head = spark.sparkContext.broadcast({r["word"].encode(): (scorer.base(r["n"]), scorer.model(r["word"], r["n"])) for r in top})
    shared = spark.sparkContext.broadcast(scorer)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = head.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = Counter((text or "").encode().lower().split())
                words[b""] = 1
                seen, base, model, rest, times = 0, 0.0, 0.0, [], []
                for w, k in words.items():
                    found = known.get(w)
                    if found is None:
                        rest.append(w.decode())
                        times.append(k)
                    else:
                        seen += k
                        base += k * found[0]
                        model += k * found[1]
                rows.append((words.total(), seen, base, model, rest, times))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "model", "rest", "times"])
            yield pd.concat([batch[["row", "doc_id", "held_out"]].reset_index(drop=True), out], axis=1)

    bounded_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(held_out).alias("held_out"), "text")
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rest array<string>, times array<long>"
    part = stored(rows.mapInPandas(first, schema), "lm-head")
    rest = part.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("row", F.col("t.rest").alias("word"), F.col("t.times").alias("k"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for batch in batches:
            n = batch["n"].tolist()
            yield pd.DataFrame({"word": batch["word"].tolist(), "known": [int(c > 0) for c in n], "base": [s.base(c) for c in n], "model": [s.model(w, c) for w, c in zip(batch["word"], n, strict=True)]})

    words = rest.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    bounded_batches(spark)
    words = stored(words.mapInPandas(scored, "word string, known int, base double, model double"), "lm-words")
    sums = rest.join(words, "word").groupBy("row").agg(F.sum(F.col("k") * F.col("known")).alias("k_known"), F.sum(F.col("k") * F.col("base")).alias("k_base"), F.sum(F.col("k") * F.col("model")).alias("k_model"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return part.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "k_known").cast("long").alias("n_known"), F.lit(whole["n"] or 0).cast("long").alias("train_tokens"), plus("base", "k_base").alias("base_score"), plus("model", "k_model").alias("score"))


@tidied
def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))
    return score(docs.select("doc_id", "text", (fold == 1).alias("held_out")))
