"""Language identification, words first.

A word that the model knows scores by its log frequency in each language.  Any other word backs off to its
character n-grams: the longest n (5 down to 1) of which the model knows some, by their mean log frequency.
The prediction is the language with the largest sum over all words of the text.  Words are runs of letters.

The model is fitted on a sample of the labelled rows, chosen by a hash of the id: about SAMPLE_CHARS characters
of each language and MOST_CHARS of all.  All languages and all words of the sample are learned, so the sample
bounds the model; it is collected once and goes to every task.  Should the sample hold more than MOST_WORDS
different words (counted before they are collected), half of its rows are taken, and so on.

Defined cases: a null text, or one without a letter (numerals like ½ or Ⅷ aren't), is `und` with score 0; so is
every text when nothing could be learned; a row without label is not learned from; equal scores go to the first
language by name; very long texts are read whole; repeated rows get equal predictions; a null id counts as the
empty string in the fold; other columns are kept by identify and ignored by the query; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.llm.common import bounded_batches, sliced, stored, tidied

#: Characters that the model is fitted on: of a language, and of all.
SAMPLE_CHARS, MOST_CHARS = 2_000_000, 40_000_000
#: Different words of a language, added up over languages, that the model is made of at most.
MOST_WORDS = 1_000_000
LONGEST_GRAM = 5
#: Words of a text at which the score stops to sharpen with its length.
SHARP_WORDS = 20
UNKNOWN = "und"
_HELD_WORDS = 200_000
#: Words times languages that are summed up at once.
_CELLS = 4_000_000
#: Characters of texts whose words are held at once; a single longer text is held by itself.
_HELD_CHARS = 500_000


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def _letters() -> re.Pattern:
    """Runs of letters, in texts of the basic plane; ranges make it much faster than a class of exceptions."""
    letters = [i for i in range(0x10000) if chr(i).isalpha()]
    cuts = [0, *(n for n in range(1, len(letters)) if letters[n] != letters[n - 1] + 1), len(letters)]
    return re.compile("[" + "".join(f"\\u{letters[x]:04x}-\\u{letters[y - 1]:04x}" for x, y in zip(cuts, cuts[1:], strict=False)) + "]+")


def _words(text: str) -> list[str]:
    low = text.lower()
    if not low.isascii() and _ASTRAL.search(low):
        return "".join(c if c.isalpha() else " " for c in low).split()
    return _letters().findall(low)


def word_counts(labelled: DataFrame) -> DataFrame:
    """lang, word, count of rows lang, text; each task counts first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame([(lang, w, n) for (lang, w), n in held.items()], columns=["lang", "word", "n"])
            held.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                held.update((lang, w) for w in _words(text or ""))
                if len(held) > _HELD_WORDS:
                    yield from sliced(flushed())
        yield from sliced(flushed())

    bounded_batches(labelled.sparkSession)
    return labelled.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Table:
    """Log frequencies by language of some keys (words or n-grams); half a count for what a language doesn't have.

    Only what a key has over the half count is kept, so that a key costs the languages it occurs in.
    """

    def __init__(self, counts: Sequence[dict[str, int]]):
        self.index: dict[str, int] = {}
        for c in counts:
            for key in c:
                self.index.setdefault(key, len(self.index))
        sums = np.log([sum(c.values()) + 0.5 * (len(self.index) + 1) for c in counts])
        self.floor = np.log(0.5) - sums
        at = np.fromiter((self.index[k] for c in counts for k in c), np.int64, sum(map(len, counts)))
        lang = np.repeat(np.arange(len(counts), dtype=np.int32), [len(c) for c in counts])
        over = np.log(np.fromiter((n for c in counts for n in c.values()), float, len(at)) + 0.5) - np.log(0.5)
        order = np.argsort(at, kind="stable")
        self.lang, self.over = lang[order], over[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.index)))))

    def rows(self, at: np.ndarray) -> np.ndarray:
        """A row of log frequencies for each of these keys."""
        n = self.start[at + 1] - self.start[at]
        row = np.repeat(np.arange(len(at)), n)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
        out = np.tile(self.floor, (len(at), 1))
        out[row, self.lang[entry]] += self.over[entry]
        return out


def _grams(word: str, k: int) -> list[str]:
    around = f"<{word}>"
    return [around[i : i + k] for i in range(len(around) - k + 1)]


class Model:
    """Log frequencies of words and of character n-grams by language."""

    def __init__(self, counts: dict[str, dict[str, int]], documents: dict[str, int]):
        self.langs = sorted(counts)
        self.prior = np.log([documents[x] / sum(documents.values()) for x in self.langs]) if self.langs else np.zeros(0)
        if not self.langs:
            return
        self.words = Table([counts[x] for x in self.langs])
        self.grams = []
        for k in range(1, LONGEST_GRAM + 1):
            grams = [Counter() for _ in self.langs]
            for held, lang in zip(grams, self.langs, strict=True):
                for word, n in counts[lang].items():
                    for gram in _grams(word, k):
                        held[gram] += n
            self.grams.append(Table(grams))

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean over the longest n-grams of which some are known."""
        out, left = np.zeros((len(words), len(self.langs))), range(len(words))
        for k in range(LONGEST_GRAM, 0, -1):
            table = self.grams[k - 1]
            get, ids, done, times, rest = table.index.get, [], [], [], []
            for i in left:
                found = [n for g in _grams(words[i], k) if (n := get(g)) is not None]
                if found:
                    ids += found
                    done.append(i)
                    times.append(len(found))
                else:
                    rest.append(i)
            if done:
                starts = np.cumsum([0, *times[:-1]])
                out[done] = np.add.reduceat(table.rows(np.array(ids)), starts) / np.array(times)[:, None]
            left = rest
        return out

    def sums(self, texts: list[Counter]) -> np.ndarray:
        """The sum of the log frequencies of all words, a row a text, none of which is empty."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):  # so many texts that their words times languages are bounded
            end, cells = at, 0
            while end < len(texts) and (end == at or cells + len(texts[end]) * len(self.langs) <= _CELLS):
                cells += len(texts[end]) * len(self.langs)
                end += 1
            part = texts[at:end]
            number: dict[str, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for t in part for w in t), np.int64)
            known = np.fromiter((self.words.index.get(w, -1) for w in number), np.int64, len(number))
            rows = np.empty((len(number), len(self.langs)))
            rows[known >= 0] = self.words.rows(known[known >= 0])
            rows[known < 0] = self.unseen([w for w, n in zip(number, known.tolist(), strict=True) if n < 0])
            times = np.fromiter((n for t in part for n in t.values()), float, len(ids))
            starts = np.cumsum([0, *map(len, part[:-1])])
            for lang in range(len(self.langs)):
                out[at:end, lang] = np.add.reduceat(rows[ids, lang] * times, starts)
            at = end
        return out

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores; the words of a whole batch would take many times its bytes, so a part of it at once."""
        langs, scores, at = [], np.zeros(len(texts)), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= _HELD_CHARS):
                chars += len(texts[end] or "")
                end += 1
            part, scores[at:end] = self._predict(texts[at:end])
            langs += part
            at = end
        return langs, scores

    def _predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        words = [Counter(_words(t or "")) for t in texts]
        has = [i for i, w in enumerate(words) if w]
        langs, scores = [UNKNOWN] * len(words), np.zeros(len(words))
        if has and self.langs:
            sums = self.sums([words[i] for i in has])
            n = np.array([words[i].total() for i in has])
            best = np.argmax(sums + self.prior, axis=1)
            sharp = self.prior + sums * np.minimum(1.0, SHARP_WORDS / n)[:, None]
            scores[has] = 1 / np.exp(sharp - sharp[np.arange(len(best)), best][:, None]).sum(axis=1)
            for i, b in zip(has, best.tolist(), strict=True):
                langs[i] = self.langs[b]
        return langs, scores


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE_CHARS, most: int = MOST_CHARS, words: int = MOST_WORDS, seed: int = 11) -> Model:
    """A model of the rows of docs (doc_id, text, lang) where learn holds and lang isn't null."""
    rows = docs.filter(learn & F.col("lang").isNotNull())
    sizes = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}  # a row a language
    if not sizes:
        return Model({}, {})
    share, each = 1.0, min(sample, most / len(sizes))
    while True:
        part = F.create_map(*(F.lit(x) for lang, r in sizes.items() for x in (lang, min(1.0, each / max(1, r["chars"] or 0)) * share)))
        chosen = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < F.element_at(part, F.col("lang")) * (1 << 30)
        counts = stored(word_counts(rows.filter(chosen)), "language-words")
        if counts.count() <= words:
            break
        share /= 2
    learned: dict[str, dict[str, int]] = {x: {} for x in sizes}
    for batch in counts.toArrow().to_batches(_HELD_WORDS):  # words rows at most
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            learned[lang][word] = n
    return Model(learned, {lang: r["n"] for lang, r in sizes.items()})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(text: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict(text.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    bounded_batches(docs.sparkSession)
    return docs.withColumn("_of", of(text_col)).withColumns({"lang_pred": F.col("_of.lang_pred"), "score": F.col("_of.score")}).drop("_of")


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


@tidied
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, fold(F.col("doc_id")) != 0)
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "lang_pred", "score")
