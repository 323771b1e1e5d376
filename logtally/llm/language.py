"""Language identification: words first, then ever shorter character n-grams.

A word seen in training scores by its log frequency in each language. Any other word is looked up
as n-grams of its padded letters, the longest length that training has seen deciding; the padding
alone says nothing. A word without any known n-gram agrees with no language. A document goes to the
language with the largest sum. The model is fitted on a bounded sample of labelled rows of each
language (``FitSettings``); scoring covers every row and whole texts, in Arrow batches, and needs no
shuffle.

Frequencies are shares of a language's own words, so each language counts alike however many rows it
has, and are smoothed towards the word's mean share over all languages: ``log(1 + share / (SMOOTHING *
mean))``. What was never seen scores 0 in every language, less than anything seen. Most words are known
in few languages; only those scores are kept.

Words are letters with the letters and marks that follow, lower-cased, cut by one expression for fit and
scoring alike.

Results for odd input: a null or letterless text is ``und`` with score 0; ties go to the language
first in alphabetical order; repeated rows are scored one by one, and count once in the fit; null and
shared ids are like any other; extra columns are ignored; a training set without rows makes every text ``und``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtally.session import write_scratch

from .common import add_columns, by_hash, text_of

UNDETERMINED = "und"
WORD = r"\p{L}[\p{L}\p{M}]*"
SMOOTHING = 0.1
#: Scores of words outside the model that a task remembers, and words scored together; bounds of memory only.
MEMO_SCORES = 4_000_000
GROUP_WORDS = 50_000


@dataclass(frozen=True)
class FitSettings:
    """Bounds of the fit: about so many rows of each language are read, and its most frequent
    words and n-grams kept. Every language with labelled rows is learned."""

    rows_per_language: int = 1_000
    words_per_language: int = 50_000
    grams_per_language: int = 60_000
    longest_gram: int = 5
    seed: int = 7


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


class Names(Mapping[str, int]):
    """Place of each text in an Arrow array of distinct ones, in a small part of a dict's memory. The driver holds
    names so, since it looks hardly any up; tasks make a dict of them."""

    def __init__(self, texts: pa.Array):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __iter__(self) -> Iterator[str]:
        return (x.as_py() for x in self.texts)

    def __getitem__(self, name: str) -> int:
        at = pc.index(self.texts, name).as_py()
        if at < 0:
            raise KeyError(name)
        return at


@dataclass
class Scores:
    """Scores of words or n-grams: ``names[x]`` is a row; its languages and scores are those from ``start[row]`` on."""

    names: Mapping[str, int]
    start: np.ndarray
    language: np.ndarray
    score: np.ndarray

    @staticmethod
    def of(names: pa.Array, name: np.ndarray, language: np.ndarray, count: np.ndarray, totals: np.ndarray) -> Scores:
        """From counts of (name, language) pairs, each at most once; ``totals``: all there is of each language."""
        order = np.lexsort((language, name))
        name, language, share = name[order], language[order], count[order] / totals[language[order]]
        mean = np.bincount(name, share, len(names)) / len(totals)
        start = np.searchsorted(name, np.arange(len(names) + 1))
        return Scores(Names(names), start, language.astype(np.int32), np.log1p(share / (SMOOTHING * mean[name])).astype(np.float32))

    def __getstate__(self) -> dict:
        """With the names in one buffer: pickling so many texts one by one takes far more memory."""
        return vars(self) | {"names": self.names.texts if isinstance(self.names, Names) else pa.array(list(self.names), pa.string())}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state, names={x: i for i, x in enumerate(state["names"].to_pylist())})

    def dense(self, rows: np.ndarray, languages: int) -> np.ndarray:
        """One row of scores over all languages for each of ``rows``."""
        sizes = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        out = np.zeros((len(rows), languages), np.float32)
        out[np.repeat(np.arange(len(rows)), sizes), self.language[at]] = self.score[at]
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    words: Scores
    grams: Scores
    longest_gram: int

    def backed_off(self, words: Sequence[str]) -> np.ndarray:
        """Scores of unseen words: the mean of the known n-grams of the greatest length that has one; zeros where
        no n-gram is known."""
        get, rows, sizes = self.grams.names.get, [], []
        for word in words:
            found: list[int] = []
            padded = f"^{word}$"
            for n in range(min(self.longest_gram, len(padded)), 0, -1):
                found = [r for i in range(len(padded) - n + 1) if (n > 1 or 0 < i <= len(word)) and (r := get(padded[i : i + n])) is not None]
                if found:
                    break
            rows += found
            sizes.append(len(found))
        count = np.array(sizes, np.int64)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        some = count > 0
        if rows:
            scores = self.grams.dense(np.array(rows), len(self.languages))
            out[some] = np.add.reduceat(scores, np.r_[0, np.cumsum(count[some])[:-1]], axis=0) / count[some, None]
        return out


class Reader:
    """Scores texts with a model, remembering the unseen words it has looked up."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.memo: dict[str, np.ndarray] = {}

    def _table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of distinct words, and which of them training has seen."""
        model, width = self.model, len(self.model.languages)
        rows = np.fromiter(map(model.words.names.get, words, itertools.repeat(-1)), np.int64, len(words))
        out = np.zeros((len(words), width), np.float32)
        known = rows >= 0
        out[known] = model.words.dense(rows[known], width)
        unseen = np.flatnonzero(~known).tolist()
        new = [words[i] for i in unseen if words[i] not in self.memo]
        if len(self.memo) * width > MEMO_SCORES:
            self.memo.clear()
            new = [words[i] for i in unseen]
        if new:
            self.memo.update(zip(new, model.backed_off(new), strict=True))
        if unseen:
            out[unseen] = np.vstack([self.memo[words[i]] for i in unseen])
        return out, known

    def predict(self, texts: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, margin and number of seen words of each list of words."""
        languages = self.model.languages
        offsets = texts.offsets.to_numpy().astype(np.int64)
        named, score, margin = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        seen = np.zeros(len(texts), np.int64)
        begin = 0
        while begin < len(texts) and languages:
            # As many texts as make up a group of words, one at least.
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + GROUP_WORDS, side="right")) - 1)
            sizes = np.diff(offsets[begin : end + 1])
            full = np.flatnonzero(sizes)
            if len(full):
                coded = texts.values.slice(offsets[begin], offsets[end] - offsets[begin]).dictionary_encode()
                (table, known), at = self._table(coded.dictionary.to_pylist()), coded.indices.to_numpy()
                own_best = np.where(table.any(axis=1), table.argmax(axis=1), -1)
                starts = (offsets[begin:end] - offsets[begin])[full]
                best = np.add.reduceat(table[at].astype(np.float64), starts, axis=0).argmax(axis=1)
                seen[begin + full] = np.add.reduceat(known[at].astype(np.int64), starts)
                # Words of each text by their own best language; those without one in a column of their own.
                text = np.repeat(np.arange(len(full)), sizes[full])
                votes = np.bincount(text * (len(languages) + 1) + own_best[at] + 1, minlength=len(full) * (len(languages) + 1))
                share = votes.reshape(len(full), -1)[:, 1:] / sizes[full, None]
                score[begin + full] = agree = share[np.arange(len(full)), best]
                share[np.arange(len(full)), best] = 0
                margin[begin + full] = agree - share.max(axis=1)
                for i, b in zip((begin + full).tolist(), best.tolist(), strict=True):
                    named[i] = languages[b]
            begin = end
        return named, score, margin, seen


def fit(labelled: DataFrame, settings: FitSettings = FitSettings()) -> LanguageModel:
    """Count words of a sample of ``labelled`` (doc_id, text, lang; rows without lang are left out).

    The sample takes texts by their hash, at the rate that gives each language ``rows_per_language`` rows. What
    comes to the driver is bounded by languages, ``words_per_language`` and ``grams_per_language``.
    """
    rows = labelled.where(F.col("lang").isNotNull()).select("lang", text_of().alias("text"))
    sizes = write_scratch(rows.groupBy("lang").count(), "language-sizes")
    sample = rows.join(sizes, "lang").where(by_hash(F.col("text"), settings.seed) * F.col("count") < settings.rows_per_language)
    counts = sample.select("lang", "text").distinct().select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = write_scratch(
        counts.withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= settings.words_per_language)
        .select("word", "lang", "n", "total"),
        "language-words",
    )
    grams = _gram_counts(words, settings).toArrow().sort_by([("lang", "ascending"), ("n", "descending"), ("gram", "ascending")])
    return model_of(words.toArrow().sort_by([("word", "ascending"), ("lang", "ascending")]), grams, settings)


def _gram_counts(words: DataFrame, settings: FitSettings) -> DataFrame:
    """(gram, lang, n, total): the most frequent n-grams of the padded ``words`` in each language. Counted and chosen by
    tasks, since a language has many times as many as are kept."""
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(settings.longest_gram), F.length(padded)))
    of_length = lambda k: F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.substring(padded, i, k))
    grams = words.select("lang", "n", F.explode(F.flatten(F.transform(lengths, of_length))).alias("gram"))
    counts = write_scratch(grams.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "language-grams")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("place", place).where(F.col("place") <= settings.grams_per_language)
    return kept.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang").select("gram", "lang", "n", "total")


def _scores(counts: pa.Table, languages: list[str]) -> Scores:
    """From rows (word or n-gram, lang, n, total)."""
    name, lang = (counts.column(c).combine_chunks().dictionary_encode() for c in (0, 1))
    at = np.array([languages.index(x) for x in lang.dictionary.to_pylist()], np.int64)
    language = at[lang.indices.to_numpy()]
    totals = np.ones(len(languages))
    totals[language] = counts["total"].to_numpy()
    return Scores.of(name.dictionary, name.indices.to_numpy().astype(np.int64), language, counts["n"].to_numpy(), totals)


def model_of(words: pa.Table, grams: pa.Table, settings: FitSettings) -> LanguageModel:
    """The model from counts ``n`` of words and of n-grams in languages that have ``total`` of them in all."""
    languages = sorted(words["lang"].unique().to_pylist())
    return LanguageModel(languages, _scores(words, languages), _scores(grams, languages), settings.longest_gram)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str | Column]) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``lang_pred``, ``score``, the share of words whose own best language
    is the predicted one, and ``margin``, by how much that is more than the share of any other language,
    ``n_letter_words``, and ``n_seen_words``, those of them that training has seen. ``keep`` must not hold these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    readers: list[Reader] = []

    def predict(words: pa.ListArray) -> list[pa.Array]:
        if not readers:
            readers.append(Reader(shared.value))
        named, score, margin, seen = readers[0].predict(words)
        return [pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), words.value_lengths().cast(pa.int64()), pa.array(seen)]

    return add_columns(docs, keep, [words_of(text_of())], "lang_pred string, score double, margin double, n_letter_words long, n_seen_words long", predict)
