"""Reading level of the prose in each document by smoothed unigram language models, one per grade level.

Levels are bands of years of schooling. Every document with prose seeds the band of its grade: the median of its labels
where it has usable ones, else a readability formula over its sentences. Word counts per band, smoothed towards the words
of the whole corpus, make the models; a sentence, and a document, gets the band with the highest posterior likelihood. Words
outside the vocabulary carry no evidence; prose without any known word falls back on the formula.

Counts cover all documents and the model holds every word. The *vocabulary* most frequent words travel to the tasks with
one likelihood per band. Where there are more, the others stay a table: a task passes their occurrences on, they are joined
by word, and their likelihoods are added to what the task has summed up. Only rare words take that way, so no word is hot.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.prose import LEAST_WORDS, sentences
from driftwell.session import with_package, written

#: Last grade of each level but the highest.
EDGES = (5.0, 9.0, 13.0)
#: Words of the model that are sent to the tasks, the most frequent ones (ties by word); the others are joined.
VOCABULARY = 100_000
#: Weight, in words, of the corpus-wide distribution that smooths each level's.
SMOOTHING = 200.0
#: Years of schooling a label may name, by default; labels outside are not grades and don't count.
GRADES = (1, 20)

_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôû]+")


def syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    if n > 1 and word.endswith("e") and not word.endswith("le"):
        n -= 1
    return max(1, n)


def formula_grade(words: list[list[str]]) -> float | None:
    """Years of schooling by the Flesch-Kincaid formula; None without words."""
    n = sum(map(len, words))
    if not n:
        return None
    return 0.39 * n / len(words) + 11.8 * sum(syllables(w) for s in words for w in s) / n - 15.59


def level_of(grade: float, edges: tuple[float, ...] = EDGES) -> int:
    return sum(grade > e for e in edges)


def prose_table(df: DataFrame, doc_id: Column, text: Column, least_words: int = LEAST_WORDS) -> DataFrame:
    """Written table doc_id, sentences (words joined by spaces), formula, row_no (unique); documents without prose have an empty list and NULL."""
    schema = "doc_id long, sentences array<string>, formula double, row_no long"
    arrow = pa.schema([("doc_id", pa.int64()), ("sentences", pa.list_(pa.string())), ("formula", pa.float64()), ("row_no", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 36
        for batch in batches:
            found = [sentences(x.as_py(), least_words) for x in batch.column(1)]
            numbers = pa.array(range(next_row, next_row + len(found)), pa.int64())
            next_row += len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[" ".join(s) for s in x] for x in found], arrow.field(1).type), pa.array([formula_grade(x) for x in found], pa.float64()), numbers], schema=arrow
            )

    return written(with_package(df).select(doc_id.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(task, schema), "prose")


def seed_levels(prose: DataFrame, labels: DataFrame | None, edges: tuple[float, ...] = EDGES, grades: tuple[int, int] = GRADES) -> DataFrame:
    """doc_id, sentences, level, grade of documents with prose. *labels* has doc_id and grade, any number a document; NULL and grades outside *grades* don't count."""
    seeded = prose.where(F.size("sentences") > 0)
    if labels is not None:
        usable = labels.where(F.col("grade").between(*grades)).groupBy("doc_id").agg(F.median("grade").alias("label"))
        seeded = seeded.join(usable, "doc_id", "left").withColumn("grade", F.coalesce("label", "formula"))
    else:
        seeded = seeded.withColumn("grade", F.col("formula"))
    level = sum((F.when(F.col("grade") > e, 1).otherwise(0) for e in edges), F.lit(0))
    return seeded.select("doc_id", "sentences", level.alias("level"), "grade")


class Model:
    """Log-likelihoods of words and log-priors, per level. *words* travel; *rare* is a table word, ll of all others, or None."""

    def __init__(self, words: dict[str, np.ndarray], prior: np.ndarray, edges: tuple[float, ...], rare: DataFrame | None = None) -> None:
        self.words, self.prior, self.edges, self.rare = words, prior, edges, rare

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rare": None}

    def summed(self, text: list[str]) -> tuple[np.ndarray, int]:
        """Likelihoods of the words that travelled, added up, and how many they are."""
        known = [v for v in map(self.words.get, text) if v is not None]
        return (np.sum(known, axis=0) if known else np.zeros(len(self.prior))), len(known)

    def decided(self, likelihood: np.ndarray, known: int) -> tuple[int, float] | None:
        """Level of the highest posterior and that posterior; None if no word is known."""
        if not known:
            return None
        score = self.prior + likelihood
        best = int(np.argmax(score))
        return best, float(1 / np.exp(score - score[best]).sum())

    def level(self, text: list[str]) -> tuple[int, float] | None:
        return self.decided(*self.summed(text))


def train(seeds: DataFrame, edges: tuple[float, ...] = EDGES, vocabulary: int = VOCABULARY, smoothing: float = SMOOTHING) -> Model:
    """Unigram models of seed_levels(); no seed at all gives a model that knows no word."""
    levels = range(len(edges) + 1)
    tally = [F.sum(F.when(F.col("level") == i, 1).otherwise(0)).alias(f"c{i}") for i in levels]
    documents = seeds.agg(*tally).first()
    words = seeds.select("level", F.explode("sentences").alias("s")).select("level", F.explode(F.split("s", " ")).alias("word"))
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *tally), "word_counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), *[F.sum(f"c{i}").alias(f"c{i}") for i in levels]).first()
    kept = counts.orderBy(F.col("n").desc(), "word").limit(vocabulary).collect()  # bounded; the others are joined
    if not totals["words"]:
        return Model({}, np.zeros(len(edges) + 1), edges)
    seen = np.array([float(documents[f"c{i}"]) for i in levels])
    with np.errstate(divide="ignore"):
        prior = np.log(seen / seen.sum())
    whole = np.array([float(totals[f"c{i}"]) for i in levels])
    known = {}
    for r in kept:
        c = np.array([float(r[f"c{i}"]) for i in levels])
        known[r["word"]] = np.log((c + smoothing * r["n"] / totals["n"]) / (whole + smoothing))
    rare = None
    if totals["words"] > len(kept):
        share = F.lit(smoothing) * F.col("n") / F.lit(float(totals["n"]))
        likelihood = F.array(*[F.log((F.col(f"c{i}") + share) / F.lit(float(whole[i] + smoothing))) for i in levels])
        beyond = counts
        if kept:  # after the last word that travels, in the order by count and word
            last = kept[-1]
            beyond = counts.where((F.col("n") < F.lit(last["n"])) | ((F.col("n") == F.lit(last["n"])) & (F.col("word") > F.lit(last["word"]))))
        rare = written(beyond.select("word", likelihood.alias("ll")), "rare_words")
    return Model(known, prior, edges, rare)


_LEVELS = "doc_id long, level int, posterior double, n_sentences int, n_above int, formula double"
_LEVELS_ARROW = pa.schema([("doc_id", pa.int64()), ("level", pa.int32()), ("posterior", pa.float64()), ("n_sentences", pa.int32()), ("n_above", pa.int32()), ("formula", pa.float64())])


def _judged(judge: Model, found: list[str], formula: float | None, extra: dict[int, tuple[np.ndarray, int]]) -> tuple:
    """(level, posterior, sentences, sentences of the highest level) of one document; *extra* has what its rare words add, by sentence."""
    top, texts = len(judge.edges), [s.split(" ") for s in found]
    sums = [judge.summed(t) for t in texts]
    for at, (likelihood, known) in extra.items():
        sums[at] = (sums[at][0] + likelihood, sums[at][1] + known)
    each = [judge.decided(*x) or (level_of(formula_grade([t]), judge.edges), None) for x, t in zip(sums, texts)]
    whole = (judge.decided(sum(x[0] for x in sums), sum(x[1] for x in sums)) or (level_of(formula, judge.edges), None)) if texts else (None, None)
    return (*whole, len(texts), sum(x[0] == top for x in each))


def assign(prose: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, level, posterior, n_sentences, n_above (sentences of the highest level), formula.

    level is 0 for the lowest band; NULL, like the posterior, for a document without prose. Where no word is known the
    formula decides and the posterior is NULL. The result is the same however many words of the model travel.
    """
    held = prose.sparkSession.sparkContext.broadcast(model)
    schema, arrow = _LEVELS, _LEVELS_ARROW
    columns = ["doc_id", "sentences", "formula"]
    if model.rare is not None:
        said = prose.select("row_no", F.posexplode("sentences").alias("at", "s")).select("row_no", "at", F.explode(F.split("s", " ")).alias("word"))
        times = said.join(model.rare, "word").groupBy("row_no", "at")
        levels = range(len(model.edges) + 1)
        added = times.agg(F.array(*[F.sum(F.col("ll")[i]) for i in levels]).alias("ll"), F.count(F.lit(1)).cast("int").alias("known"))
        added = added.groupBy("row_no").agg(F.collect_list(F.struct("at", "ll", "known")).alias("extra"))
        prose, columns = prose.join(added, "row_no", "left"), [*columns, "extra"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = held.value
        for batch in batches:
            given = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            rows = [
                _judged(judge, found, formula, {x["at"]: (np.array(x["ll"]), x["known"]) for x in extra or ()})
                for found, formula, extra in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), given)
            ]
            out = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, arrow.types[1:5])], batch.column(2)], schema=arrow)

    return prose.select(*columns).mapInArrow(task, schema)


def reading_levels(
    df: DataFrame, doc_id: Column, text: Column, labels: DataFrame | None = None, edges: tuple[float, ...] = EDGES, vocabulary: int = VOCABULARY,
    smoothing: float = SMOOTHING, least_words: int = LEAST_WORDS, grades: tuple[int, int] = GRADES,
) -> DataFrame:
    """assign() over all documents with models trained on them; rows with the same or no doc_id are documents of their own."""
    prose = prose_table(df, doc_id, text, least_words)
    return assign(prose, train(seed_levels(prose, labels, edges, grades), edges, vocabulary, smoothing))
