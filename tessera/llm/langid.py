"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word scores through its character n-grams, longest first:
the mean log frequency of its known 4-grams, or if none is known its 3-grams, then 2-grams, then single characters. A
document's scores are sums over its words; the result is the language of the largest sum and its share of the softmax.

Training takes a bounded, documented sample of labelled rows: some ROWS_PER_LANGUAGE of each language, drawn by a hash of id, text
and place. Of what it counts, words and n-grams are chosen by the largest share that they have in any one language, MOST_WORDS and
MOST_GRAMS in all, so a language with few rows keeps its own; a chosen word or n-gram keeps its counts in all languages.
The model has a fixed bound by that and may be broadcast. Prediction reads every whole text.

Null texts and texts without a letter get `und` and score 0; so does every text if nothing was learned. A text whose words
share no n-gram with the model gets the first language in code point order at score 1/L, and its `known` is 0. Ties go to that
order too. Repeated rows each get the same result. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import bounded_batches, cut

UNKNOWN = "und"
ROWS_PER_LANGUAGE = 4000
MOST_WORDS = 60_000
MOST_GRAMS = 120_000
ORDERS = (4, 3, 2, 1)
#: Words whose scores a task keeps at hand.
REMEMBERED = 200_000

_word = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for w in _word.finditer(text) for c in w[0])


def grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(words_of(text))
    for lang, words in found.items():
        by_order = {0: words} | {n: Counter() for n in ORDERS}
        for word, n in words.items():
            for order in ORDERS:
                for g in grams(word, order):
                    by_order[order][g] += n
        for order, counted in by_order.items():
            keys = list(counted)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([order] * len(part), pa.int32()), pa.array(part), pa.array([counted[k] for k in part], pa.int64())], ["lang", "n", "gram", "count"])


class Model:
    """counts: (language, order, gram) -> count, order 0 for whole words."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        self.languages = sorted({c[0] for c in counts}, key=lambda s: [ord(c) for c in s])
        at = {x: i for i, x in enumerate(self.languages)}
        #: order -> gram -> row of that order's log frequencies
        self.rows: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
        for _, order, gram, _ in counts:
            self.rows[order].setdefault(gram, len(self.rows[order]))
        self.logs = {}
        for order, rows in self.rows.items():
            table = np.zeros((len(rows), len(at)))
            for lang, n, gram, count in counts:
                if n == order:
                    table[rows[gram], at[lang]] += count
            # One floor for all languages, whatever they were trained on: else an unseen word would speak for the smallest.
            totals = np.maximum(table.sum(0), 1)
            floor = 0.5 / totals.max(initial=1)
            self.logs[order] = np.log((table / totals + floor) / (1 + floor * len(rows)))

    def looked_up(self, word: str) -> tuple[np.ndarray, bool]:
        """Log frequency in each language, and whether the model knows the word or any of its n-grams."""
        row = self.rows[0].get(word)
        if row is not None:
            return self.logs[0][row], True
        for order in ORDERS:
            rows = self.rows[order]
            if found := [rows[g] for g in grams(word, order) if g in rows]:
                return self.logs[order][found].sum(0) / len(found), True
        return np.zeros(len(self.languages)), False

    def word(self, word: str) -> np.ndarray:
        return self.looked_up(word)[0]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """word -> row of a table of scores, with whether the word is known in the last column; dropped when it is full."""

    def __init__(self, model: Model):
        self.model, self.table = model, np.zeros((REMEMBERED, len(model.languages) + 1))

    def __missing__(self, word: str) -> int:
        if len(self) == REMEMBERED:
            raise OverflowError
        logs, known = self.model.looked_up(word)
        self.table[len(self), :-1], self.table[len(self), -1] = logs, known
        self[word] = row = len(self)
        return row

    def sum_of(self, words: list[str]) -> np.ndarray:
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(0)

    def total(self, words: list[str]) -> np.ndarray:
        """In parts that fit the table even if all their words are new."""
        sums = np.zeros(len(self.model.languages) + 1)
        for i in range(0, len(words), REMEMBERED):
            part = words[i : i + REMEMBERED]
            try:
                sums += self.sum_of(part)
            except OverflowError:
                self.clear()
                sums += self.sum_of(part)
        return sums

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """Language, score, and the number of words of which the model knows something."""
        if not text or not self.model.languages or not has_letter(text):
            return UNKNOWN, 0.0, 0
        *sums, known = self.total(words_of(text))
        best = int(np.argmax(sums))
        return self.model.languages[best], float(1 / np.exp(np.array(sums) - sums[best]).sum()), int(known)


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model of the labelled rows; null texts and labels teach nothing."""
    rows = labelled.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"), F.col(f"`{lang_column}`").cast("string").alias("lang"))
    # Drawn by place too: else a row that is repeated without end would be in the sample as a whole.
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(1 << 30))).where("text is not null and lang is not null")
    numbers = rows.groupBy("lang").count()
    share = F.col("draw") < F.lit(float(rows_per_language) * (1 << 30)) / F.col("count")
    sample = rows.join(F.broadcast(numbers), "lang").where(share).select("lang", "text")  # a row for each language
    counted = cut(sample.mapInArrow(_counts, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")), "counts")
    totals = F.broadcast(counted.groupBy("lang", "n").agg(F.sum("count").alias("total")))  # a row for each language and order
    shares = counted.join(totals, ["lang", "n"]).groupBy("n", "gram").agg(F.max(F.col("count") / F.col("total")).alias("share"))
    chosen = lambda which, most: shares.where(which).orderBy(F.desc("share"), "n", "gram").limit(most).select("n", "gram")
    both = counted.join(chosen("n = 0", MOST_WORDS).unionByName(chosen("n > 0", MOST_GRAMS)), ["n", "gram"], "left_semi").select("lang", "n", "gram", "count").toPandas()
    return Model(list(zip(both["lang"], map(int, both["n"]), both["gram"], map(int, both["count"]), strict=True)))


def identify(docs: DataFrame, model: Model, text_column: str = "text", prefix: str = "") -> DataFrame:
    """docs with columns {prefix}lang_pred, {prefix}score and {prefix}known added; every other column is passed through untouched.

    A column of docs that has one of these names already is an error; give a prefix then.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    added = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}known", T.LongType())]
    if clash := {f.name.lower() for f in added} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have columns {sorted(clash)}; give a prefix")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(text_column).to_pylist()]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *added]))
