"""Language-model scoring by cross-entropy difference of two matched bigram models.

The target model is counted over the documents labelled as good, the background model over all documents. Both share one
vocabulary, every word of the corpus, order and smoothing; the background counts are scaled to the target's total, so that
smoothing weighs alike in both. A document's score is its per-token loss under the target model minus that under the background
model: the lower, the nearer to the target.

    p(w | v) = (c(v w) + MASS p(w)) / (c(v) + MASS),  p(w) = (c(w) + 0.5) / (c + 0.5 * |words|)

All counts cover all rows, whole texts and all words; what is gathered grows with the corpus. Only the way of counting differs: the
COMMON most frequent words and their bigrams with each other are a matrix, which is broadcast; it bears the hot keys. Every
occurrence of another word goes, with its neighbours, to the partition of that word, where the word's counts and those of its
bigrams are complete; each partition returns sums for documents. Words are known by 64-bit hashes: among 10^9 different bigrams
0.03 pairs are expected to be counted as one.

Null texts count as empty: no tokens, no losses and score null. Without a target document both models are the background and
every score is 0. A document repeated in the labels is a target if any of its rows says so. Null ids are no target. Words of equal
counts are ranked by their code points; which of them are in the matrix changes no score. Rows equal in id and text have equal
scores. Ids may be of any type; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_batches, cut, small_or_shuffled, type_of

#: Words whose bigrams with each other are counted in a matrix.
COMMON = 1022
MASS = 50.0
#: Distinct words a task counts before it passes them on.
COUNTED = 300_000
#: Tokens and documents that a task deals out at once.
CHUNK, CHUNK_DOCS = 1_500_000, 60_000
#: Rows of a chunk that are held before they are added up.
MERGED = 16
#: Ids in the matrix: any word that is not common, and the edge of a text.
UNKNOWN, EDGE = 0, 1


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return made

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(tokens(text))
            if len(counts) >= COUNTED:
                yield out()
    yield out()


def ids_of(text: str | None, known: dict[str, int]) -> np.ndarray:
    words = tokens(text)
    return np.fromiter((known.get(w, UNKNOWN) for w in words), np.int64, len(words))


def cells_of(ids: np.ndarray, width: int) -> np.ndarray:
    """Cell of each token's bigram; the first token's follows the edge."""
    before = np.concatenate([[EDGE], ids[:-1]])
    return before * width + ids


def _bigram_counts(known):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(known.value) + 2
        sums = np.zeros((2, width * width), np.int64)
        for batch in batches:
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
                ids = ids_of(text, known.value)
                if len(ids):
                    cell, n = np.unique(cells_of(ids, width), return_counts=True)
                    sums[0][cell] += n
                    if good:
                        sums[1][cell] += n
        cell = np.flatnonzero(sums[0])
        for at in range(0, len(cell), 100_000):
            part = cell[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[0][part]), pa.array(sums[1][part])], ["cell", "n", "n_good"])

    return count


class Model(NamedTuple):
    """Of [target, background]: what a task needs to know of the whole corpus."""

    known: dict[str, int]
    #: [before * width + word]: log p of two common words, -log(c(v) + MASS) before another word, 0 after another word
    logs: np.ndarray
    #: p(w) of common words
    p: np.ndarray
    #: c + 0.5 * |words|
    totals: np.ndarray
    #: factors of the counts over good documents and over all
    factors: np.ndarray


def train(docs: DataFrame, good_ids: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, Model]:
    """The ids of target documents and the common words' part of the models. good_ids: one column of ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    counted = cut(rows.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_words = counted.count()
    known = {r.word: i + 2 for i, r in enumerate(counted.orderBy(F.desc("n"), "word").limit(COMMON).collect())}
    shared = spark.sparkContext.broadcast(known)
    good = cut(good_ids.select(F.col(good_ids.columns[0]).alias("id")).distinct().withColumn("good", F.lit(True)), "good")
    cells = cut(_marked(rows, good).mapInArrow(_bigram_counts(shared), "cell long, n long, n_good long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good")), "cells")
    width = len(known) + 2
    found = cells.toPandas()
    counts = np.zeros((2, width * width))
    counts[0][found["cell"]], counts[1][found["cell"]] = found["n_good"], found["n"]
    # factors[model] = (of n_good, of n)
    factors = np.array([[1.0, 0.0], [0.0, 1.0]])
    if counts[0].sum() == 0:
        factors[0] = factors[1]
        counts[0] = counts[1]
    elif counts[1].sum():
        factors[1, 1] = counts[0].sum() / counts[1].sum()
        counts[1] *= factors[1, 1]
    counts = counts.reshape(2, width, width)
    totals = counts.sum((1, 2)) + 0.5 * (n_words + 2)
    p = (counts.sum(1) + 0.5) / totals[:, None]
    before = np.log(counts.sum(2) + MASS)
    logs = np.log(counts + MASS * p[:, None, :]) - before[:, :, None]
    logs[:, :, UNKNOWN] = -before
    logs[:, UNKNOWN, :] = 0
    return good, Model(known, logs.reshape(2, -1), p, totals, factors)


def _marked(rows: DataFrame, good: DataFrame) -> DataFrame:
    return rows.join(small_or_shuffled(good), "id", "left").select(*[c for c in rows.columns if c != "id"], F.coalesce("good", F.lit(False)).alias("good"))


class Codes(dict):
    """word -> its id if it is common, else a hash beyond all ids; dropped when it is full."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.known = known

    def __missing__(self, word: str) -> int:
        code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        self[word] = code = code if code < 0 or code >= 1 << 32 else ~code
        return code

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > COUNTED:
            self.clear()
            self.update(self.known)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


BLOBS = ("words", "times", "before", "after", "doc", "keys", "good")
KINDS = (np.uint64, np.int32, np.int64, np.int16, np.uint16, np.int64, np.bool_)


def _dealt(shared, n_parts: int):
    """Each occurrence of a word that is not common, with the word before and the common word after it, to the word's part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(shared.value.known)
        found, keys, goods, size = [], [], [], 0
        # Only says which rows come back to one place: sums are by document in the end, whatever chunk a retried task made.
        chunks = itertools.count(TaskContext.get().partitionId() << 32)

        def out() -> pa.RecordBatch:
            words, before, after = (np.concatenate([f[i] for f in found]) for i in range(3))
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            words = words.view(np.uint64)
            order = np.argsort(words)
            words, before, after, doc = words[order], before[order], after[order], doc[order]
            part = ((words >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(part, np.arange(n_parts + 1))
            key, good = np.array(keys, np.int64), np.array(goods, np.bool_)
            made, chunk = [], next(chunks)
            for k in range(n_parts):
                at = slice(ends[k], ends[k + 1])
                if at.start < at.stop:
                    own, times = np.unique(words[at], return_counts=True)
                    docs, local = np.unique(doc[at], return_inverse=True)
                    values = (own, times, before[at], after[at], local, key[docs], good[docs])
                    made.append([k, chunk, *[np.ascontiguousarray(v, t).tobytes() for v, t in zip(values, KINDS, strict=True)]])
            found.clear(), keys.clear(), goods.clear()
            columns = list(zip(*made, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]], ["part", "chunk", *BLOBS])

        for batch in batches:
            for text, key, good in zip(*(batch.column(c).to_pylist() for c in ("text", "key", "good")), strict=True):
                own = codes.of(tokens(text))
                common = (own >= 0) & (own < 1 << 32)
                at = np.flatnonzero(~common)
                if len(at):
                    before = np.concatenate([[EDGE], own[:-1]])[at]
                    after = np.concatenate([np.where(common, own, UNKNOWN)[1:], [EDGE]])[at].astype(np.int16)
                    found.append((own[at], before, after))
                    keys.append(key)
                    goods.append(good)
                    size += len(own)
                if size >= CHUNK or len(found) >= CHUNK_DOCS:
                    yield out()
                    size = 0
        if found:
            yield out()

    return deal


def _counts_of(inverse: np.ndarray, n: int, good: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """[target, background] counts of each of n things."""
    return factors @ np.stack([np.bincount(inverse, good, n), np.bincount(inverse, minlength=n)])


def _summed(shared):
    """A part's occurrences -> sums of the documents' log probabilities that hang on its words, by the chunk they came from."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words, before, after, key, good, chunks, ends = [], [], [], [], [], [], []
        for batch in batches:
            for chunk, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", *BLOBS)), strict=True):
                own, times, b, a, doc, keys, goods = (np.frombuffer(x, t) for x, t in zip(row, KINDS, strict=True))
                words.append(np.repeat(own, times))
                before.append(b)
                after.append(a)
                key.append(keys[doc])
                good.append(goods[doc])
                chunks.append(chunk)
                ends.append((ends[-1] if ends else 0) + len(b))
        if not words:
            return
        words, before, after, key, good = (np.concatenate(x) for x in (words, before, after, key, good))
        own, word = np.unique(words, return_inverse=True)
        more = after != EDGE
        n = _counts_of(word, len(own), good, model.factors)
        p = (n + 0.5) / model.totals[:, None]
        followed = _counts_of(word[more], len(own), good[more], model.factors)
        del words
        logs = np.where(more, -np.log(followed + MASS)[:, word], 0)
        # Bigrams that end in the word: sorted by word and predecessor.
        order = np.lexsort((before, word))
        first = np.concatenate([[True], (np.diff(word[order]) != 0) | (before[order][1:] != before[order][:-1])])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(first) - 1
        logs += np.log(_counts_of(pair, int(first.sum()), good, model.factors)[:, pair] + MASS * p[:, word])
        # Bigrams of the word and a common one.
        at = np.flatnonzero(after > EDGE)
        if len(at):
            width = model.p.shape[1]
            pairs, pair = np.unique(word[at] * width + after[at], return_inverse=True)
            logs[:, at] += np.log(_counts_of(pair, len(pairs), good[at], model.factors) + MASS * model.p[:, pairs % width])[:, pair]
        # A row's sums go back to the chunk that it came from: one row for each chunk and part, not for each document and part.
        for i, (chunk, n) in enumerate(zip(chunks, ends, strict=True)):
            at = slice(ends[i - 1] if i else 0, n)
            keys, doc = np.unique(key[at], return_inverse=True)
            sums = [np.bincount(doc, x[at], len(keys)) for x in logs]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (keys, *sums)]], ["chunk", "keys", "target", "background"])

    return add


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums -> a row for each document of a chunk."""
    found: dict[int, list] = {}

    def merged(parts: list) -> list:
        keys, doc = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(keys, *[np.bincount(doc, np.concatenate([p[i] for p in parts]), len(keys)) for i in (1, 2)])]

    for batch in batches:
        for chunk, *blobs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "keys", "target", "background")), strict=True):
            parts = found.setdefault(chunk, [])
            parts.append([np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.float64, np.float64), strict=True)])
            if len(parts) >= MERGED:
                found[chunk] = merged(parts)
    for parts in found.values():
        ((keys, target, background),) = merged(parts)
        for i in range(0, len(keys), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (keys, target, background)], ["key", "target", "background"])


def score(docs: DataFrame, good: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_tokens, target_loss, background_loss, score), losses per token in nats. docs: those of the training."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    bounded_batches(spark)
    ident, text, kind = F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string"), type_of(docs, id_column)
    # Rows equal in id and text share a key, and their sums are divided by their number.
    key = F.xxhash64(ident, text).alias("key")

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tables = shared.value.known, shared.value.logs
        for batch in batches:
            n, out = [], []
            for t in batch.column("text").to_pylist():
                ids = ids_of(t, vocabulary)
                n.append(len(ids))
                out.append(tables[:, cells_of(ids, len(vocabulary) + 2)].sum(1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), *[pa.array([o[i] for o in out], pa.float64()) for i in (0, 1)]], ["id", "key", "n_tokens", "t", "b"])

    rows = docs.select(ident.alias("id"), key, text.alias("text"))
    base = cut(rows.mapInArrow(common, f"id {kind}, key long, n_tokens long, t double, b double"), "common")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _marked(docs.select(ident.alias("id"), key, text.alias("text")), good).mapInArrow(_dealt(shared, n_parts), "part int, chunk long, " + ", ".join(f"{c} binary" for c in BLOBS))
    sums = dealt.repartitionById(n_parts, F.col("part")).mapInArrow(_summed(shared), "chunk long, keys binary, target binary, background binary")
    sums = sums.repartition(n_parts, "chunk").mapInArrow(_gathered, "key long, target double, background double")
    rest = sums.withColumn("copies", F.lit(0)).unionByName(base.select("key", F.lit(0.0).alias("target"), F.lit(0.0).alias("background"), F.lit(1).alias("copies")))
    rest = cut(rest.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("target", "background", "copies")]), "sums")
    found = base.join(rest, "key")
    loss = lambda c, r: F.when(F.col("n_tokens") > 0, -(F.col(c) + F.col(r) / F.col("copies")) / F.col("n_tokens"))
    found = found.select("id", "n_tokens", loss("t", "target").alias("target_loss"), loss("b", "background").alias("background_loss"))
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("id", id_column)
