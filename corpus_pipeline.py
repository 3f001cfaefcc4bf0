"""The training-corpus pipeline: language ID, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns of
documents. Null texts are rejected by the first stage as they hold no letter; null ids and sources pass through. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, langid, minmax_dedup, mixing, packing
from tessera.llm.shared import carried, cut, discard, load, mark, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those of whose words the model knows not even one character.

    `lang` stays as it is given. Without labelled rows there is no model, and nothing is rejected.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs
    rows = carried(docs).withColumn("text", F.col("row.text").cast("string"))
    return langid.identify(rows, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("known") > 0)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax_dedup.without_near_duplicates(docs, width=5, similarity=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a document once for each of its copies."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages rest on a trained model, seeded hashes and a tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on its way is deleted once its result is written."""
    docs, before = load(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        since = mark()
        found = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return found
        docs = cut(found, f"corpus-{name.replace(' ', '-')}")
        release(since, docs)
        discard(*before)
        before = [docs]
    return docs
