"""From raw documents to token files: five corpus operators one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of ``documents``; the last writes the token files and returns a row per written document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm import decontam, minhash, mix, token_blocks, toxicity
from sitegauge.llm.common import stored, table


#: Pieces that the tokenizer's processes remember; they hold the memory of the other stages too.
MEMO = 100_000


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the training folds."""
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of test items are cut out; documents that are mostly test items go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; per document its place in them."""
    return token_blocks.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=MEMO)


STAGES = [("toxicity", toxic), ("minhash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("mixing sources", weights), ("token output", tokens)]

#: SQL can express neither the trained classifier nor the tokenizer; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
