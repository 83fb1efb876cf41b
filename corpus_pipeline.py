"""From documents to packed sequences: five operators of sparkweft.llm, each over all that the one before kept.

Language ID drops documents in no known language, the n-gram Jaccard join keeps one document of each
group of near duplicates, decontamination drops documents with benchmark passages, PII sanitises the
texts, and packing makes sequences of them.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkweft.llm import common, decontamination, jaccard, language, packing, pii
from sparkweft.llm.folder import Folder

#: Near duplicates of the pipeline: five words and 0.8. op3_jaccard_join keeps the contract's four words and 0.85.
NEAR = jaccard.Rule(5, Fraction(80, 100))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language the model knows and that holds at least half of the text."""
    model, name = language.train(docs.where(~language.held_out())), common.free("language", docs.columns)
    return language.accepted(language.identify(docs, model, name), model, name=name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of linked documents."""
    return jaccard.distinct(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs of whose words less than one in twenty lies in benchmark windows, or none."""
    name = common.free("contamination", docs.columns)
    found = decontamination.scan(docs, common.table(spark, sf_dir, "benchmark"), name=name)
    return found.where(f"NOT {name}.contaminated").drop(name)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data masked and the terms that reveal it removed or generalised."""
    name = common.free("pii", docs.columns)
    return pii.sanitise(docs, name=name).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all docs in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", sanitise),
    ("packing", pack),
]

#: Trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again.

    A result goes once the next one is written. The last one that is written stays, since the rows
    returned are computed from it.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                Folder(f"{folder}/{i - 1}").delete()
    return docs
