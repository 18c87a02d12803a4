"""A training corpus from raw documents: stages in turn, each written as Parquet and read again."""

import public_tokenizers

from thrustlog.llm import exact_dedup, packing, quality_rules, simhash, toxicity
from thrustlog.session import stored_table

VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 50_000  # words a worker keeps encoded; its memory is shared with the other stages'


def quality(spark, docs, sf_dir):
    """Documents that every quality rule accepts."""
    return quality_rules.accepted(docs)


def clean(spark, docs, sf_dir):
    """Documents that the toxicity model, trained on the labels of those that are left, does not reject."""
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def distinct(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def unlike(spark, docs, sf_dir):
    """One document of each group of linked SimHash fingerprints."""
    return simhash.deduplicated(docs, width=4, distance=4)


def pack(spark, docs, sf_dir):
    """Pieces of the documents in windows of 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path(VOCABULARY), size=1024, end_id=0, remembered=REMEMBERED)


STAGES = [("quality", quality), ("toxicity", clean), ("exact_dedup", distinct), ("simhash", unlike), ("packing", pack)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
