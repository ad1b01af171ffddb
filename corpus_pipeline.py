"""A training corpus from raw documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from quirewise.llm import dartminhash, decontaminate, quality, raking, sstable
from quirewise.llm.common import materialize, table


def quality_filter(spark, docs, sf_dir):
    """Documents that the quality classifier accepts; it learns from all documents that are labelled."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return dartminhash.deduplicated(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Documents drawn so that tokens meet the target margins."""
    return raking.mixed(docs)


def token_output(spark, docs, sf_dir):
    """Token ids of each document, written to shards and read back."""
    return sstable.token_shards(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
#: Training, signatures and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
