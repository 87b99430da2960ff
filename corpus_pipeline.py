"""The training-corpus pipeline: reject toxic documents, keep one document of each near-duplicate group, cut long repeats, mix the
sources to target weights, pack the tokens into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``documents``.

Defined cases: null texts count as empty everywhere; empty texts are not toxic (unless most examples are), are near-duplicates of each
other, weigh one token in the mix and are packed as the end token; of near-duplicates the smallest doc_id stays, then the least text
hash, and a null doc_id only where there is no other; of a repeated span the place in the smallest doc_id stays; very long texts are read
whole by every stage; empty tables give empty tables with their columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbena.llm.mixing import mix_copies
from verbena.llm.near_copies import one_of_near_copies
from verbena.llm.packing import pack
from verbena.llm.queries import read, tokenizer_file
from verbena.llm.shared import MADE, materialize, sweep
from verbena.llm.simhash import one_of_each
from verbena.llm.substring_dedup import without_repeats
from verbena.llm.toxicity import without_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose calibrated toxicity is below one half."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash fingerprints within two bits, then one of each group linked by a Jaccard
    similarity of 0.8 or more of five-word shingles: fingerprints leave most such pairs further than two bits apart."""
    return one_of_near_copies(one_of_each(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words covered by 20-word windows that start earlier; wholly covered ones go."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights are raked to the targets of source, language and topic; scarce kinds come more than once."""
    return mix_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document's tokens with its sequence and offset."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; first it deletes what the stage before wrote besides its result, which has to be written by then."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, LEFT)
        since = len(MADE)
        out = stage(spark, docs, sf_dir)
        LEFT.extend(MADE[since:])
        return out

    return run_stage


#: What the last stage wrote besides its result.
LEFT: list[tuple[str, str]] = []

STAGES = [
    ("toxicity", tidy(reject_toxic)),
    ("simhash_dedup", tidy(keep_one_of_each)),
    ("substring_dedup", tidy(cut_repeats)),
    ("mixing", tidy(mix_sources)),
    ("packing", tidy(pack_sequences)),
]

#: Fingerprints, tokens and nearest neighbours are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    sweep(spark, LEFT)
    return docs
