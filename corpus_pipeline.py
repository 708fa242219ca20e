"""The corpus pipeline: from raw documents to token files, each stage on all that the last one kept.

1. ``language_id`` drops texts whose language can't be told (null, no letter, or unsure);
2. ``simhash`` leaves one document of each near-duplicate group (five-word shingles, a Jaccard
   similarity of 0.8 or more);
3. ``decontaminate`` drops documents that hold a ten-word window of the benchmark;
4. ``mix`` repeats or drops documents so that sources come near their target weights;
5. ``tokens`` writes the mix as token shards and returns what it reads back from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontam, langid, mixing, simhash, token_output
from quillspark.llm.shared import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language models, tokens and the files' order can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
