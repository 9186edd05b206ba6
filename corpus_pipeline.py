"""The corpus pipeline: five stages over ``documents``, each a call of one operator of ``rangeloom.llm``.

All stages but the last take and return rows with the columns of ``documents`` (and any others that
come along); the last returns where each piece of each document is packed.

Defined cases: a null, empty or letterless text goes in the first stage; of repeated rows one stays
after the second; a null source is a source of its own in mixing and packing; a null ``doc_id`` stays
only where its text, or its group of like texts, has no row with an id; rows without labels of a
language are never learnt from; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm.common import free, freed
from rangeloom.llm.exact_dedup import keep_first
from rangeloom.llm.language import known_language
from rangeloom.llm.mixing import mixed
from rangeloom.llm.packing import pack
from rangeloom.llm.similarity import similar_groups
from rangeloom.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or unlike any language learnt, go."""
    return known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the smallest doc_id stays."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each group of texts linked by similarity the smallest doc_id stays."""
    return keep_one(docs, similar_groups(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document is there as often as the mix takes it."""
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing under source and duplicate conflicts."""
    return pack(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("packing", packed),
]

#: Language models, XXH64 and the search for bins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written to the shared folder and read back, and
    what a stage was made from goes when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with freed(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        free(spark, *before)
        before = [docs.stored_at]
    return STAGES[-1][1](spark, docs, sf_dir)
