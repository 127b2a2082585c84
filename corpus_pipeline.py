"""Training-corpus pipeline: stages over `documents`, each written as Parquet before the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents. SQL cannot express language
identification or MinHash, so ORACLE_SQL is None and the stages are tested separately.
"""

from __future__ import annotations

from procura.llm import decontaminate, language, mixing, near_dup, shards
from procura.llm.common import table, written


def keep_known_languages(spark, docs, sf_dir):
    """Language identification; documents of no known language go, others carry what was found."""
    return language.accepted(docs)


def keep_one_of_near_copies(spark, docs, sf_dir):
    """One document of each near-duplicate component stays, that of the smallest doc_id (nulls last)."""
    return near_dup.one_of_each(docs)


def remove_benchmark(spark, docs, sf_dir):
    """Contaminated documents go; of others, matching spans are cut out."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark, docs, sf_dir):
    """Documents as often as their fitted rates say."""
    return mixing.apply_rates(docs, table(spark, sf_dir, "labels"))


def place_in_shards(spark, docs, sf_dir):
    """Shard and slot of every document."""
    return shards.shard(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_domains),
    ("sharding", place_in_shards),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
