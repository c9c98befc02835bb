"""From raw documents to training shards: quality rules, near duplicates, decontamination, source mix, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next stage reads it. All but
the last return the columns of ``documents``; what a stage rejects is gone for the stages after it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from barforge.llm import decontaminate, jaccard, mixing, quality, sharding
from barforge.llm._common import discard, materialize, read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage that ran last.
_left: list[str] = []


def stage(run: Stage) -> Stage:
    """A stage that first removes the intermediate tables of the one before, whose result has been written by then."""

    @wraps(run)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _left)
        before = set(written())
        out = run(spark, docs, sf_dir)
        _left[:] = [p for p in written() if p not in before]
        return out

    return tidy


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words and a similarity of 0.8 or more link."""
    return jaccard.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


@stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (up to twice) as the mix uses the block in which it begins."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


@stage
def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    return sharding.external_shuffle(docs.select(*COLUMNS), shards=40)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    before: list[str] = []
    for name, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, before)
        before = written()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)


#: Seeded permutations and hashes have no counterpart in SQL. Tests hold the rules against their SQL, near duplicates against
#: all pairs and shards against plain hashes; of decontamination and the mix they check planted cases and bounds, no plain version.
ORACLE_SQL = None
