"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage is (spark, docs, sf_dir) to a DataFrame; ``run`` writes each result
as Parquet in the shared folder and reads it back as the next one's input. All
but the last return the columns of ``documents``.

Each call of a stage has a folder of its own in the shared one for its intermediate
tables, and nothing else is ever deleted than such folders. ``run`` deletes a stage's
folder when the stage's result is written. Where the stages are called one by one, a
call deletes the folder that the last call of the stage before it made, unless its
input reads that; so a stage's result has to be written before the next stage is called.

For all stages: null ids and texts, empty and very long texts, ties, repeated
rows, empty tables and further columns, whatever their names, are as the
operators state; none fails on them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, importance, packing, quality_rules, simhash
from tessera.llm.common import delete, staged, workspace

#: The folder that the last call of each stage made.
_folders: dict[str, str] = {}


def in_own_folder(before: str | None = None):
    """Give each call of a stage a folder of its own; ``before``: the stage whose result is this one's input."""

    def wrap(stage):
        @wraps(stage)
        def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            left = _folders.get(before)
            if left and not any(left.rpartition("/")[2] in f for f in docs.inputFiles()):
                delete(spark, _folders.pop(before))
            with workspace(spark, stage.__name__) as folder:
                _folders[stage.__name__] = folder
                return stage(spark, docs, sf_dir)

        return call

    return wrap


@in_own_folder()
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the weighed quality rules reject: a null or empty text has too few words and goes; copies are judged alike."""
    return quality_rules.keep_sound(docs)


@in_own_folder("rules")
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what importance resampling leaves out; its models are fitted to the whole ``documents`` table, which has both kinds of labels.

    A text without words scores 0 and is judged by that; ties with the last row kept stay; without labels all rows stay.
    """
    raw, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.keep_sampled(docs, importance.fit(raw, labels))


@in_own_folder("classifier")
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of largest id of each set of equal texts; null texts are equal to empty ones, null ids are smallest."""
    return exact_dedup.keep_unique(docs)


@in_own_folder("exact")
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of smallest id of each component of linked fingerprints, then of each of texts alike by five-word shingles.

    Texts without words have fingerprint 0 and are one component; they have no shingles. Null ids come last.
    """
    return simhash.keep_one_each(docs)


@in_own_folder("near")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids; a text without tokens is one piece, its end id."""
    return packing.pack(docs, digests=True)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("exact dedup", exact), ("near-duplicates", near), ("best-fit packing", pack)]

#: Fitted models, tokenizers and fingerprints can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with workspace(spark, "pipeline") as folder:
            written = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # both are read no more: the stage's own tables, and its input
        delete(spark, _folders.pop(stage.__name__))
        if before:
            delete(spark, before)
        docs, before = written, folder
    return docs
