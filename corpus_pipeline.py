"""The corpus pipeline: five operators of strandloom.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller writes that as
Parquet and gives what it reads back to the next stage. All but the last return the columns
of ``documents``. When a stage begins, its predecessors' results are stored, so the scratch tables of
earlier stages, and no others, are deleted: a session runs one pipeline at a time.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import common as C
from strandloom.llm import decontamination, language, near_copies, packing, substring_dedup

#: Scratch tables of stages whose results may not be stored yet, by the stage's place.
_PENDING: dict[int, list[C.Scratch]] = {}


def _stage(place: int):
    """Stage ``place``: deletes what earlier stages left and keeps its own scratch tables apart."""

    def put(f):
        @wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for earlier in [p for p in _PENDING if p < place]:
                for scratch in _PENDING.pop(earlier):
                    scratch.delete()
            with C.Scratch(spark) as own:
                out = f(spark, docs, sf_dir)
            _PENDING.setdefault(place, []).append(own)
            return out

        return run

    return put


#: Below this share of its best language a text counts as being in no language.
LEAST_SCORE = 0.3


@_stage(0)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text in a known language: ``und``, or a best language of
    little share. The model is learned from the rows it is given that are not held out."""
    told = language.judge(docs, language.train(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(F.col("row.*"))


@_stage(1)
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id: texts
    whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_copies.representatives(docs)


@_stage(2)
def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words that repeat an earlier 20-word window; n_chars follows the text."""
    cut = substring_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@_stage(3)
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontamination.clean(docs, C.table(spark, sf_dir, "benchmark"))


@_stage(4)
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_removal),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained kernels, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's
    table is deleted when the next one's is written, the last when its pieces are."""
    docs, before = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with C.Scratch(spark) as table:
            docs = C.written(stage(spark, docs, sf_dir), name)
        if before:
            before.delete()
        before = table
    out = STAGES[-1][1](spark, docs, sf_dir)
    before.delete()
    return out
