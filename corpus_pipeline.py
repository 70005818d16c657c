"""Training-data pipeline over documents: quality, near-duplicates, decontamination, personal data, token ids and back.

``python -c "..."`` or ``spark-submit`` jobs call ``run(spark, folder)``. Each stage's rows are written below the shared folder and read by the
next, so that a lost executor or a failed stage repeats that stage alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgrad.llm import cotraining, decontaminate, pieces, sanitise, setjoin
from rowgrad.llm.texts import free, put


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BASE = ("doc_id", "text", "lang", "source", "n_chars")
EXTRA = "corpus_pipeline_extra"
# What Spark hands to a Python worker at a time. Its own limit is a number of rows, whatever their texts take, on both sides of the pipe.
BATCH_BYTES = 2 << 20


def _apart(stage: Stage) -> Stage:
    """``stage`` for documents with further columns of any names: they go along in one struct, so that they clash with nothing."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = [c for c in docs.columns if c not in BASE]
        if not extra:
            return stage(spark, docs, sf_dir)
        # by place: names may differ in case only
        packed = docs.select(*BASE, F.struct(*[F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(extra)]).alias(EXTRA))
        out = stage(spark, packed, sf_dir)
        added = [c for c in out.columns if c not in BASE and c != EXTRA]
        back = [F.col(EXTRA)[f"e{i}"].alias(c) for i, c in enumerate(extra) if c not in added]
        return out.select(*BASE, *back, *added)

    return run_stage


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject. Null and empty texts are scored like others; without labels all stay."""
    return cotraining.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id.

    Sets of five-word shingles, similarity 0.8. Texts without words stay, rows without doc_id stay unless linked with one that has it; of rows that
    repeat a doc_id the ones with equal texts stay or go together.
    """
    found = setjoin.near_duplicates(docs, size=5)
    gone = put(found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    kept = put(found.where("kept").select(F.col("doc_id").alias("__gone")).distinct(), "kept")
    # a repeated doc_id with different texts may be on both sides: it stays
    gone = gone.join(kept, "__gone", "left_anti")
    return docs.join(gone, docs.doc_id == gone["__gone"], "left_anti").select(*docs.columns)


@_apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark windows. Null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_apart
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that give it away replaced in their texts; null texts stay null."""
    return sanitise.clean_documents(docs)


@_apart
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids, n_pieces and same_text: does decoding the ids give the text back? Null and empty texts have no ids.

    Columns of these names in the table give way.
    """
    return pieces.round_trip(docs, docs.columns)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

# A trained classifier and a subword vocabulary aren't expressible in SQL; tests compare with a plain version.
ORACLE_SQL = None


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, batches of rows for Python workers take about ``BATCH_BYTES``; a setting of the session's own comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with small_batches(spark):
        for name, stage in STAGES:
            docs = put(stage(spark, docs, sf_dir), f"stage-{name}")
            if before is not None:
                free(before)
            before = docs
    return docs
