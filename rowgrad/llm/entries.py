"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgrad.llm import cotraining, decontaminate, lexical, manifest, mixing, paragraphs, pieces, rules, sanitise, setjoin, substrings, toxicity, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in documents, by multi-pattern search."""
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("hits")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of documents, by co-training."""
    return cotraining.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that repeat others, by MinHash bands and components."""
    return paragraphs.paragraph_removals(_table(spark, folder, "documents"))


def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, and whether decoding them gives the text back."""
    docs = _table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the texts' digests go along in their place: decoded texts are compared by them
    encoded = pieces.encode(docs.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), ["doc_id", "digest"])
    decoded = pieces.decode(encoded, ["doc_id", "digest", "ids", "n_pieces"])
    return decoded.select("doc_id", "n_pieces", "ids", (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("digest")).alias("same_text"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages through archives and their capture index."""
    return warc.archived(_table(spark, folder, "pages"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data and terms that give it away."""
    return sanitise.personal_data(_table(spark, folder, "documents"))


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes under strings of 400 bytes that occur elsewhere."""
    return substrings.substring_removals(_table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of documents, by a convolutional net."""
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules, cheapest rejections first."""
    return rules.quality_rules(_table(spark, folder, "documents"))


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate documents and which of them stays, by a chosen-path join."""
    return setjoin.near_duplicates(_table(spark, folder, "documents"))


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    return mixing.mixed(_table(spark, folder, "documents"))


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents for every benchmark item, by bit-sliced signatures."""
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle proofs of all documents, and whether a tampered one is found out."""
    return manifest.manifest(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_quality, op3_paragraphs, op4_pieces, op5_warc, op6_pii, op7_substrings, op8_toxicity, op9_rules, op10_near_duplicates, op11_mixing, op12_lexical, op13_manifest, pipeline)
}
ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op5_warc": warc.ORACLE, "op9_rules": rules.ORACLE, "op12_lexical": lexical.ORACLE, "op13_manifest": manifest.ORACLE}
