"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns all that it keeps; run() writes each
result to the shared folder and reads it again as the next stage's docs. All but the last
return the columns of documents, other ones that docs has among them. Null or empty texts fail the quality rules, so later stages
see them only when they are run alone, and each operator's docstring says what it does then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import decontaminate, mixing, quality, simhash, suffixes
from heddle.llm.shared import discard, drop, scope, shared_dir, stored, table


def _packed(docs: DataFrame) -> DataFrame:
    """docs with all columns but the text in one, so that none can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("__doc"), "doc_id", "lang", "text")


def _unpacked(out: DataFrame, columns: list[str]) -> DataFrame:
    return out.select(*[F.col("text") if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    found = stored(quality.features(_packed(docs)), "quality")
    return _unpacked(quality.quality_rules(found, table(spark, sf_dir, "labels")).filter("kept"), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or fingerprints within two bits) the document with the least doc_id (of repeated rows, one)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))
    groups = simhash.near_dedup(keyed, shingle=5, key="__key", similarity=0.8)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__first")).distinct()
    return keyed.join(first, F.col("__key") == F.col("__first"), "left_semi").dropDuplicates(["__key"]).drop("__key")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that occurred before; n_chars is counted anew."""
    out = _unpacked(suffixes.suffix_dedup(_packed(docs), keep=["__doc", "text"], replace=True), docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    out = decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["__doc", "text"])
    return _unpacked(out.filter("not contaminated"), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, n_tokens, epoch, position."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: SQL can't express the near duplicates' fingerprints; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def scratch_folder(spark: SparkSession) -> str:
    """Where the stages store what they need on the way."""
    return f"{shared_dir(spark)}/heddle".removeprefix("file:")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; of all that they store only the last result stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scope() as held:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
        for path in held:
            if path != docs.stored_at:
                discard(spark, path)
        if before is not None:
            drop(before)  # what the stage read
        before = docs
    return docs
