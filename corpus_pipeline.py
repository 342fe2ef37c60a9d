"""Documents to training sequences in five stages, each written and reread.

quality rules -> line dedup -> near-duplicates -> benchmark decontamination -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from foliant.llm.common import materialize, read_table
from foliant.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects, unchanged."""
    return quality_rules.judge(quality_rules.ledger(docs)).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in an earlier one; those left without any word go. ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return _recount(out.where(left), docs, F.col("n_removed") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of similar ones, the smallest by id, and one row of each equal (id, text); rows without an id stay."""
    groups = near_dedup.near_duplicates(docs, one_document=False).where("chosen and doc_id is not null").select("doc_id", F.col("text_hash").alias("__hash")).distinct()
    # the join has brought the rows of an id and text together
    marked = docs.where("doc_id is not null").withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    chosen = marked.join(groups, ["doc_id", "__hash"], "left_semi").dropDuplicates(["doc_id", "__hash"])
    return docs.where("doc_id is null").unionByName(chosen.select(*docs.columns))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover; those left without any word go."""
    out = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), cut=True)
    left = (F.size("spans") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return _recount(out.where(left), docs, F.size("spans") > 0)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path(), ids="crc32")


def _recount(out: DataFrame, docs: DataFrame, changed) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("benchmark decontamination", benchmarks), ("best-fit packing", sequences)]
#: SQL can't tokenize; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
