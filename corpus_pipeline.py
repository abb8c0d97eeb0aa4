"""Documents to training tokens: quality rules, near copies, repeated passages, test items, pieces.

Each stage works on all that its predecessor kept; between stages the rows are written to the shared folder and read
again, so a lost executor repeats one stage at most. Part of the subpackage ``llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsevidence.llm.common import run_folder, staged
from newsevidence.llm.decontaminate import without_test_items
from newsevidence.llm.jaccard import one_of_each_group
from newsevidence.llm.pieces import encode_pieces
from newsevidence.llm.quality import good_documents
from newsevidence.llm.substrings import without_repeats
from newsevidence.session import apply_options


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade keeps."""
    return good_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts."""
    return one_of_each_group(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have."""
    return without_repeats(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_test_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document left, with digests of ids and decoded text."""
    from public_tokenizers import path

    coded = encode_pieces(docs, path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("substring dedup", repeats),
          ("benchmark decontamination", test_items), ("SentencePiece", pieces)]

#: The stages need hashing and alignment that SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = run_folder(apply_options(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, folder, f"stage{i}")
    return docs
