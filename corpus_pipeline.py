"""A corpus pipeline of five stages: quality, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.
A stage works on every row that the one before kept. Nulls, empty texts, repeated rows and empty tables have the
results that the operators' own docstrings define; rows without doc_id pass the filters on their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleforge.llm import byte_bpe, decontaminate, near_dup, quality_knn, surrogates
from titleforge.llm.common import Scratch, held, lean, table

#: Words of a shingle in the near_duplicates stage; op10's sets of two words are its own contract.
SHINGLE = 5

#: Bytes of text in a block of the tokens stage: less memory, and more disk, than the operator's own blocks.
BLOCK = 3 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for them; a classifier without labels keeps all."""
    lean(spark)
    model = quality_knn.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality_knn.score(docs, model, into="_score").where(F.col("_score") >= quality_knn.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by sets of SHINGLE words: that of the smallest id."""
    lean(spark)
    return near_dup.mark(docs, size=SHINGLE).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    lean(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; their lengths are counted anew."""
    lean(spark)
    out = surrogates.pseudonymise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    lean(spark, "4m")  # rows of its tables are whole blocks
    return byte_bpe.digests(docs, block=BLOCK)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The stages use trained models, keyed surrogates and a tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir))
        return held(STAGES[-1][1](spark, docs, sf_dir))
