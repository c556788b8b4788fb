"""Corpus pipeline: quality filter, near-duplicate removal, substring dedup, source mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame that is written as Parquet before the next stage reads it. A stage's scratch tables are
deleted when the next stage starts, by when its output is written.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import mixing, near_dedup, packing, quality, substring
from gridloom.llm.queries import tokenizer_path
from gridloom.session import Scratch

#: Sampling, training and alignment have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None

_open: WeakKeyDictionary[SparkSession, Scratch] = WeakKeyDictionary()


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A scratch for this stage; that of the session's stage before, whose output is written by now, goes."""
    old = _open.pop(spark, None)
    if old is not None:
        old.drop()
    _open[spark] = Scratch(spark, name)
    return _open[spark]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score is under 0.5 (at 0.5 they stay). The classifier is fitted on this stage's labelled input.

    A null text is judged as an empty one, a very long one whole. Rows with null ids are judged like others, repeated rows
    alike. Of an empty table nothing is left. All columns stay, whatever their names.
    """
    _scratch(spark, "pipeline-quality")
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # columns go by position while the score is there, so that one of that name is kept
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = F.col(f"c{docs.columns.index('text')}").alias("text")
    scored = quality.score(plain.select("*", text), network).where("score >= 0.5")
    return scored.select(*plain.columns).toDF(*docs.columns)


def order_minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest doc_id stays, and one row of those repeated under that id.

    Texts without words (null, empty, blank) are copies of each other. Rows with a null doc_id stay. Other columns do not matter.
    """
    return near_dedup.keep_one(docs, _scratch(spark, "pipeline-near"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that a document with a smaller doc_id has; n_chars follows the text.

    Null and empty texts stay as they are, also texts that lose all their words. A null doc_id counts as the largest; rows of one
    doc_id do not cut each other. Columns n_words and n_removed of the input are kept.
    """
    own = [c for c in docs.columns if c in ("n_words", "n_removed")]
    cut = substring.dedup(docs.withColumnsRenamed({c: f"__{c}" for c in own}), _scratch(spark, "pipeline-substring")).drop("n_words", "n_removed")
    cut = cut.withColumnsRenamed({f"__{c}": c for c in own})
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: 0, 1 or 2 times. Repeated rows are drawn each for itself, null sources are one source."""
    return mixing.mix(docs, _scratch(spark, "pipeline-mixing"))


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 4096-token sequences; a document that the mixture repeats is packed each time, a null or empty text as its end token."""
    return packing.pack(docs, tokenizer_path(), scratch=_scratch(spark, "pipeline-packing"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("order_minhash_dedup", order_minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("retrieval_packing", retrieval_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = Scratch(spark, "pipeline-stages")
    for name, stage in STAGES[:-1]:
        docs = between.save(stage(spark, docs, sf_dir), name)
    out = STAGES[-1][1](spark, docs, sf_dir)  # its tokens are written, so the stages' tables are no longer read
    between.drop()
    return out
