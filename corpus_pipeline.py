"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mix and packing, in this order.

Each stage works on all rows that the one before kept; what it returns is written as Parquet and read again.  The
first four return the columns of documents, the last one the pieces of the packed sequences.  Each begins with the memory
that the one before leaves: stages differ in whether the JVM or Python needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard_join, mixing, packing, substring_dedup, toxicity
from textloom.llm.tokens import tokenizer_path
from textloom.session import give_back, scratch, ship


def _lengths(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text has them now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of one half or more) go."""
    give_back(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    give_back(spark)
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that occur twice go; a document that loses none keeps its text unchanged, white space included."""
    give_back(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring_dedup.remove_repeats(docs, keep_text=True, carry=others or None)
    fields = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"tl_carry.`{c}`") for c in others}
    return _lengths(cut.select(*[fields[c].alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what is taken in part is cut to the words taken."""
    give_back(spark)
    return _lengths(mixing.take(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    give_back(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]
#: Training a classifier and tokenising can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
