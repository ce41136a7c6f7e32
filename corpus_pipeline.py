"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents, under
their names, whatever these are.

Defined results of all stages: null texts count as empty (the quality rules reject them); rows with
a null id are rows like others; an empty table passes through; ties go to the smaller id; texts are
read whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bag_minhash, block_anchors, packing, quality_rules, secret_links
from quarry.llm.common import delete, released, shared_path, table
from quarry.llm.queries import vocabulary

#: No SQL has these rows: the decision list is learnt and the ids are a tokenizer's.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the decision list keeps; repeated rows each get their verdict."""
    df, _, result = quality_rules.judged(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))
    return df.where(F.col(f"{result}.kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id; rows without words stay."""
    return bag_minhash.deduplicated(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur earlier; those left without words go.

    Documents that lose nothing keep their text as it is; what is left of others is joined by spaces.
    """
    out = block_anchors.remove_repeats(docs, whole=True)
    kept = F.col(out.columns[-1])
    out = out.where((F.col("n_words") > F.col("n_removed")) | (F.col("n_words") == 0)).withColumn("text", kept)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with reported secrets cut out; null texts stay null."""
    return secret_links.redacted(docs, length="n_chars")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in the training sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", substrings), ("secrets", secrets), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves goes once the next one is written, or fails."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = shared_path(spark, name.replace(" ", "-"))
        try:
            with released(spark):
                stage(spark, docs, sf_dir).write.parquet(at)
        except BaseException:
            delete(spark, at)
            raise
        finally:
            if last is not None:
                delete(spark, last)
        docs, last = spark.read.parquet(at), at
    return docs
