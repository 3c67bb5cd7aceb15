"""From raw documents to packed training sequences: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns what stays of docs, with the columns of documents; the last returns
the pieces of the packed sequences.  run() writes each stage's result to the shared folder and reads it again, so a
lost executor costs the running stage's tasks and no more.

Documents with a null or an empty text are scored as texts without words, link with nothing, and pack as their end token
if they are kept; of rows with one id one stays, those with a null id all stay; very long texts are handled whole;
columns beyond those of documents travel along, whatever their names, and the last stage drops them; an empty table
gives no pieces; without labels of both classes no document counts as toxic unless all labels say so, and all count as
good if all labels do (by the share of labels, 0.5 without any)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import minhash, packing, quality, toxicity
from loomgraph.llm.common import Stages, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels").where(toxicity.remainder(3) != 1))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.only_good(docs, table(spark, sf_dir, "labels").where(toxicity.remainder(4) != 2))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", toxic_out), ("quality", poor_out), ("near-duplicates", copies_out), ("packing", packed)]

#: Trained models and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stages.write(stage(spark, docs, sf_dir))
        if k:  # what the stage before wrote has been read
            stages.drop(before)
    return docs
