"""Shards by jump consistent hashing: a stable key and the shard count decide; no ring table is kept.

Keys may be of any type that hashes: whole numbers are keys themselves, others go by a 64-bit hash of their value.  Null
keys count as one key of their own.  Repeated rows keep their places: each gets its own slot.  Null texts are empty; very
long ones are measured whole, where they lie.  An empty table gives an empty result.  Columns besides the key and the
text are not read, so clashing names do no harm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Stages, placed, running_total, table
from .text import mix

SHARDS = 24
NULL_KEY = 0x6E756C6C


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: about 1/n of the keys move when the n-th shard is added, all into that shard."""
    key, b, j = keys.astype(np.uint64).copy(), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            b[live] = j[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            live = live[j[live] < shards]
    return b


def shard_of(key: Column, shards: int) -> Column:
    """Column form of jump() for keys of 64 bits."""

    @F.pandas_udf("int")
    def of(part: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in part:
            yield pd.Series(jump(mix(k.to_numpy().astype(np.int64).view(np.uint64)), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(NULL_KEY).cast("long")))


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; slots are gapless from 0 in a shard.

    The texts' sizes and sums are taken before anything is shuffled; a slot comes from exact running totals over the
    staged narrow rows, so that no shard meets in one task."""
    stages = Stages(docs.sparkSession, "shard")
    empty = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("doc_id"), (F.octet_length(empty) + 8).cast("long").alias("size"), F.crc32(empty.cast("binary")).alias("text_crc32"))
    whole = isinstance(narrow.schema["doc_id"].dataType, IntegralType)
    stable = F.col("doc_id") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    narrow = narrow.select("*", shard_of(stable, shards).alias("shard"), shard_of(stable, shards + 1).alias("grown_shard"))
    rows = placed(stages.write(narrow)).withColumn("_one", F.lit(1).cast("long"))
    out = running_total(rows, ["shard"], "_one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jump_sharding": op8_jump_sharding}
SQL: dict[str, str] = {}
