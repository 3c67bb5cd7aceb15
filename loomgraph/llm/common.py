"""What the operators share: staged tables, shared files, exact running totals, sums of arrays, skew-proof joins,
components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key holding more than this share of the rows is joined by broadcast; there are at most 1/HOT_SHARE such keys.
HOT_SHARE = 1e-3
#: Rows that one window of a running total holds at most.
BLOCK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a session whose executors run in the
    driver's own process may do without it, as in tests; on a cluster no folder of one machine would do."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = os.path.join(tempfile.gettempdir(), "checkpoints")
    return got.rstrip("/")


def drop_stage(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Stages:
    """Tables that one call writes to the shared folder to cut lineage: a lost executor's work is read again from
    them, not computed again from the start.  A stage is dropped as soon as its readers have run; those that the
    returned DataFrame reads live on until drop_all() or the folder's own cleaning."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *stages: DataFrame) -> None:
        drop_stage(self.spark, *(s._stage_path for s in stages))

    def drop_all(self) -> None:
        drop_stage(self.spark, self.base)


class Folder:
    """A folder that driver and executors share.  Files are mapped where it is mounted; from another store they are
    copied to a nameless local file that goes with the process.  A file appears whole or not at all, so a repeated task
    does no harm."""

    def __init__(self, uri: str):
        self.local = uri.removeprefix("file:") if uri.startswith("file:") or "://" not in uri else None
        if self.local is not None:
            self.local = "/" + self.local.lstrip("/")
        self.uri = uri

    def write(self, name: str, x: np.ndarray) -> None:
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            temp = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(temp, "wb") as f:
                f.write(x.tobytes())
            os.replace(temp, f"{self.local}/{name}")
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.uri)
            store.create_dir(path)
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(x.tobytes())

    def map(self, name: str, kind: str) -> np.ndarray:
        if self.local is not None:
            path = f"{self.local}/{name}"
            return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(f"{path}/{name}").size in (None, 0):
            return np.zeros(0, kind)
        with tempfile.TemporaryFile() as f:
            with store.open_input_stream(f"{path}/{name}") as s:
                while part := s.read(1 << 20):
                    f.write(part)
            f.flush()
            return np.memmap(f, kind, "r")


#: Entries of an array that travel in one row, and groups of tasks whose sums are added first.
PACK, SALTS = 1 << 15, 64


def packed(x: np.ndarray) -> pa.RecordBatch:
    """An array of whole numbers as rows for add_up: stretches of PACK, each in the narrowest type that holds it;
    stretches of zeros are left out."""
    rows = []
    for i in range(0, len(x), PACK):
        part = x[i : i + PACK]
        top = int(np.abs(part).max())
        width = 1 if top < 1 << 7 else 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        if top:
            rows.append((i // PACK, width, part.astype(f"<i{width}").tobytes()))
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "width", "part"])


PACKED = "chunk int, width int, part binary"


def add_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' arrays of `size` whole numbers, sent as rows of packed().  A stretch is added up in SALTS
    groups of tasks first, so that no task reads a row of every task; the driver gets size / PACK rows.  Sums of whole
    numbers don't depend on their order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, width, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(part.as_buffer(), f"<i{width}")
                if k in sums:
                    sums[k] += own
                else:
                    sums[k] = own.astype(np.int64)
        for k, x in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([8], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "width", "part"])

    some = parts.withColumn("_salt", F.spark_partition_id() % SALTS).repartition("chunk", "_salt").select("chunk", "width", "part").mapInArrow(add, PACKED)
    out = np.zeros(size, np.int64)
    for r in some.repartition("chunk").mapInArrow(add, PACKED).collect():
        own = np.frombuffer(r["part"], "<i8")
        out[r["chunk"] * PACK : r["chunk"] * PACK + len(own)] += own
    return out


def placed(stage: DataFrame) -> DataFrame:
    """A staged table with its rows' stable places: _file and _row (the place in that file)."""
    return stage.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


#: Bits of a filter of ids, in stretches of one bitmap each; a fixed size.
FILTER_BITS, STRETCH = 1 << 24, 1 << 15


def id_filter(rows: DataFrame, column: str):
    """A test for other tables' ids (long): true for those in the column, and for few others.  It is of one size, so that
    it may be broadcast whatever the table's size; what it lets through too many, a join takes out."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("long")
    of = rows.select(place(F.col(column)).alias("h"))
    bits = of.groupBy((F.col("h") / STRETCH).cast("int").alias("at")).agg(F.bitmap_construct_agg(F.col("h") % STRETCH).alias("bits"))
    mask = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.collect():  # FILTER_BITS / STRETCH rows of 4 KB at most
        mask[r["at"] * STRETCH // 8 : (r["at"] + 1) * STRETCH // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(mask)

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        x = h.to_numpy()
        return pd.Series((held.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    return lambda name: passes(place(F.col(name)))


def running_total(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that stand before, in order of (_file, _row).

    Exact without one task per key: sums of blocks of BLOCK rows, then of the blocks of a file, then of files.  A
    window never holds more than BLOCK rows, the blocks of one file, or the list of files."""
    rows = rows.withColumn("_block", F.floor(F.col("_row") / BLOCK))
    before = lambda *by: Window.partitionBy(*keys, *by).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    safe = [F.col(k) for k in keys]
    blocks = rows.groupBy(*safe, "_file", "_block").agg(F.sum(value).alias("_sum"))
    files = blocks.groupBy(*safe, "_file").agg(F.sum("_sum").alias("_all"))
    files = files.select(*keys, "_file", zero(F.sum("_all").over(before().orderBy("_file"))).alias("_f0"))
    blocks = blocks.select(*keys, "_file", "_block", zero(F.sum("_sum").over(before("_file").orderBy("_block"))).alias("_b0"))
    base = null_safe(blocks, files, [*keys, "_file"]).select(*keys, "_file", "_block", (F.col("_b0") + F.col("_f0")).alias("_base"))
    inner = rows.withColumn("_in", zero(F.sum(value).over(before("_file", "_block").orderBy("_row"))))
    return null_safe(inner, base, [*keys, "_file", "_block"]).withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base", "_block")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the right side's keys go."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return left.join(right, cond, how).drop(*names.values())


def skew_join(left: DataFrame, groups: DataFrame, key: str, count: str, total: int, scatter: list[str] | None = None) -> DataFrame:
    """Left join of rows to a table with one row per key, even if one key holds most of the rows.

    Keys with more than HOT_SHARE of the `total` rows (so at most 1/HOT_SHARE of them, a proven bound) are broadcast;
    their rows then carry a scattered key (made of the columns `scatter`) through the shuffle join that serves all
    others.  Null keys match nothing."""
    cols = [c for c in groups.columns if c != key]
    cut = max(1000.0, total * HOT_SHARE)
    hot = groups.where(F.col(count) > cut).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in cols])
    cold = groups.where(F.col(count) <= cut).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in cols])
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_jk", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("~"), F.xxhash64(*(scatter or left.columns)).cast("string"))))
    out = out.join(cold, F.col("_jk") == F.col("_ck"), "left")
    return out.select(*left.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in cols])


def components(stages: Stages, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b: long): component is the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes; each step is a partly aggregated minimum by node
    and an equi-join (which Spark's adaptive execution splits where a hub is hot); never a group in one task."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stages.write(pairs)
    last = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
        large = pairs_of(both, low, "b > a")
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        joined = large.join(low, F.col("a") == F.col("n"))
        small = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select("b", "m")).where("a <> b").distinct()
        new = stages.write(small)
        mark = new.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        stages.drop(pairs)
        pairs = new
        if mark == last or not mark[0]:
            break
        last = mark
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    flat = pairs.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return flat.union(pairs.select("b", "b").distinct()).groupBy("node").agg(F.min("component").alias("component"))


def pairs_of(both: DataFrame, low: DataFrame, cond: str) -> DataFrame:
    """Each node's neighbours that satisfy cond, tied to that node's smallest neighbour."""
    return both.where(cond).join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
