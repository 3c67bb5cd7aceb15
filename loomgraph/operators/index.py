"""An approximate index for search by cosine: vectors by the nearest of some centres, of which a search looks into a few.

The centres are fitted on SAMPLE vectors at most (those with the least hashes of their ids), every vector is indexed, and
the number of cells that a search looks into is the least with the wanted recall on the sample.  Scores are exact, so
what a search returns is right and what it may miss is measured (recall())."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import GraphError
from . import search
from .graph import upsert

#: Rows that a worker makes at a time when it places them in cells.
OUT = 8192


@dataclass(frozen=True)
class IndexConfig:
    """sample: vectors that the centres are fitted on at most.  cells: most of them; one cell for each 16 vectors of the
    sample is the rule.  recall: share of the true neighbours that a search is to find, of `neighbours` each."""

    sample: int = 20_000
    cells: int = 1024
    recall: float = 0.95
    neighbours: int = 10
    seed: int = 1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centres_of(x: np.ndarray, n: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; an empty cell's centre moves to a vector that is far from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T
        of = near.argmax(1)
        for c in np.flatnonzero(np.bincount(of, minlength=n) == 0):
            far = int(near[np.arange(len(x)), of].argmin())
            of[far], near[far] = c, 2.0
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = unit(sums)
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, config: IndexConfig) -> int:
    """The cells to look into so that the wanted share of the sample's neighbours is found."""
    asked = x[: min(len(x), 500)]
    s = asked @ x.T
    s[np.arange(len(asked)), np.arange(len(asked))] = -3
    k = min(config.neighbours, len(x) - 1)
    if k < 1:
        return len(centres)
    found = np.argpartition(-s, k - 1, axis=1)[:, :k]
    of = (x @ centres.T).argmax(1)
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    need = np.sort(np.take_along_axis(rank, of[found], 1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(config.recall * len(need))))]) + 1


def placed(batch: pa.RecordBatch, centres: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, embedding) once for each of their n nearest cells, about OUT of them at a time."""
    x, step = search.doubles(batch.column(1)), max(1, OUT // n)
    if x.shape[1] != centres.shape[1]:
        raise ValueError("bad_request: embedding dimension mismatch")
    for a in range(0, len(x), step):
        near = unit(x[a : a + step]) @ centres.T
        cell = np.argsort(-near, axis=1, kind="stable")[:, :n] if n > 1 else near.argmax(1)[:, None]
        out = batch.take(pa.array(a + np.repeat(np.arange(len(cell)), cell.shape[1])))
        yield pa.record_batch([*out.columns, pa.array(cell.ravel().astype(np.int32))], names=[*batch.schema.names, "_block"])


@dataclass(frozen=True)
class VectorIndex:
    """vectors: id, embedding, _cell.  Immutable: changes give a new one."""

    vectors: DataFrame
    centres: np.ndarray
    probes: int
    config: IndexConfig
    id_: str
    embedding: str

    @classmethod
    def build(cls, vectors: DataFrame, config: IndexConfig = IndexConfig(), id_: str = "vec_id", embedding: str = "embedding") -> VectorIndex:
        rows = search.usable(vectors, id_, embedding)
        sample = rows.orderBy(F.xxhash64(id_, F.lit(config.seed)), id_).limit(config.sample).collect()  # config.sample rows at most
        if not sample:
            raise GraphError("bad_request", "an index needs vectors")
        if len({len(r[1]) for r in sample}) > 1:
            raise GraphError("bad_request", "embedding dimension mismatch")
        x = unit(np.array([r[1] for r in sample]))
        centres = centres_of(x, max(1, min(config.cells, len(x) // 16)), config.seed)
        empty = cls(rows.limit(0), centres, probes_for(x, centres, config), config, id_, embedding)
        return replace(empty, vectors=empty._placed(rows, 1).withColumnRenamed("_block", "_cell"))

    def _placed(self, rows: DataFrame, cells: int) -> DataFrame:
        """Rows once for each of their nearest cells, with _block."""
        held = rows.sparkSession.sparkContext.broadcast(self.centres)  # config.cells at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from placed(batch, held.value, cells)

        return rows.mapInArrow(run, f"{self.id_} long, {self.embedding} {rows.schema[self.embedding].dataType.simpleString()}, _block int")

    # -- changes

    def insert(self, rows: DataFrame) -> VectorIndex:
        """New vectors, and vectors that take the place of those with their ids; the centres stay."""
        new = self._placed(search.usable(rows, self.id_, self.embedding), 1).withColumnRenamed("_block", "_cell")
        return replace(self, vectors=upsert(self.vectors, new, [self.id_]))

    def remove(self, ids: DataFrame) -> VectorIndex:
        return replace(self, vectors=self.vectors.join(ids.select(self.id_), self.id_, "left_anti"))

    # -- questions

    def contains(self, ids: DataFrame) -> DataFrame:
        """id, found for each id asked for."""
        here = self.vectors.select(self.id_, F.lit(True).alias("_f"))
        return ids.select(self.id_).distinct().join(here, self.id_, "left").select(self.id_, F.coalesce("_f", F.lit(False)).alias("found"))

    def search(self, query: list[float], k: int) -> DataFrame:
        """(id, score) of the k nearest in the cells that are looked into, ties by id.  Of an index that was written by
        cell, the other cells aren't read."""
        if len(query) != self.centres.shape[1]:
            raise GraphError("bad_request", "embedding dimension mismatch" if query else "the query vector is empty")
        near = self.centres @ unit(np.array([query], np.float64))[0]
        cells = np.argsort(-near, kind="stable")[: self.probes].tolist()
        return search.similar(self.vectors.where(F.col("_cell").isin(cells)), query, k, self.id_, self.embedding)

    def neighbours(self, k: int, queries: DataFrame | None = None) -> DataFrame:
        """As search.nearest_neighbours, but each query meets the vectors of the cells that it looks into.  A crowded
        cell's queries are split into blocks."""
        rows = search.usable(queries, self.id_, self.embedding) if queries is not None else self.vectors.select(self.id_, self.embedding)
        asks = self._placed(rows, self.probes)
        crowd = asks.groupBy("_block").agg(F.count("*").alias("_n"))
        parts = crowd.select("_block", F.ceil(F.col("_n") / search.BLOCK).cast("int").alias("_parts"))  # a row for each cell
        asks = asks.join(F.broadcast(parts), "_block").withColumn("_group", F.pmod(F.xxhash64(self.id_), F.col("_parts")).cast("int"))
        given = self.vectors.withColumnRenamed("_cell", "_block").join(F.broadcast(parts), "_block").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        return search.meet(asks, given, k, self.id_, self.embedding)

    def recall(self, k: int, queries: DataFrame) -> float:
        """Share of the true k nearest of the queries that neighbours() finds."""
        true = search.nearest_neighbours(self.vectors, k, self.id_, self.embedding, queries).select(self.id_, "neighbour")
        own = self.neighbours(k, queries).select(self.id_, "neighbour").withColumn("_f", F.lit(1))
        n, hit = true.join(own, [self.id_, "neighbour"], "left").agg(F.count("*"), F.count("_f")).head()
        return hit / n if n else 1.0

    def stats(self) -> DataFrame:
        """vectors, dim, cells, probes, largest (cell)."""
        sizes = self.vectors.groupBy("_cell").agg(F.count("*").alias("n"))
        return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).select("vectors", F.lit(self.centres.shape[1]).alias("dim"), F.lit(len(self.centres)).alias("cells"), F.lit(self.probes).alias("probes"), "largest")
