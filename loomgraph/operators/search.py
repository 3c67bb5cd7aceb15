"""Top-k search by cosine, exact, and the nearest neighbours of all vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from ..plans.schema import GraphError

#: Queries that one block of a neighbour join holds at most, and vectors that one group of them meets.  LEAST: neither is
#: made smaller than this for the sake of more tasks.  A task multiplies TILE queries by WIDE vectors at a time.
BLOCK, GROUP, LEAST, TILE, WIDE = 1 << 15, 1 << 17, 4096, 512, 2500


def similar(vectors: DataFrame, query: list[float], k: int, id_: str = "node_id", embedding: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest by cosine, ties by id; the scores' heaps merge, nothing is sorted as a whole."""
    if not query:
        raise GraphError("bad_request", "the query vector is empty")
    if k <= 0:
        raise GraphError("bad_request", "top_k must be positive")
    q = F.array(*[F.lit(float(x)) for x in query])
    wrong = F.size(embedding) != len(query)
    score = F.when(wrong, F.raise_error(F.lit("bad_request: embedding dimension mismatch")).cast("double")).otherwise(vector.cosine(embedding, q))
    return vectors.where(F.col(embedding).isNotNull()).select(id_, score.alias("score")).orderBy(F.desc("score"), id_).limit(k)


def dealt(rows: DataFrame, id_: str, n: int) -> DataFrame:
    return rows.withColumn("_block", F.pmod(F.xxhash64(id_), F.lit(n)).cast("int"))


def blocks(rows: DataFrame, id_: str, size: int) -> tuple[DataFrame, int]:
    """Rows with _block: numbers below the second result, with about `size` rows each."""
    n = max(1, -(-rows.count() // size))
    return dealt(rows, id_, n), n


def nearest_neighbours(vectors: DataFrame, k: int, id_: str = "vec_id", embedding: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """id, neighbour, score, rank: the k nearest others of each query (all vectors by default), exactly; ties by id.

    Blocks of queries meet groups of vectors, a task for each such pair, of which there are some for each core: a task
    holds one block (BLOCK at most), streams the group by it as matrix products, and sends k neighbours for each query;
    an aggregate of these picks the last k.  Nothing is collected or broadcast.  The work is in proportion to queries
    times vectors, as it must be for an exact answer; index.VectorIndex answers in less."""
    vectors = usable(vectors, id_, embedding)
    queries = usable(queries, id_, embedding) if queries is not None else vectors
    given = vectors.count()
    asked = given if queries is vectors else queries.count()
    tasks = 3 * vectors.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-asked // BLOCK), min(-(-asked // LEAST), round(math.sqrt(tasks * asked / max(1, given)))))
    n_groups = max(1, -(-given // GROUP), min(-(-given // LEAST), -(-tasks // n_blocks)))
    asks = dealt(queries, id_, n_blocks).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    given = dealt(vectors, id_, n_groups).withColumnRenamed("_block", "_group").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return meet(asks, given, k, id_, embedding, (n_blocks, n_groups))


def usable(rows: DataFrame, id_: str, embedding: str) -> DataFrame:
    """Rows with an id and a vector; vectors of floats stay such, which halves what is sent."""
    kind = rows.schema[embedding].dataType.simpleString()
    return rows.where(F.col(id_).isNotNull() & (F.size(embedding) > 0)).select(F.col(id_).cast("long").alias(id_), F.col(embedding).cast(kind if kind == "array<float>" else "array<double>").alias(embedding))


def doubles(column: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix; null components are not numbers."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size != size[0]).any():
        raise ValueError("bad_request: embedding dimension mismatch")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, component by component: equal rows have equal sums wherever they stand."""
    return np.cumsum(x, axis=1)[:, -1]


class Vectors:
    """ids, vectors in double precision, squares of their norms, and unit vectors of floats.  Vectors with components
    that are no finite numbers have no cosine and are left out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        if not (whole := np.isfinite(x).all(1)).all():
            ids, x = ids[whole], x[whole]
        with np.errstate(over="ignore"):
            squares = in_order(x * x)
        if (odd := ((squares > 1e100) | (squares < 1e-100)) & (x != 0).any(1)).any():
            x[odd] /= np.abs(x[odd]).max(1, keepdims=True)
            squares[odd] = in_order(x[odd] * x[odd])
        self.ids, self.x, self.squares = ids, x, squares
        self.unit = (x / np.where(squares > 0, np.sqrt(squares), 1)[:, None]).astype(np.float32)


class Nearest:
    """The k nearest so far of each of some queries.  Products of floats only tell which pairs may be among them: an
    error of such a product is at most half of `slack`; the pairs are scored in double precision and ties go to the
    lesser id."""

    def __init__(self, asked: list[Vectors], k: int):
        self.k, self.ids, self.x, self.squares, self.unit = k, *(np.concatenate([getattr(v, a) for v in asked]) for a in ("ids", "x", "squares", "unit"))
        self.best, self.who = np.full((len(self.ids), k), -2.0), np.full((len(self.ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(self.ids), -9, np.float32)
        self.slack = np.float32((self.x.shape[1] + 8) * 2.0**-23)

    def meet(self, given: Vectors) -> None:
        if given.x.shape[1] != self.x.shape[1]:
            raise ValueError("bad_request: embedding dimension mismatch")
        for b in range(0, len(given.ids), WIDE):
            columns, own = given.unit[b : b + WIDE].T, given.ids[b : b + WIDE]
            for a in range(0, len(self.ids), TILE):
                s, low = self.unit[a : a + TILE] @ columns, self.floor[a : a + TILE]
                if s.shape[1] > self.k and low.min() < -1.5:  # the k-th of these is a bound until k were met
                    others = np.where(self.ids[a : a + TILE, None] == own[None], np.float32(-3), s)
                    np.maximum(low, np.partition(others, -self.k, axis=1)[:, -self.k] - self.slack, out=low)
                hit = np.flatnonzero(s >= low[:, None])
                if len(hit):
                    i, j = hit // s.shape[1] + a, hit % s.shape[1] + b
                    other = self.ids[i] != given.ids[j]
                    self._put(i[other], j[other], given)

    def _put(self, i: np.ndarray, j: np.ndarray, given: Vectors) -> None:
        """Scores pairs, in order of query, and keeps the best of them."""
        score = np.empty(len(i))
        for a in range(0, len(i), 8192):
            m, n = i[a : a + 8192], j[a : a + 8192]
            norms = np.sqrt(self.squares[m] * given.squares[n])
            score[a : a + 8192] = np.clip(in_order(self.x[m] * given.x[n]) / np.where(norms > 0, norms, 1), -1, 1)
        if not (good := score >= self.best[i, self.k - 1]).any():
            return
        i, score, who = i[good], score[good], given.ids[j[good]]
        rows = np.unique(i)
        of, s, w = np.concatenate([np.repeat(rows, self.k), i]), np.concatenate([self.best[rows].ravel(), score]), np.concatenate([self.who[rows].ravel(), who])
        order = np.lexsort((w, -s, of))
        first = np.searchsorted(of[order], rows)
        keep = order[first[:, None] + np.arange(self.k)]
        self.best[rows], self.who[rows] = s[keep], w[keep]
        self.floor[rows] = np.maximum(self.floor[rows], (self.best[rows, -1] - self.slack).astype(np.float32))

    def result(self, id_: str) -> pa.RecordBatch:
        keep = self.best > -2
        near = pa.StructArray.from_arrays([pa.array(0.0 - self.best[keep]), pa.array(self.who[keep])], names=["s", "neighbour"])
        ends = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
        return pa.record_batch([pa.array(self.ids), pa.ListArray.from_arrays(pa.array(ends), near)], names=[id_, "_near"])


def meet(asks: DataFrame, given: DataFrame, k: int, id_: str, embedding: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """The k nearest to each of the rows that ask, among the rows given with an equal _block and _group.  A task holds
    the asking rows of one such pair (about BLOCK of them) and streams the given ones.  sizes: the numbers of blocks and
    groups, if each pair of them is to be a task of its own."""
    columns = ["_block", "_group", "_ask", id_, embedding]
    met = asks.withColumn("_ask", F.lit(True)).select(*columns).unionByName(given.withColumn("_ask", F.lit(False)).select(*columns))
    met = met.repartitionById(sizes[0] * sizes[1], F.col("_block") * sizes[1] + F.col("_group")) if sizes else met.repartition("_block", "_group")
    met = met.sortWithinPartitions("_block", "_group", F.desc("_ask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, found = None, [], None
        for batch in batches:
            place = batch.column(0).to_numpy().astype(np.int64) * (1 << 31) + batch.column(1).to_numpy()
            ask = batch.column(2).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (ask[1:] != ask[:-1])])) if len(place) else []
            for a, b in zip(edge, np.append(edge[1:], len(place)), strict=True):
                if place[a] != now:
                    if found is not None:
                        yield found.result(id_)
                    now, asked, found = place[a], [], None
                own = Vectors(batch.column(3)[a:b].to_numpy(), doubles(batch.column(4)[a:b]))
                if ask[a]:
                    asked.append(own)
                    continue
                if found is None and asked:
                    asked, found = [], Nearest(asked, k)
                if found is not None:
                    found.meet(own)
        if found is not None:
            yield found.result(id_)

    out = met.mapInArrow(run, f"{id_} long, _near array<struct<s:double,neighbour:long>>")
    top = out.groupBy(id_).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_t"))
    return top.select(id_, F.posexplode("_t").alias("_r", "_n")).select(id_, F.col("_n.neighbour").alias("neighbour"), (F.lit(0.0) - F.col("_n.s")).alias("score"), (F.col("_r") + 1).cast("int").alias("rank"))
