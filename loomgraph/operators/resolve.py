"""Entity resolution in three tiers: names alike enough, then vectors alike enough, then a new entity.

The queries are a stated set against all existing names.  Blocks of BLOCK queries meet groups of GROUP names: a task
holds one block and streams the group by it.  For each pair of distinct names a bound on the score comes first
(fuzzy.Bags.most, which states why nothing above it is possible), and only pairs that may matter are scored: those whose
bound reaches the query's best score so far, and in the second tier those whose bound reaches the threshold.  So nothing
that counts is left out, nothing is collected or broadcast, and a task sends a row for each query, not for each pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.vector import EPSILON_F32
from .search import blocks

#: Queries held at once, names that they meet in one task, and names looked at together.
BLOCK, GROUP, CHUNK = 1024, 1 << 17, 2048


@dataclass(frozen=True)
class Thresholds:
    fuzzy: int = 70
    vector: float = 0.85
    auto_merge: int = 90

    @classmethod
    def of(cls, resolution: dict | None) -> Thresholds:
        r = resolution or {}
        return cls(int(r.get("fuzzy_threshold", 70)), float(np.float32(r.get("vector_threshold", 0.85))), int(r.get("auto_merge_threshold", 90)))


class Asked:
    """A block of queries: distinct names with what bounds their scores, and vectors."""

    def __init__(self, ids: list, names: list[str], vectors: list):
        self.ids, uniq = ids, list(dict.fromkeys(names))
        place = {n: i for i, n in enumerate(uniq)}
        self.of = np.array([place[n] for n in names])
        self.names, self.bags, self.vectors = uniq, fuzzy.Bags(uniq), vectors
        self.best = [(-1, 0, None)] * len(uniq)  # score, -pos, id
        self.near: list[tuple | None] = [None] * len(ids)  # cosine, pos, id

    def floor(self) -> np.ndarray:
        return np.array([b[0] for b in self.best])


def scored(x: list[str], y: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return fuzzy.name_scores([x[k] for k in i.tolist()], [y[k] for k in j.tolist()]) if len(i) else np.zeros(0, np.int64)


def cosines(a: list, b: list) -> list[float | None]:
    """Of pairs of vectors, as vector.cosine; null unless both are there and of one length."""
    out: list[float | None] = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None or len(x) != len(y):
            out.append(None)
            continue
        norms = np.sqrt(x @ x) * np.sqrt(y @ y)
        out.append(0.0 if norms < EPSILON_F32 else float(np.clip(x @ y / norms, -1, 1)))
    return out


def _met(queries: DataFrame, existing: DataFrame) -> DataFrame:
    """Queries and names by block and group, queries first.  Columns: _block, _group, ask, query_id or id, name, pos,
    embedding."""
    vectors = "query_embedding" in queries.columns and "embedding" in existing.columns
    none = F.lit(None).cast("array<double>")
    own, n_blocks = blocks(queries.where("query is not null"), "query_id", BLOCK)
    given, n_groups = blocks(existing.where("name is not null"), "id", GROUP)
    own = own.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    given = given.withColumnRenamed("_block", "_group").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asks = own.select("_block", "_group", F.lit(True).alias("ask"), F.col("query_id").cast("string").alias("id"), F.col("query").alias("name"), F.lit(0).cast("long").alias("pos"), (F.col("query_embedding").cast("array<double>") if vectors else none).alias("embedding"))
    rows = given.select("_block", "_group", F.lit(False).alias("ask"), F.col("id").cast("string").alias("id"), "name", F.col("pos").cast("long").alias("pos"), (F.col("embedding").cast("array<double>") if vectors else none).alias("embedding"))
    return asks.unionByName(rows).repartition("_block", "_group").sortWithinPartitions("_block", "_group", F.desc("ask"))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Asked | None, list]]:
    """For each chunk of names the block of queries that it meets; the block's last chunk is followed by none."""
    now, head, asked = None, [], None
    for batch in batches:
        for k in range(0, batch.num_rows, CHUNK):
            rows = list(zip(*(batch.column(c)[k : k + CHUNK].to_pylist() for c in range(6)), ([None if v is None else np.array(v, np.float64) for v in batch.column(6)[k : k + CHUNK].to_pylist()]), strict=True))
            a = 0
            while a < len(rows):
                b = a
                while b < len(rows) and rows[b][:3] == rows[a][:3]:
                    b += 1
                if rows[a][:2] != now:
                    if asked is not None:
                        yield asked, []
                    now, head, asked = rows[a][:2], [], None
                if rows[a][2]:
                    head += rows[a:b]
                elif head:
                    if asked is None:
                        asked = Asked([r[3] for r in head], [r[4] for r in head], [r[6] for r in head])
                    yield asked, rows[a:b]
                a = b
    if asked is not None:
        yield asked, []


def candidates(queries: DataFrame, existing: DataFrame, least: int = 0) -> DataFrame:
    """queries: query_id, query.  existing: id, name, pos (input order).  query_id, id, pos, score of every pair that
    scores at least `least` (0 to 100)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, rows in _streams(batches):
            if not rows:
                continue
            uniq = list(dict.fromkeys(r[4] for r in rows))
            place = {n: i for i, n in enumerate(uniq)}
            i, j = np.nonzero(asked.bags.most(fuzzy.Bags(uniq)) >= least) if least else (x.ravel() for x in np.indices((len(asked.names), len(uniq))))
            score = np.full((len(asked.names), len(uniq)), -1, np.int64)
            score[i, j] = scored(asked.names, uniq, i, j)
            at = np.array([place[r[4]] for r in rows])
            for k, query in enumerate(asked.ids):
                own = score[asked.of[k], at]
                hit = np.flatnonzero(own >= max(0, least))
                yield pa.record_batch([pa.array([query] * len(hit), pa.string()), pa.array([rows[x][3] for x in hit], pa.string()), pa.array([rows[x][5] for x in hit], pa.int64()), pa.array(own[hit])], names=["query_id", "id", "pos", "score"])

    return _met(queries.select("query_id", "query"), existing.select("id", "name", "pos")).mapInArrow(run, "query_id string, id string, pos long, score long")


def resolve(queries: DataFrame, existing: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """query_id, decision (auto_merge, vector_merge or create_new), id, score, best_score.  With an embedding in both
    tables the second tier is asked; queries without existing names, or without a name, are new.

    Ties: among names the first by pos, among vectors the last."""
    t = thresholds
    vectors = "embedding" in existing.columns and "query_embedding" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, rows in _streams(batches):
            if not rows:
                found = [(q, *asked.best[u], *(near or (None, None, None))) for q, u, near in zip(asked.ids, asked.of.tolist(), asked.near, strict=True)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()), strict=True)], names=["query_id", "score", "p", "id", "cos", "pos", "near"])
                continue
            first: dict[str, tuple] = {}  # of the rows with one name the first by pos
            for r in rows:
                first[r[4]] = min(first.get(r[4], (r[5], r[3])), (r[5], r[3]))
            uniq = list(first)
            most = asked.bags.most(fuzzy.Bags(uniq))
            score = np.full(most.shape, -1, np.int64)
            i, j = np.arange(len(most)), most.argmax(1)
            i, j = (x[most[i, j] >= asked.floor()] for x in (i, j))
            score[i, j] = scored(asked.names, uniq, i, j)
            need = most >= np.maximum(asked.floor(), score.max(1))[:, None]
            if vectors:
                need |= most >= t.fuzzy
            i, j = np.nonzero(need & (score < 0))
            score[i, j] = scored(asked.names, uniq, i, j)
            for u in np.flatnonzero(score.max(1) >= np.maximum(0, asked.floor())).tolist():
                top = int(score[u].max())
                pos, who = min(first[uniq[k]] for k in np.flatnonzero(score[u] == top))
                if (top, -pos) > asked.best[u][:2]:
                    asked.best[u] = (top, -pos, who)
            if vectors:
                place = {n: k for k, n in enumerate(uniq)}
                zone = score[:, np.array([place[r[4]] for r in rows])] >= t.fuzzy
                for k, u in enumerate(asked.of.tolist()):
                    hit = np.flatnonzero(zone[u]).tolist()
                    for x, c in zip(hit, cosines([asked.vectors[k]] * len(hit), [rows[x][6] for x in hit]), strict=True):
                        if c is not None and (asked.near[k] is None or (c, rows[x][5], rows[x][3]) > asked.near[k]):
                            asked.near[k] = (c, rows[x][5], rows[x][3])

    met = _met(queries, existing).mapInArrow(run, "query_id string, score long, p long, id string, cos double, pos long, near string")
    top = met.where("score >= 0").groupBy("query_id").agg(F.max(F.struct("score", "p", "id")).alias("best"), F.max(F.when(F.col("cos").isNotNull(), F.struct("cos", "pos", F.col("near").alias("id")))).alias("near"))
    top = queries.select(F.col("query_id").cast("string").alias("query_id")).join(top, "query_id", "left")
    auto = F.col("best.score") >= t.auto_merge
    merge = (F.col("best.score") >= t.fuzzy) & (F.col("near.cos") >= t.vector)
    return top.select(
        "query_id",
        F.when(auto, "auto_merge").when(merge, "vector_merge").otherwise("create_new").alias("decision"),
        F.when(auto, F.col("best.id")).when(merge, F.col("near.id")).alias("id"),
        F.when(auto, F.col("best.score").cast("double")).when(merge, F.round(F.col("near.cos"), 6)).alias("score"),
        F.coalesce(F.col("best.score"), F.lit(0).cast("long")).alias("best_score"),
    )
