"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word and every word shape (case, digits, marks, length) has a sparse random index vector that follows from its
hash.  A word's vector is the sum of the index vectors around it, over the whole corpus; words share ROWS rows by
hash, so the table has one size however large the corpus is.  The sums are whole numbers, so they don't depend on the
order in which tasks' tables are added up.  A document is the mean of its words' vectors, of its shapes' vectors, and a
few counts.  The network is fitted by one task on at most FIT_ROWS labelled ids (of rows with one id, on the one with the
least hash of its text) and its probabilities are calibrated by one temperature on rows held from the fit.

Null and empty texts are scored as documents without words; repeated rows get equal scores; very long texts are read in
pieces and pooled as a whole; without labels of both classes every score is the training share (0.5 without any); an
empty table gives no rows; other columns are not read."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PACKED, add_up, packed, table
from .text import Words, mix, slices, words_of
from .toxicity import remainder

ROWS, SHAPES, DIM, NONZERO, REACH = 1 << 16, 1024, 48, 2, 2
#: Labelled ids that the network is fitted on at most (chosen by a hash).
FIT_ROWS = 20_000
HIDDEN = 24
THRESHOLD = 0.7
COUNTS = 4

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 mark, 5 beyond ASCII
_KIND[33:127] = 4
_KIND[48:58] = 3
_KIND[65:91] = 2
_KIND[97:123] = 1
_KIND[128:] = 5


def shapes(w: Words) -> np.ndarray:
    """A number below SHAPES for each word: the kinds of its first and last byte (and which mark), how much of it is
    upper case, digits or marks, and its length."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    kind = _KIND[w.data]
    size = w.end - w.start
    share = []
    for k in (2, 3, 4):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        share.append(np.minimum(3, (total[w.end] - total[w.start]) * 4 // size))
    last = w.data[w.end - 1].astype(np.uint64)
    code = kind[w.start].astype(np.uint64)
    for x, base in ((np.where(kind[w.end - 1] == 4, last, kind[w.end - 1]), 256), *((s, 4) for s in share), (np.searchsorted([2, 4, 7, 11, 20], size), 8)):
        code = code * np.uint64(base) + x.astype(np.uint64)
    return (mix(code + np.uint64(1 << 40)) % np.uint64(SHAPES)).astype(np.int64)


def index_vectors(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (n, NONZERO) and signs of the sparse random vector of each key."""
    h = mix(keys)
    place = np.stack([(h >> np.uint64(8 * i)) % np.uint64(DIM) for i in range(NONZERO)], 1).astype(np.int64)
    sign = np.stack([1.0 - 2.0 * ((h >> np.uint64(60 + i)) & np.uint64(1)).astype(np.float32) for i in range(NONZERO)], 1)
    return place, sign.astype(np.float32)


def rows_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's row, and its shape's row, in the table."""
    return (w.hash & np.uint64(ROWS - 1)).astype(np.int64), ROWS + shapes(w)


def accumulate(w: Words, out: np.ndarray) -> None:
    """Adds the index vectors of the words and shapes up to REACH places away (in the same text) to each word's row."""
    n = len(w.hash)
    if n < 2:
        return
    word_row, shape_row = rows_of(w)
    text = np.repeat(np.arange(len(w.first) - 1, dtype=np.int32), np.diff(w.first))
    sparse = [index_vectors(w.hash), index_vectors(shape_row.astype(np.uint64))]
    near = np.zeros((n, DIM), np.int16)
    for place, sign in sparse:
        for j in range(NONZERO):
            near[np.arange(n), place[:, j]] += sign[:, j].astype(np.int16)
    context = np.zeros_like(near)
    for k in range(1, REACH + 1):
        same = (text[k:] == text[:-k])[:, None]
        context[k:] += near[:-k] * same
        context[:-k] += near[k:] * same
    for rows in (word_row, shape_row):
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        first = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
        out[sorted_rows[first]] += np.add.reduceat(context[order], first, axis=0, dtype=np.int32)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors over all documents, rows scaled to length 1.  Tasks send sums of one fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((ROWS + SHAPES, DIM), np.int64)
        for _, data, bounds in slices(batches, size=1 << 20):
            accumulate(words_of(data, bounds, keep_case=True), out)
        yield packed(out.ravel())

    sums = add_up(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, PACKED), (ROWS + SHAPES) * DIM)
    out = sums.reshape(-1, DIM).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(w: Words, vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 DIM + COUNTS)."""
    n = np.diff(w.first)
    out = np.zeros((len(n), 2 * DIM + COUNTS), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        word_row, shape_row = rows_of(w)
        for k, rows in enumerate((word_row, shape_row)):
            out[full, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[rows], w.first[full], axis=0) / n[full, None]
        text = np.repeat(np.arange(len(n)), n)
        uniq = np.bincount(np.unique((text.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24))) >> np.uint64(40), minlength=len(n))
        out[full, 2 * DIM] = np.log1p(n[full]) / 8
        out[full, 2 * DIM + 1] = (uniq / np.maximum(n, 1))[full]
        out[full, 2 * DIM + 2] = np.add.reduceat((w.end - w.start).astype(np.float32), w.first[full]) / n[full] / 16
    out[:, 2 * DIM + 3] = n == 0
    return out


def documents_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, y, x (the document's vector) and a hash of the text."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches, size=1 << 20):
            x = pooled(words_of(data, bounds, keep_case=True), held.value)
            yield pa.record_batch([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()), part.column(3)], names=["doc_id", "y", "x", "hash"])

    return docs.select("doc_id", "y", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, y int, x binary, hash long")


# --- the network


def logits(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh((x - p["mean"]) / p["scale"] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 40, batch: int = 256) -> dict[str, np.ndarray]:
    """Two layers, trained by Adam; the temperature that fits best on a fifth of the rows kept out of the training."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    p = {"mean": x[~held].mean(0), "scale": x[~held].std(0) + 1e-3, "w1": rng.normal(0, 0.15, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    a, t = ((x - p["mean"]) / p["scale"])[~held], y[~held].astype(np.float32)
    moments = {k: [np.zeros_like(p[k]), np.zeros_like(p[k])] for k in ("w1", "b1", "w2", "b2")}
    step, best, kept = 0, np.inf, {k: v.copy() for k, v in p.items()}
    epochs = max(4, min(epochs, 600_000 // max(1, len(t))))
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            h = np.tanh(a[own] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"][0], -30, 30))) - t[own]) / len(own)
            dh = d[:, None] * p["w2"] * (1 - h * h)
            g = {"w1": a[own].T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum(keepdims=True)}
            step += 1
            for k, v in g.items():
                m = moments[k]
                m[0] += 0.1 * (v - m[0])
                m[1] += 0.001 * (v * v - m[1])
                p[k] = (p[k] - 0.004 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if held.any():
            loss = log_loss(logits(p, x[held]), y[held], 1.0)
            if loss < best:
                best, kept = loss, {k: v.copy() for k, v in p.items()}
    p = kept if held.any() else p
    rows = held if held.any() else ~held
    z = logits(p, x[rows])
    grid = np.exp(np.linspace(np.log(0.25), np.log(4), 81))
    p["temperature"] = np.array([grid[int(np.argmin([log_loss(z, y[rows], s) for s in grid]))]], np.float32)
    return p


def log_loss(z: np.ndarray, y: np.ndarray, temperature: float) -> float:
    z = z.astype(np.float64) / temperature
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", fit_rows: int = FIT_ROWS):
    """(word vectors, network or None, the score without a network); labels: doc_id and column (0 or 1) of the rows to
    learn from."""
    y = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    vectors = word_vectors(docs)
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # so the broadcast has fit_rows rows at most
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, c, x) for batch in batches for i, c, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        target = np.array([c for _, c, _ in found], np.float32)
        if 0 < target.sum() < len(target):
            made = fit(np.stack([np.frombuffer(x, np.float32) for *_, x in found]), target), None
        else:
            made = None, float(target.mean()) if len(target) else 0.5
        yield pa.record_batch([pa.array([pickle.dumps(made)], pa.binary())], names=["model"])

    # One row of one vector for each id reaches the one task that fits the network.
    one = documents_vectors(sample, vectors).groupBy("doc_id", "y").agg(F.min_by("x", "hash").alias("x"))
    got = one.select("doc_id", "y", "x").repartition(1).mapInArrow(learn, "model binary").head()
    p, constant = pickle.loads(got[0]) if got else (None, 0.5)
    return vectors, p, constant


def probabilities(trained, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    vectors, p, constant = trained
    if p is None:
        return np.full(len(bounds) - 1, constant)
    z = logits(p, pooled(words_of(data, bounds, keep_case=True), vectors)).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z / float(p["temperature"][0]), -30, 30)))


def score(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, column))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches, size=1 << 20):
            q = probabilities(held.value, data, bounds)
            yield pa.record_batch([part.column(0), pa.array(q), pa.array((q >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def only_good(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, with all their columns; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches, size=1 << 20):
            yield part.filter(pa.array(probabilities(held.value, data, bounds) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(remainder(4) != 2))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op5_random_indexing_quality": op5_random_indexing_quality}
SQL: dict[str, str] = {}
