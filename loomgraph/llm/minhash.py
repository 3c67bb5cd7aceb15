"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text's shingles (SHINGLE words each; a shorter text is one shingle) weigh 1 + ln(count).  Each shingle sends a
Poisson process of arrivals, at a rate of its weight, to REGISTERS registers; a register keeps the shingle that
arrives first, and a shingle stops as soon as its next arrival is later than every register's.  Two texts' registers
agree with the probability Jaccard similarity of their weighted shingles.  (Without repeated shingles that is the
Jaccard similarity of the sets.)  Texts that agree in all registers of a band meet in a bucket.

Equal texts are one node.  In each bucket all texts are verified, exactly, against a leader; components follow.  Where
a bucket still holds several components, its texts outside the leader's are verified against all others there, in
blocks, so that no link between components is lost, whatever the bucket's size; pairs are never written out, only links
that join components.  A link needs a probability Jaccard similarity of at least `threshold`.

Null, empty and blank texts link with nothing.  Rows with equal ids count as one document; rows with a null id get a
null class and are kept.  Very long texts are shingled whole, piece by piece; a similarity that equals the threshold
links; of leaders with equal ranks the least id leads.  An empty table gives an empty result; other columns are not
read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, components, skew_join, table
from .text import Words, mix, slices, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 25, 5
REGISTERS = BANDS * BAND_ROWS
#: Members that one task compares with a leader, and texts of a bucket's rest that one task holds at once.
SALT, BLOCK = 2000, 256
#: Bits of the filter that keeps texts without bucket mates out of the verification's input; a fixed size.
FILTER_BITS = 1 << 24


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every shingle, in order."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = w.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    last = w.first[1:][text]
    h = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = at + k < last
            word = w.hash[np.minimum(at + k, max(0, len(w.hash) - 1))] if len(w.hash) else np.zeros(0, np.uint64)
            h = h * np.uint64(0x9E6C63D0876A9A99) + np.where(inside, word, np.uint64(0))
    return mix(h), text


def weighted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their weights."""
    with np.errstate(over="ignore"):
        key = hashes ^ mix(text.astype(np.uint64) + np.uint64(0x51ED270B))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return hashes[first], text[first], 1 + np.log(count)


def uniform(h: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A number in (0, 1) that follows from the shingle and the arrival's place in its process."""
    with np.errstate(over="ignore"):
        return ((mix(h + step * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(hashes: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) of 32-bit shingle marks; zeros for a text without shingles."""
    time = np.full(texts * registers, np.inf)
    mark = np.zeros(texts * registers, np.uint32)
    latest = np.full(texts, np.inf)
    live = np.arange(len(hashes))
    clock = np.zeros(len(hashes))
    done, ahead = 0, 1
    while len(live):
        steps = (np.arange(done, done + ahead) + 1).astype(np.uint64)
        h = hashes[live, None]
        gaps = -np.log(uniform(h, steps * np.uint64(2))) / weight[live, None]
        arrive = clock[live, None] + np.cumsum(gaps, 1)
        clock[live] = arrive[:, -1]
        use = arrive < latest[text[live], None]
        with np.errstate(over="ignore"):
            at = (mix(h + (steps * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64) + text[live, None] * registers
        who, _ = np.nonzero(use)
        at, arrive = at[use], arrive[use]
        better = arrive < time[at]
        who, at, arrive = who[better], at[better], arrive[better]
        np.minimum.at(time, at, arrive)
        won = time[at] == arrive
        mark[at[won]] = (hashes[live[who[won]]] >> np.uint64(32)).astype(np.uint32)
        latest = time.reshape(texts, registers).max(1)
        done += ahead
        live = live[clock[live] < latest[text[live]]]
        ahead = 2 if done == 1 else min(64, ahead * 2)
    return mark.reshape(texts, registers)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands) of bucket keys."""
    rows = sig.reshape(len(sig), bands, -1).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        h = mix(h ^ rows[:, :, k])
    return h


def profile(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks of a text's shingles in order, and their weights."""
    u, n = np.unique(hashes, return_counts=True)
    return u, 1 + np.log(n)


def probability_jaccard(u: np.ndarray, x: np.ndarray, v: np.ndarray, y: np.ndarray) -> float:
    """Sum over common elements d of 1 / sum over all j of max(x_j / x_d, y_j / y_d)."""
    every = np.union1d(u, v)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, u)], b[np.searchsorted(every, v)] = x, y
    with np.errstate(divide="ignore"):
        ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], a[order], b[order]
    below = np.concatenate([[0], np.cumsum(b)])
    above = np.concatenate([np.cumsum(a[::-1])[::-1], [0]])
    d = np.flatnonzero((a > 0) & (b > 0))
    first = np.searchsorted(ratio, ratio[d], "left")
    return float((1 / (above[first] / a[d] + below[first] / b[d])).sum())


class Heads:
    """Texts held in memory against which others are verified one at a time."""

    def __init__(self):
        self.ids: list[int] = []
        self.tags: list[tuple] = []
        self.profiles: list[tuple[np.ndarray, np.ndarray]] = []
        self.index = None

    def add(self, id_: int, tag: tuple, marks: np.ndarray) -> None:
        self.ids.append(id_), self.tags.append(tag), self.profiles.append(profile(marks))
        self.index = None

    def similar(self, marks: np.ndarray, threshold: float) -> list[int]:
        """Places of the heads whose similarity with the text is at least the threshold."""
        if not self.ids:
            return []
        if self.index is None:
            flat = np.concatenate([u for u, _ in self.profiles])
            own = np.repeat(np.arange(len(self.ids)), [len(u) for u, _ in self.profiles])
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], own[order]
            self.size = np.array([len(u) for u, _ in self.profiles])
            self.plain = np.array([bool((w == 1).all()) for _, w in self.profiles])
        flat, own = self.index
        v, y = profile(marks)
        lo, hi = np.searchsorted(flat, v, "left"), np.searchsorted(flat, v, "right")
        n = hi - lo
        hits = own[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        common = np.bincount(hits, minlength=len(self.ids))
        jaccard = common / np.maximum(1, self.size + len(v) - common)
        ok = jaccard >= threshold
        if not (y == 1).all():
            unsure = common > 0
        else:
            unsure = (common > 0) & ~self.plain
        for i in np.flatnonzero(unsure):
            ok[i] = probability_jaccard(*self.profiles[i], v, y) >= threshold - 1e-12
        return list(np.flatnonzero(ok))


def signed(docs: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    """doc_id, digest of the text, bands (both null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches, size=1 << 20):
            w = words_of(data, bounds)
            h, t, weight = weighted(*shingles(w, size))
            keys = band_keys(signatures(h, t, weight, part.num_rows))
            full = np.diff(w.first) > 0
            digest = [hashlib.blake2b(data[a:b].tobytes(), digest_size=16).digest() if f else None for a, b, f in zip(bounds[:-1], bounds[1:], full, strict=True)]
            yield pa.record_batch([part.column(0), pa.array(digest, pa.binary()), pa.array([k.tobytes() if f else None for k, f in zip(keys, full, strict=True)], pa.binary())], names=["doc_id", "digest", "bands"])

    return docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, digest binary, bands binary")


def exploded(nodes: DataFrame) -> DataFrame:
    """key, node for every band of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                ids = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.record_batch([pa.array(keys), pa.array(ids)], names=["key", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "key long, node long")


def marks_of(docs: DataFrame, wanted: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    """doc_id, marks (32 bits of every shingle, in order of value) of the documents that a fixed-size filter, made of
    the wanted ids, lets through: all wanted ones, few others."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("long")
    bits = wanted.select(place("node").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    mask = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    first = docs.sparkSession.range(1).select(F.bitmap_bucket_number(F.lit(0).cast("long")), F.bitmap_bit_position(F.lit(0).cast("long"))).head()
    for r in bits.collect():  # FILTER_BITS / 32768 rows of 4 KB at most
        at = (r["bucket"] - first[0]) * 4096
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        mask[at : at + len(own)] = own
    held = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, bit = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = bucket * 4096 + bit // 8
            passed = batch.filter(pa.array((held.value[at] >> (bit % 8).astype(np.uint8)) & 1 == 1))
            for part, data, bounds in slices(iter([passed]), size=1 << 20):
                h, t = shingles(words_of(data, bounds), size)
                marks = (h >> np.uint64(32)).astype(np.uint32)
                marks = marks[np.lexsort((marks, t))]
                edge = np.searchsorted(t, np.arange(part.num_rows + 1))
                yield pa.record_batch([part.column(0), pa.array([marks[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["doc_id", "marks"])

    h = place(F.col(id_).cast("long"))
    rows = docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.bitmap_bucket_number(h) - first[0]).alias("bucket"), (F.bitmap_bit_position(h) - first[1]).alias("bit"))
    return rows.mapInArrow(run, "doc_id long, marks binary")


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: group (string), head (boolean), node, comp, bands, band (place of the group's key among the bands, -1: any),
    marks.  Gives links (a, b) between heads of a group and others of it, only such as join components of the group.

    A group's heads come first and are held; the others stream by, so that a group may have any number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, parent = None, Heads(), {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = up = parent.get(up, up)
                x = up
            return x

        for batch in batches:
            links: list[tuple[int, int]] = []
            for g, head, node, comp, bands, key, marks in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if g != group:
                    group, heads, parent = g, Heads(), {}
                own = np.frombuffer(marks, np.uint32)
                if head:
                    heads.add(node, (comp, np.frombuffer(bands, np.int64) if bands else None), own)
                    continue
                if all(root(t[0]) == root(comp) for t in heads.tags):
                    continue
                for i in heads.similar(own, threshold):
                    other, (their, their_bands) = heads.ids[i], heads.tags[i]
                    if other == node or root(their) == root(comp):
                        continue
                    if key is not None and their_bands is not None and bands:  # the first band that they share counts
                        shared = np.flatnonzero(their_bands == np.frombuffer(bands, np.int64))
                        if len(shared) and their_bands[shared[0]] != key:
                            continue
                    parent[root(their)] = root(comp)
                    links.append((other, node))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = rows.select("group", "head", "node", "comp", "bands", "key", "marks").repartition("group").sortWithinPartitions("group", F.desc("head"), "node")
    return ordered.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, id_: str = "doc_id", text: str = "text", stages: Stages | None = None) -> DataFrame:
    """doc_id, class_id (the least id of the class), kept (doc_id = class_id), text_copies for every row.  stages: where
    the tables go that the result reads."""
    stages = stages or Stages(docs.sparkSession, "minhash")
    signs = stages.write(signed(docs, id_, text, size))
    texts = stages.write(signs.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("text_copies")))
    full = signs.where("bands is not null and doc_id is not null")
    nodes = stages.write(full.join(texts.select(F.col("node").alias("doc_id"), F.col("digest").alias("_d")), "doc_id").where("digest = _d").groupBy(F.col("doc_id").alias("node")).agg(F.min("bands").alias("bands")))
    every = exploded(nodes)
    sizes = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    total = signs.count() * BANDS
    buckets = stages.write(skew_join(every, sizes, "key", "n", total).where("n is not null"))
    # A bucket's leader is the text with the most company over all bands, most likely the one that others were made from.
    rank = buckets.groupBy("node").agg(F.sum("n").alias("rank"))
    ranked = buckets.join(rank, "node")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("node")).alias("minus"))).alias("_l"), F.count("*").alias("n")).select("key", (-F.col("_l.minus")).alias("leader"), "n")
    pairs = skew_join(buckets.select("key", "node"), leaders, "key", "n", total).where("node <> leader").select("node", "leader").distinct()
    pairs = stages.write(pairs)
    marks = stages.write(marks_of(docs, buckets.select("node").distinct(), id_, text, size).join(nodes.select(F.col("node").alias("doc_id")), "doc_id").groupBy(F.col("doc_id").alias("node")).agg(F.min("marks").alias("marks")))
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"), F.count("*").alias("m"))
    heads = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(F.concat_ws("/", "leader", "salt").alias("group"), F.lit(True).alias("head"), F.col("leader").alias("node"))
    members = skew_join(pairs, salts, "leader", "m", total).select(F.concat_ws("/", F.col("leader"), F.pmod(F.xxhash64("node"), F.col("salts"))).alias("group"), F.lit(False).alias("head"), "node")
    none = [F.col("node").alias("comp"), F.lit(None).cast("binary").alias("bands"), F.lit(None).cast("long").alias("key")]
    star = stages.write(verify(heads.union(members).join(marks, "node").select("group", "head", "node", *none, "marks"), threshold))
    comps = stages.write(components(stages, star))
    # The rest: buckets that still hold several components.
    inside = buckets.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    main = leaders.join(comps.withColumnRenamed("node", "leader"), "leader", "left").select("key", F.coalesce("component", "leader").alias("main"), "n")
    inside = stages.write(skew_join(inside, main, "key", "n", total).drop("n"))
    out_sizes = inside.where("comp <> main").groupBy("key").agg(F.count("*").alias("outside"))
    out_sizes = out_sizes.join(sizes, "key").withColumn("blocks", F.ceil(F.col("outside") / BLOCK).cast("int"))
    open_ = skew_join(inside, out_sizes, "key", "n", total).where("blocks is not null").drop("n")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    name = lambda b: F.concat_ws("/", F.col("key"), b).alias("group")
    heads = open_.where("comp <> main").select(name(block), F.lit(True).alias("head"), "node", "comp", "key")
    others = open_.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(name(F.col("b")), F.lit(False).alias("head"), "node", "comp", "key")
    rest = heads.union(others).join(nodes, "node").join(marks, "node")
    found = stages.write(verify(rest, threshold))
    if found.isEmpty():
        final = comps
    else:
        final = stages.write(components(stages, star.union(found)))
    named = texts.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"), "text_copies")
    out = skew_join(signs.where("doc_id is not null").select("doc_id", "digest"), named, "digest", "text_copies", max(1, total // BANDS), scatter=["doc_id"])
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("text_copies", F.lit(1).cast("long")).alias("text_copies"))
    out = out.unionByName(signs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("text_copies")))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "text_copies")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The rows of `docs` without those whose class has a lesser id, and without repeats of a row's id."""
    stages, inner = Stages(docs.sparkSession, "dedup"), Stages(docs.sparkSession, "minhash")
    found = stages.write(classes(docs, threshold, size, stages=inner).where("doc_id is not null").select("doc_id", "kept"))
    inner.drop_all()
    repeats = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = found.where("not kept").select("doc_id").distinct()
    if repeats.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeats = stages.write(repeats)
    once = docs.join(gone, "doc_id", "left_anti")
    again = once.join(repeats, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.join(repeats, "doc_id", "left_anti").unionByName(again).select(*docs.columns)


def op1_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_probminhash_dedup": op1_probminhash_dedup}
SQL: dict[str, str] = {}
