"""Near-duplicate vectors by a pivot-permutation index.

Pivots are a bounded sample of the vectors, less those close to another pivot.  Each vector is described by its nearest
pivots in order (by angle, after the sample's mean is taken off, so that vectors with a common direction are told apart),
and stands in an inverted list for each two of them: vectors of one list share two pivots.  How many pivots that takes
is measured at the start: the least number by which RECALL of pairs made at the link's very threshold share enough.

Lists hold names and permutations, no vectors.  Where two members share no list before this one, the pair is this list's;
members without such a pair leave it.  Then the remaining members' vectors are fetched, and each list's own pairs are
verified by cosine in double precision.  Lists are worked through in blocks, so that none, however long, meets in one
task, and no pairs are written out: blocks send numbers of links, and only links that join components.  Equal vectors
with equal labels are one node of the index and count with their number.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing.
Vectors of other lengths than most are compared with those of their own length.  Rows with equal ids count as separate
vectors; rows with a null id link with nothing; a cosine that equals the threshold links; an empty table gives an empty result; very long vectors are compared
like any other; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, components, id_filter, skew_join, table
from .text import mix

COSINE = 0.98
#: Pivots that describe a vector: tried in this order, with how many of them two vectors of a list share.
TRIED = [*((k, 2) for k in range(5, 17)), *((k, 1) for k in range(4, 17))]
#: Share of pairs at the threshold that are to be found, and such pairs that are made of sampled vectors to measure it.
RECALL, TRIALS = 0.997, 2000
#: One pivot for so many vectors; not fewer than LEAST nor more than MOST of them.  They are broadcast (MOST vectors).
PER_PIVOT, LEAST, MOST = 32, 64, 4096
#: Vectors in each of the two blocks that are compared at once, and members of a list that a task compares alone.
BLOCK, ALONE = 1024, 8192
#: Nodes that long lists are looked for in.
SAMPLE = 1 << 17


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe from over- and underflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(x: np.ndarray, cosine: float) -> np.ndarray:
    """The rows that are 1.5 times as far as linked vectors from each row kept before: pivots within one group of near
    copies would rank almost at random for its members, and split them among lists."""
    kept, most = np.empty_like(x), 1 - 2.25 * (1 - cosine)
    n = 0
    for v in x:
        if not n or (kept[:n] @ v).max() < most:
            kept[n] = v
            n += 1
    return kept[:n]


class Pivots:
    """Pivots for vectors of one length."""

    def __init__(self, sample: np.ndarray, cosine: float):
        """sample: unit vectors."""
        self.centre = sample.mean(0)
        away = apart(sample, cosine) - self.centre
        size = np.linalg.norm(away, axis=1, keepdims=True)
        self.away = away / np.where(size > 1e-9, size, 1)
        self.k, self.shared = self.measured(sample, cosine)

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """(n, k) places of the nearest pivots, nearest first."""
        k = min(k, len(self.away))
        sims = (x - self.centre) @ self.away.T
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(self.away) else np.tile(np.arange(k), (len(x), 1))
        order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1).astype(np.int32)

    def measured(self, sample: np.ndarray, cosine: float) -> tuple[int, int]:
        """(pivots, shared): the first of TRIED that finds RECALL of pairs whose cosine is the threshold, made of sampled
        vectors and the directions to others; else the best."""
        if len(sample) < 2 or len(self.away) < 2:
            return 1, 1
        rng = np.random.default_rng(11)
        u, w = (sample[rng.integers(0, len(sample), TRIALS)] for _ in range(2))
        side = w - (w * u).sum(1, keepdims=True) * u
        size = np.linalg.norm(side, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        if not some.any():
            return 1, 1
        u, side = u[some], side[some] / size[some]
        a = self.nearest(u, 16)
        b = self.nearest(cosine * u + np.sqrt(1 - cosine * cosine) * side, 16)
        best = (-1.0, 1, 1)
        for k, shared in TRIED:
            k = min(k, a.shape[1])
            if k < shared:
                continue
            found = float(((a[:, :k, None] == b[:, None, :k]).sum((1, 2)) >= shared).mean())
            if found >= RECALL:
                return k, shared
            best = max(best, (found, k, shared), key=lambda t: t[0])
        return best[1:]

    def near(self, x: np.ndarray) -> np.ndarray:
        return self.nearest(x, self.k).astype("<u2")

    def keys(self, group: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector's lists: keys, and first and second pivot (equal where one shared pivot is enough)."""
        i, j = np.triu_indices(near.shape[1], 1) if self.shared > 1 else (np.arange(near.shape[1]),) * 2
        p, q = np.minimum(near[:, i], near[:, j]), np.maximum(near[:, i], near[:, j])
        with np.errstate(over="ignore"):
            return mix(group[:, None] + (p.astype(np.uint64) << np.uint64(16) | q) * np.uint64(0x9E3779B97F4A7C15)), p, q


def stretches(column: pa.Array, kind: str) -> np.ndarray:
    """A column of byte strings of one length as rows of numbers."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def in_bytes(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as byte strings."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def usable(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of vectors: all components side by side, where each vector begins (and the end), and which of them may
    link: not null or empty, without null or non-finite components, not zero."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
    good, full = size > 0, np.flatnonzero(size)
    if len(full):
        good[full] = np.logical_and.reduceat(np.isfinite(flat), edge[full]) & np.logical_or.reduceat(flat != 0, edge[full])
    return flat + np.zeros(1, kind), edge, good  # no minus zero


def prepare(rows: DataFrame, kind: str) -> DataFrame:
    """_id (the row's own), vec_id, digest (null for vectors that link with nothing), group (of the label and the length),
    vector (as bytes of the type that it came in)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[int, bytes]] = {}
        for batch in batches:
            flat, edge, good = usable(batch.column(3), kind)
            data, at = flat.tobytes(), (edge * np.dtype(kind).itemsize).tolist()
            raw, digest, group = [], [], []
            for k, (ok, label) in enumerate(zip(good.tolist(), batch.column(2).to_pylist(), strict=True)):
                if not ok or label is None:
                    raw.append(None), digest.append(None), group.append(None)
                    continue
                own = data[at[k] : at[k + 1]]
                if (label, len(own)) not in groups:
                    if len(groups) > 100_000:
                        groups.clear()
                    groups[label, len(own)] = (int.from_bytes(hashlib.blake2b(f"{len(own)} {label}".encode(), digest_size=8).digest(), "little", signed=True), f"{label}\x00{len(own)}\x00".encode())
                number, name = groups[label, len(own)]
                raw.append(own), group.append(number), digest.append(hashlib.blake2b(name + own, digest_size=16).digest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(group, pa.int64()), pa.array(raw, pa.binary())], names=["_id", "vec_id", "digest", "group", "vector"])

    return rows.mapInArrow(run, "_id long, vec_id long, digest binary, group long, vector binary")


def by_dim(raw: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length met in a column of vectors' bytes: the places of its vectors, and these as unit vectors."""
    dims = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]) // np.dtype(kind).itemsize if len(raw) else np.zeros(0, np.int64)
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        yield dim, own, unit(stretches(raw.take(pa.array(own)), kind))


def described(rows: DataFrame, held, kind: str) -> DataFrame:
    """_id, group, dim, near (pivots as 16-bit numbers, nearest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                for dim, own, x in by_dim(part.column(2), kind):
                    pivots = held.value.get(dim)
                    near = pivots.near(x) if pivots is not None else np.zeros((len(own), 1), "<u2")
                    yield pa.record_batch([*(part.column(k).take(pa.array(own)) for k in (0, 1)), pa.array(np.full(len(own), dim, np.int32)), in_bytes(near)], names=["_id", "group", "dim", "near"])

    return rows.select("_id", "group", "vector").mapInArrow(run, "_id long, group long, dim int, near binary")


def posted(nodes: DataFrame, held, hot: dict[int, int]) -> DataFrame:
    """list, i, j, p, q, node, near: a row for each list of a node; in a long list, one for each pair of its blocks that the
    node's own is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = np.array(sorted(hot), np.int64)
        blocks = np.array([hot[k] for k in lists.tolist()], np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                dims = part.column(2).to_numpy()
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    near = stretches(part.column(3).take(pa.array(own)), "<u2")
                    node = part.column(0).to_numpy()[own]
                    pivots = held.value.get(dim)
                    key, p, q = pivots.keys(part.column(1).to_numpy()[own].view(np.uint64), near) if pivots is not None else (mix(part.column(1).to_numpy()[own].view(np.uint64))[:, None], near, near)
                    of = np.repeat(np.arange(len(own)), key.shape[1])
                    key, p, q = key.ravel().view(np.int64), p.ravel(), q.ravel()
                    n = np.ones(len(key), np.int64)
                    if len(lists):
                        at = np.minimum(np.searchsorted(lists, key), len(lists) - 1)
                        n = np.where(lists[at] == key, blocks[at], 1)
                    row = np.repeat(np.arange(len(key)), n)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    mine = (mix(node.view(np.uint64)[of]) % n.astype(np.uint64)).astype(np.int64)[row]
                    of = of[row]
                    yield pa.record_batch([pa.array(key[row]), pa.array(np.minimum(mine, other).astype(np.int32)), pa.array(np.maximum(mine, other).astype(np.int32)), pa.array((mine > other).astype(np.int32)), pa.array(p[row].astype(np.int32)), pa.array(q[row].astype(np.int32)), pa.array(node[of]), in_bytes(near[of])], names=["list", "i", "j", "side", "p", "q", "node", "near"])

    return nodes.select("node", "group", "dim", "near").mapInArrow(run, "list long, i int, j int, side int, p int, q int, node long, near binary")


def first_shared(a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether p and q are first among the pivots that the rows of a and of b share: those with the least sums of their
    ranks in both, by number where sums are equal.  All rows have p and q.  Vectors that are alike rank alike, so that
    the pairs of a crowd meet in few lists."""
    rank = lambda x, r: (x == r).argmax(1).astype(np.int32)
    value = lambda r: ((rank(a, r)[:, None] + rank(b, r)[None, :]) << 16) + np.int32(r)
    top = np.maximum(value(p), value(q))
    out = np.ones(top.shape, bool)
    for r in np.intersect1d(a, b).tolist():
        if r not in (p, q):
            x, y = np.flatnonzero((a == r).any(1)), np.flatnonzero((b == r).any(1))
            less = ((rank(a[x], r)[:, None] + rank(b[y], r)[None, :]) << 16) + np.int32(r) < top[np.ix_(x, y)]
            out[np.ix_(x, y)] &= ~less
    return out


def first_of_pairs(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """first_shared() of rows of a and b one by one, each with a list of its own."""
    k = a.shape[1]
    ranks = (np.arange(k)[:, None] + np.arange(k)[None, :]).astype(np.int32) << 16
    out = np.empty(len(a), bool)
    step = max(1, (1 << 22) // (k * k))
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        value = np.where(x[:, :, None] == y[:, None, :], ranks + x[:, :, None].astype(np.int32), np.int32(1 << 30)).reshape(len(x), -1)
        value = np.sort(np.partition(value, min(1, value.shape[1] - 1), axis=1)[:, :2] & 0xFFFF, axis=1)
        alone = p[i : i + step] == q[i : i + step]
        least = np.where(x[:, :, None] == y[:, None, :], ranks + x[:, :, None].astype(np.int32), np.int32(1 << 30)).reshape(len(x), -1).min(1) & 0xFFFF if alone.any() else value[:, 0]
        out[i : i + step] = np.where(alone, least == p[i : i + step], (value[:, 0] == p[i : i + step]) & (value[:, -1] == q[i : i + step]))
    return out


#: Members up to which lists are worked through together, pair by pair.
FEW = 48


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """Rows by their first three columns, which they are sorted by: a group of rows alone, or many groups of at most FEW
    with their sizes; single rows are passed over."""
    now, held = None, []

    def whole() -> Iterator[tuple[pa.RecordBatch, None]]:
        if sum(x.num_rows for x in held) > 1:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0], None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(3)]
        edge = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)]))
        size = np.diff(np.append(edge, batch.num_rows))
        first, last = (tuple(int(x[edge[g]]) for x in keys) for g in (0, -1))
        begun = now == first
        if begun:
            held.append(batch.slice(0, size[0]))
            if len(edge) == 1:
                continue
        yield from whole()
        inner = np.arange(int(begun), len(edge) - 1)
        for g in inner[size[inner] > FEW].tolist():
            yield batch.slice(edge[g], size[g]), None
        few = inner[(size[inner] > 1) & (size[inner] <= FEW)]
        if len(few):
            yield batch.take(pa.array(np.concatenate([np.arange(edge[g], edge[g] + size[g]) for g in few.tolist()]))), size[few]
        now, held = last, [batch.slice(edge[-1])]
    yield from whole()


def pairs_of(size: np.ndarray, here: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two rows of each pair within groups of these sizes; of groups of two blocks (not `here`), of pairs
    with a row of each."""
    n = size.sum()
    start = np.repeat(np.cumsum(size) - size, size)
    before = np.arange(n) - start
    one = np.repeat(np.arange(n), before)
    two = np.arange(len(one)) - np.repeat(np.cumsum(before) - before, before) + start[one]
    keep = here[one] | (side[one] != side[two])
    return one[keep], two[keep]


def of_lists(rows: pa.RecordBatch, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of many lists that are these lists' own."""
    side = rows.column(3).to_numpy()
    one, two = pairs_of(size, rows.column(1).to_numpy() == rows.column(2).to_numpy(), side)
    out = np.zeros(len(one), bool)
    column = rows.column(7)
    width = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    p, q = rows.column(4).to_numpy().astype(np.int32), rows.column(5).to_numpy().astype(np.int32)
    for w in np.unique(width).tolist():  # vectors of other lengths may have another number of pivots
        near = np.zeros((len(column), w // 2), "<u2")
        near[width == w] = stretches(column.filter(pa.array(width == w)), "<u2")
        own = np.flatnonzero(width[one] == w)
        out[own] = first_of_pairs(near[one[own]], near[two[own]], p[one[own]], q[one[own]])
    return one[out], two[out]


def needed(postings: DataFrame) -> DataFrame:
    """list, p, q, node of the members that have a pair of their own in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size in streamed(batches):
            keep = np.zeros(rows.num_rows, bool)
            if size is not None:
                for x in of_lists(rows, size):
                    keep[x] = True
            else:
                near, side, here = stretches(rows.column(7), "<u2"), rows.column(3).to_numpy(), rows.column(1)[0].as_py() == rows.column(2)[0].as_py()
                p, q = rows.column(4)[0].as_py(), rows.column(5)[0].as_py()
                one, two = (np.arange(len(near)),) * 2 if here else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                for a in range(0, len(one), BLOCK):
                    for b in range(a if here else 0, len(two), BLOCK):
                        x, y = one[a : a + BLOCK], two[b : b + BLOCK]
                        own = first_shared(near[x], near[y], p, q)
                        if here and a == b:
                            own &= ~np.eye(len(x), dtype=bool)
                        keep[x] |= own.any(1)
                        keep[y] |= own.any(0)
            if keep.any():
                out = rows.filter(pa.array(keep))
                yield pa.record_batch([out.column(k) for k in (0, 4, 5, 6, 7)], names=["list", "p", "q", "node", "near"])

    ordered = postings.select("list", "i", "j", "side", "p", "q", "node", "near").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    return ordered.mapInArrow(run, "list long, p int, q int, node long, near binary")


def linked(cos: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Of pairs' cosines: whether they reach the threshold.  What is all but equal to it isn't left to the order of a
    matrix product's sums."""
    out = cos >= cosine
    for at in zip(*np.nonzero(np.abs(cos - cosine) < 1e-12), strict=True):
        i, j = at if len(at) == 2 else (at[0], at[0])
        out[at] = float(np.sum(x[i] * y[j])) >= cosine
    return out


def least_labels(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of n places joined by pairs: the least place that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def block_labels(ok: np.ndarray) -> np.ndarray:
    """The same for the rows, then the columns, of a matrix of links."""
    rows, columns = np.arange(ok.shape[0]), ok.shape[0] + np.arange(ok.shape[1])
    most = ok.shape[0] + ok.shape[1]
    while True:
        r = np.minimum(rows, np.where(ok, columns[None, :], most).min(1))
        c = np.minimum(columns, np.where(ok, r[:, None], most).min(0))
        if (r == rows).all() and (c == columns).all():
            return np.concatenate([rows, columns])
        rows, columns = r, c


def compare(rows: DataFrame, cosine: float, kind: str) -> DataFrame:
    """kind 0: (node, number of links); kind 1: (a, b), nodes that a list's links join."""

    def found(node: np.ndarray, links: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        some, away = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
        if len(some):
            yield pa.record_batch([pa.array(np.repeat([0, 1], [len(some), len(away)]).astype(np.int32)), pa.array(np.concatenate([node[some], node[away]])), pa.array(np.concatenate([links[some].astype(np.int64), node[label[away]]]))], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size in streamed(batches):
            node, many = rows.column(6).to_numpy(), rows.column(8).to_numpy()
            if size is not None:
                one, two = of_lists(rows, size)
                for dim, own, x in by_dim(rows.column(9), kind):
                    place = np.full(rows.num_rows, -1)
                    place[own] = np.arange(len(own))
                    mine = np.flatnonzero(place[one] >= 0)
                    i, j, cos = place[one[mine]], place[two[mine]], np.empty(len(mine))
                    step = max(1, (1 << 22) // dim)
                    for a in range(0, len(i), step):
                        cos[a : a + step] = np.einsum("nd,nd->n", x[i[a : a + step]], x[j[a : a + step]])
                    ok = cos >= cosine
                    for a in np.flatnonzero(np.abs(cos - cosine) < 1e-12).tolist():
                        ok[a] = float(np.sum(x[i[a]] * x[j[a]])) >= cosine
                    i, j, n = i[ok], j[ok], len(own)
                    links = np.bincount(i, many[own[j]], n) + np.bincount(j, many[own[i]], n)
                    yield from found(node[own], links, least_labels(n, i, j))
                continue
            side, here = rows.column(3).to_numpy(), rows.column(1)[0].as_py() == rows.column(2)[0].as_py()
            x, y = (np.arange(len(node)),) * 2 if here else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if not len(x) or not len(y):
                continue
            near, vector = stretches(rows.column(7), "<u2"), unit(stretches(rows.column(9), kind))
            ok = first_shared(near[x], near[y], rows.column(4)[0].as_py(), rows.column(5)[0].as_py())
            if here:
                ok &= np.tri(len(x), k=-1, dtype=bool)
            ok &= linked(vector[x] @ vector[y].T, vector[x], vector[y], cosine)
            if here:
                ok |= ok.T
                # A row and its own column are one node, or else the two ends of a chain of links would stay apart.
                yield from found(node, ok @ many.astype(np.float64), block_labels(ok | np.eye(len(x), dtype=bool))[: len(x)])
            else:
                both = np.concatenate([x, y])
                yield from found(node[both], np.concatenate([ok @ many[y].astype(np.float64), many[x].astype(np.float64) @ ok]), block_labels(ok))

    ordered = rows.select("list", "i", "j", "side", "p", "q", "node", "near", "many", "vector").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    return ordered.mapInArrow(run, "kind int, a long, b long")


def long_lists(nodes: DataFrame, held, total: int) -> dict[int, int]:
    """Lists with more members than one task compares alone, with the blocks that they are cut into: estimated from
    nodes picked by their names (how a list is cut never changes what is found)."""
    every = max(1, total // SAMPLE)
    some = posted(nodes.where(F.pmod("node", F.lit(every)) == 0), held, {})
    found = some.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") >= max(64, ALONE // every))  # so there are SAMPLE * lists of a node / 64 at most
    return {r["list"]: -(-r["n"] * every // ALONE) for r in found.collect() if r["n"] * every > ALONE}


def near_duplicates(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str | None = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    stages = Stages(spark, "pivots")
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    source = vectors.select(F.monotonically_increasing_id().alias("_id"), F.col(id_).cast("long").alias("vec_id"), (F.col(label) if label else F.lit(0)).cast("string").alias("label"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))
    rows = stages.write(prepare(source, kind))
    good = rows.where("digest is not null and vec_id is not null")
    # A node is a distinct vector with its label, named by 64 bits of its digest, and looked at in one of its rows.
    groups = stages.write(good.groupBy("digest").agg(F.min("_id").alias("_id"), F.min("vec_id").alias("least"), F.count("*").alias("many")).withColumn("node", F.xxhash64("digest")))
    total = groups.count()
    picked = groups.orderBy(F.xxhash64("digest"), "digest").limit(max(LEAST, min(MOST, total // PER_PIVOT))).select("_id")
    sample = sorted(bytes(r["vector"]) for r in rows.join(F.broadcast(picked), "_id").select("vector").collect())  # MOST vectors at most
    held = spark.sparkContext.broadcast({dim: Pivots(x, cosine) for dim, _, x in by_dim(pa.array(sample, pa.binary()), kind)} if sample else {})
    nodes = stages.write(described(good, held, kind).join(groups.select("_id", "node", "many"), "_id"))
    own = needed(posted(nodes, held, hot := long_lists(nodes, held, total)))
    own = stages.write(own.dropDuplicates(["list", "node"]) if hot else own)
    wanted = stages.write(nodes.select("_id", "node", "many").join(own.select("node").distinct(), "node"))
    fetched = rows.select("_id", "vector").where(id_filter(wanted, "_id")("_id")).join(wanted, "_id").select("node", "many", "vector")
    sizes = own.groupBy("list").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    inside = skew_join(own, sizes, "list", "n", max(1, total), scatter=["node", "list"])
    inside = inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block i meets block j >= i: each row goes to the tasks of its block with all others.
    inside = inside.join(fetched, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = inside.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    found = stages.write(compare(inside, cosine, kind))
    stages.drop(nodes, own, wanted)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    comps = components(stages, found.where("kind = 1").select("a", "b"))
    least_of = groups.select("node", "least").join(comps, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    comps = comps.join(least_of, "component").select("node", "component_id")
    named = groups.select("digest", "node", "many", "least").join(counts, "node", "left").join(comps, "node", "left")
    named = named.select("digest", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = skew_join(rows.where("vec_id is not null").select("vec_id", "digest"), named, "digest", "many", max(1, total), scatter=["vec_id"])
    out = out.unionByName(rows.where("vec_id is null").select("vec_id", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")), allowMissingColumns=True)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_pivot_dedup": op2_pivot_dedup}
SQL = {
    "op2_pivot_dedup": f"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(embedding) > 0
and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(node, c) as (select vec_id, vec_id from embeddings union select l.a, r.c from reach r join links l on l.b = r.node),
comps as (select node, min(c) as component_id from reach group by 1), counts as (select a, count(*) as n from links group by 1)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept from embeddings e join comps on node = e.vec_id left join counts on a = e.vec_id"""
}
