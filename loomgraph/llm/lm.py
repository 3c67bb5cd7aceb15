"""Language-model scoring: an interpolated modified Kneser-Ney model of any order from 2 on, counted in Spark, stored as
sorted hash arrays that workers map into memory.

Tasks count runs of `order` words and send them to shards by the last word of their history.  All runs of one history
then lie in one shard, and so do the shorter runs that they end in: a shard's task writes the counts of the highest order
and, as a shorter run's count is the number of distinct words before it (or how often it comes where it begins a text,
for nothing stands before that), those of every lower order down to two words.  A second, small exchange by following
word gives continuation counts.  A history's last word is sent once for all of its runs in a task, a following word once
for all runs with both; words before as 32 bits of their hashes, following words as 40.

Histories with so many runs that they would fill a shard are hot (they are looked for in a bounded sample; where a run
goes never changes what is counted).  A run goes by the shortest end of its history that isn't hot, or as a whole if all
are.  Shorter runs with a hot history are then added up in the second exchange, and hot histories' totals by the last
aggregate, which has a row for each.

Files go to the shared folder, under a temporary name first, so that a repeated task does no harm; every executor maps
the same files and touches only the pages that its texts ask for.  Keys hold history_bits() of a history's hash and the
rest of the following word's, within a shard: an unseen run is taken for a seen one with a chance of about its history's
followers / 2^28, an unseen history of two and more words with one of about the shard's histories / 2^36.  Words by
themselves have 64 bits.

Words are white-space separated, A-Z lower-cased; every text ends in an end token.  Null is empty; repeated rows count
as often as they come; very long texts are read like any other; with nothing to learn from, every token has the chance
of the unknown one; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Folder, shared_dir, table
from .text import mix, slices, words_of
from .toxicity import remainder

#: Words of the longest runs that the query counts.
ORDER = 3
#: Bytes of training text for each shard of the model, and distinct runs that a task counts before it sends.
SHARD_BYTES, FLUSH = 24 << 20, 3_000_000
#: Bytes of text in the sample that hot middles and histories are looked for in, and the least share that is hot.
SAMPLE_BYTES, HOT_SHARE = 16 << 20, 1e-5
END, BEGIN = (int(x) for x in mix(np.array([0x656E64, 0x626567696E], np.uint64) << np.uint64(20)))
#: Where nothing stands: before the begin of a text.
NONE = 0
#: Followers up to which a history's totals are added up when they are asked for.
FEW = 16

U = np.uint64


def first32(w: np.ndarray) -> np.ndarray:
    """32 bits of first words; 0 is for none alone."""
    return np.where(w == U(NONE), U(0), np.maximum(w >> U(32), U(1)))


def last40(w: np.ndarray) -> np.ndarray:
    return w >> U(24)


def history_bits(k: int) -> int:
    return 30 if k == 2 else 36


def longer(history: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of the history with one more word (32 bits) before it; that of one word is the word's."""
    with np.errstate(over="ignore"):
        return mix(history * U(3) + before)


def run_key(k: int, history: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sorted keys stand by history.  last: 40 bits."""
    rest = U(64 - history_bits(k))
    return (mix(history) >> rest << rest) | (last >> U(40 - 64 + history_bits(k)))


def shard_of(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


class Routes:
    """Where runs go.  hot: for histories of 1, 2, ... words their sorted hashes; spread: shards that each of those of one
    word is dealt over.  What a hot history ends in is hot too."""

    def __init__(self, bits: int, hot: list[np.ndarray], spread: np.ndarray):
        self.bits, self.hot, self.spread = bits, hot, spread

    def home(self, word: np.ndarray) -> np.ndarray:
        """By other bits than those that keys begin with."""
        return shard_of(mix(word ^ U(0x686F6D65)), self.bits)

    def is_hot(self, words: int, history: np.ndarray) -> np.ndarray:
        have = self.hot[words - 1] if words <= len(self.hot) else ()
        if not len(have):
            return np.zeros(len(history), bool)
        return have[np.minimum(np.searchsorted(have, history), len(have) - 1)] == history

    def place(self, histories: list[np.ndarray], last: np.ndarray) -> np.ndarray:
        """histories: hashes of the last word, of the last two, and so on.  last: 40 bits."""
        out = self.home(histories[0])
        at = np.flatnonzero(self.is_hot(1, histories[0]))
        if len(at):
            n = self.spread[np.searchsorted(self.hot[0], histories[0][at])].astype(U)
            open_, key = np.ones(len(at), bool), np.zeros(len(at), U)
            for words, h in enumerate(histories[1:], 2):
                cold = open_ & ~self.is_hot(words, h[at])
                key[cold], open_ = h[at][cold], open_ & ~cold
            with np.errstate(over="ignore"):
                key[open_] = mix(histories[-1][at][open_] * U(7) + last[at][open_])
                out[at] = (out[at] + (mix(key + U(9)) % n).astype(np.int64)) & ((1 << self.bits) - 1)
        return out


# --- stored arrays


def store(folder: Folder, name: str, key: np.ndarray, count: np.ndarray) -> None:
    """Sorted distinct keys with counts: where each of 2**16 leading bits begins, the other 48 bits, and counts of one
    byte (255: the count stands in a list of its own)."""
    if not len(key):
        return
    edge = np.searchsorted(key >> U(48), np.arange((1 << 16) + 1).astype(U)).astype("<u4")
    large = np.flatnonzero(count >= 255)
    parts = [np.array([len(key), len(large)], "<u4"), edge, large.astype("<u4"), count[large].astype("<u8"), (key & U(0xFFFFFFFF)).astype("<u4"), ((key >> U(32)) & U(0xFFFF)).astype("<u2"), np.minimum(count, 255).astype("u1")]
    folder.write(name, np.frombuffer(b"".join(x.tobytes() for x in parts), "u1"))


class Stored:
    """What store() wrote, mapped."""

    def __init__(self, folder: Folder, name: str):
        raw = np.asarray(folder.map(name, "u1"))
        self.n = 0
        if not len(raw):
            return
        self.n, large = (int(x) for x in raw[:8].view("<u4"))
        at = 8
        for field, kind, size in (("edge", "<u4", (1 << 16) + 1), ("large", "<u4", large), ("large_n", "<u8", large), ("low", "<u4", self.n), ("high", "<u2", self.n), ("count", "u1", self.n)):
            end = at + size * np.dtype(kind).itemsize
            setattr(self, field, raw[at:end].view(kind))
            at = end

    def lower(self, key: np.ndarray) -> np.ndarray:
        """How many stored keys are less than each key: all searches go on side by side, by the 16 bits behind the
        leading ones, and by the last 32 where those are equal."""
        lead = (key >> U(48)).astype(np.int64)
        lo, hi = self.edge[lead].astype(np.int64), self.edge[lead + 1].astype(np.int64)
        high, low = ((key >> U(32)) & U(0xFFFF)).astype(np.uint16), (key & U(0xFFFFFFFF)).astype(np.uint32)
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            have = self.high.take(mid, mode="clip")
            less = have < high
            if len(tie := np.flatnonzero(have == high)):
                less[tie] = self.low.take(mid[tie], mode="clip") < low[tie]
            less &= lo < hi
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        return lo

    def has(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the keys stand at these places, as lower() gives them."""
        lead, own = (key >> U(48)).astype(np.int64), np.minimum(at, self.n - 1)
        return (((self.high[own].astype(U) << U(32)) | self.low[own]) == key & U(0xFFFFFFFFFFFF)) & (self.edge[lead] <= at) & (at < self.edge[lead + 1])

    def leads(self, at: np.ndarray, rest: np.uint64, lead: np.ndarray) -> np.ndarray:
        """Whether the keys at these places begin with the given bits (all but `rest` of them); the places are at or behind
        where such keys begin, so the 16 leading bits are wrong only past their end."""
        own = (self.high[at].astype(U) << U(32)) | self.low[at]
        inside = at < self.edge[(lead >> U(48 - int(rest))).astype(np.int64) + 1]
        return inside & (own >> rest == lead & U((1 << (48 - int(rest))) - 1))

    def counts(self, at: np.ndarray) -> np.ndarray:
        out = self.count[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.large_n[np.searchsorted(self.large, at[big])]
        return out

    def get(self, key: np.ndarray) -> np.ndarray:
        """Counts of keys; 0 for those not there."""
        if not self.n or not len(key):
            return np.zeros(len(key), np.int64)
        at = self.lower(key)
        same = self.has(key, at)
        out = np.zeros(len(key), np.int64)
        out[same] = self.counts(at[same])
        return out


def kinds_of(count: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4 and more."""
    return np.bincount(np.minimum(count, 5), minlength=6)[1:6]


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3) <= 0:
        return np.array([0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0, [0, 0.99, 1.99, 2.99])


# --- runs


def edges(sorted_: np.ndarray) -> np.ndarray:
    """Where each distinct value begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def spans(edge: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Begin and end of each stretch of n places."""
    return list(zip(edge.tolist(), [*edge[1:].tolist(), n][: len(edge)], strict=True))


def add(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, edge) if len(edge) else x[:0]


class Runs:
    """Runs of words: the history's last word, the words before it (32 bits each, nearest first), the following word (40
    bits), counts, and raw counts."""

    def __init__(self, word: np.ndarray, before: list[np.ndarray], last: np.ndarray, n: np.ndarray, raw: np.ndarray):
        self.word, self.before, self.last, self.n, self.raw = word, before, last, n, raw
        self.k = len(before) + 2

    def __len__(self) -> int:
        return len(self.word)

    def take(self, at: np.ndarray) -> Runs:
        return Runs(self.word[at], [x[at] for x in self.before], self.last[at], self.n[at], self.raw[at])

    @staticmethod
    def cat(parts: list[Runs], k: int) -> Runs:
        get = lambda f, t: np.concatenate([f(p) for p in parts]) if parts else np.zeros(0, t)
        return Runs(get(lambda p: p.word, U), [get(lambda p, i=i: p.before[i], U) for i in range(k - 2)], get(lambda p: p.last, U), get(lambda p: p.n, np.int64), get(lambda p: p.raw, np.int64))

    def histories(self) -> list[np.ndarray]:
        out = [self.word]
        for x in self.before:
            out.append(longer(out[-1], x))
        return out

    def merged(self) -> tuple[Runs, np.ndarray]:
        """Each run once, in order of keys, and the keys."""
        key = run_key(self.k, self.histories()[-1], self.last)
        order = np.argsort(key)
        key = key[order]
        edge = edges(key)
        out = self.take(order[edge])
        out.n, out.raw = add(self.n[order], edge), add(self.raw[order], edge)
        return out, key[edge]

    def shorter(self) -> Runs:
        """Runs without their first words: each counts once for each distinct word before it, or as often as it comes
        where nothing stands before."""
        return Runs(self.word, self.before[:-1], self.last, np.where(self.before[-1] == U(NONE), self.n, 1), self.raw)

    def packed(self, routes: Routes) -> Iterator[tuple[int, tuple]]:
        """For each shard its runs: by word, then by following word, each of which is there once for its runs."""
        histories = self.histories()
        place = routes.place(histories, self.last)
        with np.errstate(over="ignore"):
            key = (mix(self.word) >> U(44) << U(44)) | (mix(self.word * U(3) + self.last) >> U(20))
        if routes.bits:
            key = (key >> U(routes.bits)) | (place.astype(U) << U(64 - routes.bits))
        order = np.argsort(key)
        own, place = self.take(order), place[order]
        for shard in np.unique(place).tolist():
            a, b = np.searchsorted(place, shard), np.searchsorted(place, shard, "right")
            word, last = own.word[a:b], own.last[a:b]
            new_w = np.concatenate([[True], word[1:] != word[:-1]])
            at_w, at_l = np.flatnonzero(new_w), np.flatnonzero(new_w | np.concatenate([[True], last[1:] != last[:-1]]))
            size_w, size_l = np.diff(np.append(np.searchsorted(at_l, at_w), len(at_l))), np.diff(np.append(at_l, b - a))
            n, raw = own.n[a:b].astype("<u4"), own.raw[a:b].astype("<u4")
            yield shard, (self.k, word[at_w], size_w.astype("<u4"), (last[at_l] & U(0xFFFFFFFF)).astype("<u4"), (last[at_l] >> U(32)).astype("u1"), size_l.astype("<u4"), [x[a:b].astype("<u4") for x in own.before], n, None if (n == raw).all() else raw)

    @staticmethod
    def unpacked(x: tuple) -> Runs:
        _, word, size_w, low, high, size_l, before, n, raw = x
        size_l = size_l.astype(np.int64)
        per_word = add(size_l, np.concatenate([[0], np.cumsum(size_w)[:-1]]).astype(np.int64))
        last = (high.astype(U) << U(32)) | low
        return Runs(np.repeat(word, per_word), [b.astype(U) for b in before], np.repeat(last, size_l), n.astype(np.int64), (n if raw is None else raw).astype(np.int64))


#: Numbers of a statistic: what it is about (an order's numbers; HOT + order: a hot history's; 2 * HOT: a hot word's own
#: count), a key, and values.
HOT, VALUES = 100, 9
STATISTIC = ["about", "key", *(f"v{i}" for i in range(VALUES))]


def statistic(about: int, key: int, *values: int) -> list[int]:
    return [about, int(np.array([key], U).view(np.int64)[0]), *(int(v) for v in values), *[0] * (VALUES - len(values))]


def write_runs(folder: Folder, name: str, key: np.ndarray, runs: Runs, partial: np.ndarray) -> list[list[int]]:
    """Stores counts of runs (in order of keys), and the totals of histories with more than FEW followers.  partial: of
    histories with more runs elsewhere; their totals are returned, with the order's numbers."""
    k, n = runs.k, runs.n
    store(folder, f"run.{k}-{name}", key, n)
    rest = U(64 - history_bits(k))
    edge = edges(key >> rest)
    total, kinds, size = add(n, edge), [add((n == 1).astype(np.int64), edge), add((n == 2).astype(np.int64), edge), add((n >= 3).astype(np.int64), edge)], np.diff(np.append(edge, len(key)))
    away = partial[edge]
    own = np.flatnonzero((size > FEW) & ~away)
    if len(own):
        folder.write(f"history.{k}-{name}", np.concatenate([(key[edge[own]] >> rest).astype("<u8"), *(x[own].astype("<u8") for x in (total, *kinds))]))
    history = runs.histories()[-1]
    return [statistic(k, 0, *kinds_of(n)), *(statistic(HOT + k, int(history[edge[i]]), total[i], *(x[i] for x in kinds)) for i in np.flatnonzero(away).tolist())]


def message(shard: int, kind: str, x: object) -> pa.RecordBatch:
    return pa.record_batch([pa.array([shard], pa.int32()), pa.array([kind]), pa.array([pickle.dumps(x, protocol=5)], pa.binary())], names=["shard", "kind", "x"])


MESSAGE = "shard int, kind string, x binary"


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """What came for each shard by kind; rows come in order of shard."""
    now, found = None, {}
    for batch in batches:
        for shard, kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if shard != now and found:
                yield now, found
                found = {}
            now = shard
            found.setdefault(kind, []).append(pickle.loads(x.as_buffer()))
    if found:
        yield now, found


# --- counting


def sequence(w, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Tokens of the texts (words and end); for k = 1, ... the words k places before each, up to order - 1 (the begin of
    the text is one, before it is none); and where each text begins."""
    n = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    tokens = np.empty(first[-1], U)
    at = np.ones(len(tokens), bool)
    at[first[1:] - 1] = False
    tokens[at] = w.hash
    tokens[first[1:] - 1] = END
    past = np.arange(len(tokens)) - np.repeat(first[:-1], n + 1)
    back = []
    for k in range(1, order):
        own = np.full(len(tokens), NONE, U)
        own[past == k - 1] = BEGIN
        i = np.flatnonzero(past >= k)
        own[i] = tokens[i - k]
        back.append(own)
    return tokens, back, first


def hot_histories(docs: DataFrame, order: int, bits: int, total: int) -> Routes:
    """Histories with more than half a shard's share of the runs, from texts picked by a hash.  A task sends those that
    are near it among its own: HOT_SHARE bounds their number, and the number of rows that come back."""
    shards, every = 1 << bits, max(1, total // SAMPLE_BYTES)
    least = max(0.5 / shards, HOT_SHARE)
    if not bits:
        return Routes(bits, [], np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in slices(batches):
            tokens, back, _ = sequence(words_of(data, bounds), order)
            out, h = [(0, 0, 0, len(tokens))], back[0]
            for words in range(1, order):
                end = h
                h = longer(h, first32(back[words - 1])) if words > 1 else h
                there = back[words - 1] != U(NONE)
                u, at, c = np.unique(h[there], return_index=True, return_counts=True)
                own = c >= max(2, least * len(tokens) / 4)
                out += [(words, *x) for x in zip(u[own].view(np.int64).tolist(), end[there][at[own]].view(np.int64).tolist(), c[own].tolist(), strict=True)]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["words", "key", "end", "n"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0) if every > 1 else docs
    sums = some.mapInArrow(run, "words int, key long, end long, n long").groupBy("words", "key", "end").agg(F.sum("n").alias("n"))
    size = sums.where("words = 0").agg(F.max("n")).head()[0] or 1
    found: dict[int, dict[int, int]] = {w: {} for w in range(order)}
    for r in sums.where((F.col("words") > 0) & (F.col("n") > least * size)).orderBy("words").collect():  # 1 / HOT_SHARE of a length at most
        if r["words"] == 1 or r["end"] in found[r["words"] - 1]:  # what a hot history ends in is hot too
            found[r["words"]][r["key"]] = r["n"]
    hot = [np.sort(np.array(list(found[w]), np.int64).view(U)) for w in range(1, order)]
    spread = np.clip(np.ceil(np.array([found[1][h] for h in hot[0].view(np.int64).tolist()]) / size * shards * 2), 2, shards).astype(np.int64)
    return Routes(bits, hot, spread)


def count(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, order: int = 2) -> dict:
    """Counts all rows; returns the model: its folder and numbers."""
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    docs = docs.select(F.col(text).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / shard_bytes)))))
    shards = 1 << bits
    routes = hot_histories(docs, order, bits, total)
    held = spark.sparkContext.broadcast(routes)  # 1 / HOT_SHARE hashes at most for each order

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Runs] = []
        size = 0
        for _, data, bounds in slices(batches, size=1 << 20):
            tokens, back, _ = sequence(words_of(data, bounds), order)
            one = np.ones(len(tokens), np.int64)
            parts.append(Runs(back[0], [first32(x) for x in back[1:]], last40(tokens), one, one).merged()[0])
            size += len(parts[-1])
            if size >= FLUSH:
                for shard, x in Runs.cat(parts, order).merged()[0].packed(held.value):
                    yield message(shard, "runs", x)
                parts, size = [], 0
        if parts:
            for shard, x in Runs.cat(parts, order).merged()[0].packed(held.value):
                yield message(shard, "runs", x)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, r = Folder(base), held.value
        for shard, found in by_shard(batches):
            runs, key = Runs.cat([Runs.unpacked(x) for x in found["runs"]], order).merged()
            del found
            out = own_words(folder, f"{shard}", runs, r.is_hot(1, runs.word))
            for k in range(order, 1, -1):
                histories = runs.histories()
                hot = r.is_hot(k - 1, histories[-1])
                # Runs of the highest order are whole here, whatever their history; others not if it is hot.
                real = runs.before[-1] != U(NONE) if k > 2 else np.ones(len(runs), bool)
                whole = real if k == order else real & ~hot
                late = real & ~whole
                at = np.flatnonzero(whole)
                out += write_runs(folder, f"{shard}", key[at], runs.take(at), hot[at])
                if late.any():
                    yield from (message(s, "late", x) for s, x in sent_late(runs.take(np.flatnonzero(late)), bits))
                if k > 2:  # what was sent is counted where it is whole
                    runs, key = runs.take(np.flatnonzero(~late)).shorter().merged()
                else:
                    u, c = np.unique(runs.last[at], return_counts=True)
                    yield from (message(s, "words", x) for s, x in sent_words(u, c, bits))
            yield message(shard, "numbers", out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(base)
        for shard, found in by_shard(batches):
            out = [x for xs in found.get("numbers", []) for x in xs]
            words = found.get("words", [])
            word, n = (np.concatenate([x[i] for x in words] or [np.zeros(0, t)]).astype(t) for i, t in ((0, U), (1, np.int64)))
            late: list[Runs] = [Runs.unpacked(x) for x in found.get("late", [])]
            for k in range(order - 1, 1, -1):
                own = [x for x in late if x.k == k]
                if not own:
                    continue
                runs, key = Runs.cat(own, k).merged()
                out += write_runs(folder, f"late-{shard}", key, runs, np.ones(len(runs), bool))
                if k > 2:
                    late.append(runs.shorter())
                else:
                    word, n = np.concatenate([word, runs.last]), np.concatenate([n, np.ones(len(runs), np.int64)])
            u, inverse = np.unique(word, return_inverse=True)
            c = np.bincount(inverse, n, len(u)).astype(np.int64)
            store(folder, f"word-{shard}", u << U(24), c)
            out.append(statistic(1, 0, *kinds_of(c)))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=STATISTIC)

    sent = docs.mapInArrow(grams, MESSAGE).repartitionById(shards, "shard").sortWithinPartitions("shard")
    sent = sent.mapInArrow(merge, MESSAGE).repartitionById(shards, "shard").sortWithinPartitions("shard")
    sums = sent.mapInArrow(join, ", ".join(f"{c} long" for c in STATISTIC)).groupBy("about", "key").agg(*(F.sum(c).alias(c) for c in STATISTIC[2:]))
    x = np.zeros((order, VALUES), np.int64)
    hot: dict[int, dict[int, list[int]]] = {k: {} for k in range(2, order + 1)}
    own: dict[int, int] = {}
    for r in sums.collect():  # a row for each order and each hot history
        about, key, v = r["about"], int(np.array([r["key"]], np.int64).view(U)[0]), [int(y) for y in r[2:]]
        if about < HOT:
            x[about - 1] += v
        elif about < 2 * HOT:
            hot[about - HOT][key] = v[:4]
        else:
            own[key] = v[0]
    tokens, words, ends = (int(v) for v in x[1, 5:8])
    pairs = int(x[1, :5].sum())
    words += sum(w != BEGIN for w in own)
    tables = {k: (np.array(sorted(v), U), np.array([v[h] for h in sorted(v)], np.int64).reshape(-1, 4)) for k, v in hot.items()}
    mine = np.array(sorted(own), U), np.array([own[w] for w in sorted(own)], np.int64)
    return {"folder": base, "order": order, "routes": routes, "hot": tables, "own": mine, "d": [discounts(y[:4]) for y in x], "cont_kinds": [int(x[0, 0]), int(x[0, 1]), int(x[0, 2:5].sum())], "tokens": tokens, "types": words + (ends > 0), "ends": ends, "pairs": pairs}


def own_words(folder: Folder, name: str, runs: Runs, hot: np.ndarray) -> list[list[int]]:
    """Stores how often the words before the following ones come; those of hot ones are returned, with the numbers of
    tokens, words and ends.  Each token follows one word, so these are the words' own counts."""
    order = np.argsort(runs.word, kind="stable")
    edge = edges(runs.word[order])
    word, raw, away = runs.word[order][edge], add(runs.raw[order], edge), hot[order][edge]
    store(folder, f"own-{name}", word[~away], raw[~away])
    end = int(runs.raw[runs.last == last40(np.array([END], U))[0]].sum())
    numbers = statistic(2, 0, 0, 0, 0, 0, 0, int(runs.raw.sum()), int((word[~away] != U(BEGIN)).sum()), end)
    return [numbers, *(statistic(2 * HOT, int(w), n) for w, n in zip(word[away].tolist(), raw[away].tolist(), strict=True))]


def sent_words(word: np.ndarray, n: np.ndarray, bits: int) -> Iterator[tuple[int, tuple]]:
    """Sorted following words with numbers, to the shards of the words."""
    shard = shard_of(word << U(24), bits)
    edge = edges(shard)
    for a, b in spans(edge, len(shard)):
        yield int(shard[a]), (word[a:b], n[a:b].astype("<u4"))


def sent_late(runs: Runs, bits: int) -> Iterator[tuple[int, tuple]]:
    """Runs with hot histories, to the shards of the following words."""
    shard = shard_of(runs.last << U(24), bits)
    for s in np.unique(shard).tolist():
        own = runs.take(np.flatnonzero(shard == s))
        yield from ((s, x) for _, x in own.packed(Routes(0, [], np.zeros(0, np.int64))))


# --- scoring


class Model:
    def __init__(self, about: dict):
        self.about, self.folder, self.maps = about, Folder(about["folder"]), {}
        self.routes: Routes = about["routes"]

    def stored(self, name: str) -> Stored:
        if name not in self.maps:
            self.maps[name] = Stored(self.folder, name)
        return self.maps[name]

    def totals(self, name: str) -> np.ndarray:
        """(5, histories): keys, totals, and followers seen once, twice, more often."""
        if name not in self.maps:
            self.maps[name] = self.folder.map(name, "<u8").reshape(5, -1)
        return self.maps[name]

    @staticmethod
    def each(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
        edge = edges(place[order])
        for a, b in spans(edge, len(place)):
            yield int(place[order[a]]), order[a:b]

    def counts(self, name: str, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        for s, at in self.each(place):
            out[at] = self.stored(f"{name}-{s}").get(key[at])
        return out

    def own(self, word: np.ndarray) -> np.ndarray:
        """How often each word comes."""
        out = self.counts("own", self.routes.home(word), word)
        have, n = self.about["own"]
        if len(have):
            at = np.minimum(np.searchsorted(have, word), len(have) - 1)
            out = np.where(have[at] == word, n[at], out)
        return out

    def history(self, k: int, place: np.ndarray, history: np.ndarray) -> np.ndarray:
        """(histories, 4): total, and followers seen once, twice, more often; 0 for those not there."""
        out = np.zeros((len(history), 4), np.int64)
        rest = U(64 - history_bits(k))
        key = mix(history) >> rest
        hot = self.routes.is_hot(k - 1, history)
        if hot.any():
            have, values = self.about["hot"][k]
            if len(have):
                at = np.minimum(np.searchsorted(have, history), len(have) - 1)
                hit = hot & (have[at] == history)
                out[hit] = values[at[hit]]
        cold = np.flatnonzero(~hot)
        for s, part in self.each(place[cold]):
            own = cold[part]
            large = self.totals(f"history.{k}-{s}")
            found = np.zeros(len(own), bool)
            if large.shape[1]:
                at = np.minimum(np.searchsorted(large[0], key[own]), large.shape[1] - 1)
                found = large[0][at] == key[own]
                out[own[found]] = large[1:, at[found]].T.astype(np.int64)
            own = own[~found]
            runs = self.stored(f"run.{k}-{s}")
            if not runs.n or not len(own):
                continue
            # Few followers, one after another: most histories have one or two.
            at, live = runs.lower(key[own] << rest), np.arange(len(own))
            for _ in range(FEW + 1):
                live = live[at[live] < runs.n]
                live = live[runs.leads(at[live], rest, key[own[live]])]
                if not len(live):
                    break
                n = runs.counts(at[live])
                out[own[live], 0] += n
                out[own[live], np.minimum(n, 3)] += 1
                at[live] += 1
        return out

    def score(self, words) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base, score of each text."""
        m, bits = self.about, self.routes.bits
        tokens, back, first = sequence(words, m["order"])
        u, of = np.unique(tokens, return_inverse=True)
        follow = self.counts("word", shard_of(u, bits), last40(u) << U(24))
        own = np.where(u == U(END), m["ends"], self.own(u))
        base = np.log10((own + 0.5) / (m["tokens"] + 0.5 * (m["types"] + 1)))
        unknown = 1 / (m["types"] + 1)
        if m["pairs"]:
            d = m["d"][0]
            low = np.maximum(follow - d[np.minimum(follow, 3)], 0) / m["pairs"] + np.dot(d[1:], m["cont_kinds"]) / m["pairs"] * unknown
        else:
            low = np.full(len(u), unknown)
        p, histories, last = low[of], [], last40(tokens)
        for k in range(2, m["order"] + 1):
            histories.append(longer(histories[-1], first32(back[k - 2])) if k > 2 else back[0])
            real = np.flatnonzero(back[k - 2] != U(NONE))  # another is counted by a lower order, and leaves the chance as it is
            if not len(real):
                continue
            # Runs once each, in order of keys, and so of histories.
            key = run_key(k, histories[-1][real], last[real])
            order = np.argsort(key)
            edge = edges(key[order])
            r_of = np.empty(len(key), np.int64)
            r_of[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(key))))
            key, at = key[order[edge]], real[order[edge]]
            begins = edges(key >> U(64 - history_bits(k)))
            h_of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
            ends = at[begins]
            total = self.history(k, self.routes.place([x[ends] for x in histories], last[ends]), histories[-1][ends])
            late = self.routes.is_hot(k - 1, histories[-1][at]) & (k < m["order"])
            n = np.zeros(len(key), np.int64)
            n[~late] = self.counts(f"run.{k}", self.routes.place([x[at[~late]] for x in histories], last[at[~late]]), key[~late])
            n[late] = self.counts(f"run.{k}-late", shard_of(last[at[late]] << U(24), bits), key[late])
            d, t = m["d"][k - 1], np.maximum(total[:, 0], 1)
            there = total[:, 0] > 0
            back_off = np.where(there, total[:, 1:] @ d[1:] / t, 1.0)[h_of]
            own_part = np.where(there[h_of], np.maximum(n - d[np.minimum(n, 3)], 0) / t[h_of], 0.0)
            p[real] = own_part[r_of] + back_off[r_of] * p[real]
        add_ = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
        return np.diff(first), add_((own > 0)[of].astype(np.int64)), add_(base[of]), add_(np.log10(p))


def score(docs: DataFrame, train: Column, order: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row; rows that `train` picks
    are learned from."""
    about = count(docs.where(train), shard_bytes=shard_bytes, order=order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(about)
        for part, data, bounds in slices(batches, size=2 << 20):
            n, known, base, own = model.score(words_of(data, bounds))
            yield pa.record_batch([part.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), about["tokens"])), pa.array(base), pa.array(own), pa.array(10 ** np.minimum(300, -own / n))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder(5) == 1, F.lit(False))
    out = score(table(spark, sf_dir, "documents"), ~held, ORDER)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES = {"op4_kneser_ney": op4_kneser_ney}
SQL: dict[str, str] = {}
