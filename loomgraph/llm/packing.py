"""Packing documents into sequences by deficit round-robin over source queues, token by token.

In round r every queue with tokens left is granted its quantum, its target share of one window of tokens, and sends
as many tokens as its credit has whole ones; the fraction carries on.  So after r rounds a queue has sent its first
floor(r * quantum) tokens, and a document is split where its queue's running total passes these bounds.  This makes
the sequential scheme a sum over rows: deficits carry over windows and partitions alike, without a pass in one task,
and where a token stands in the stream follows from its place in its queue and the queues' quanta and sizes alone.
The stream of rounds is then cut every `length` tokens, so only the last sequence has padding, and each window has its
share of every queue that still has tokens, give or take one token a queue.

A source whose share of a window is one token or more has a queue of its own, so there are `length` of these at most;
all other sources share one more queue, which is granted their joint share (one token a round at least).

Null text is empty and packs as its end token; a null source is a source of its own; repeated rows are packed each; very
long texts go through as any other, cut by rounds; rows of a queue keep the order of the table; an empty table gives no
pieces; no other columns are read."""

from __future__ import annotations

import gc
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, running_total, table
from .text import slices, words_of

LENGTH, END_ID = 4096, 2
#: The query's targets: shares of a window in proportion to this power of the sources' tokens, so that small sources are
#: seen more often than they come, while they last.
POWER = 0.7
#: Distinct words whose ids a worker keeps in each of two generations.
MEMO = 150_000
#: Binary places of a quantum behind the point, and entries of a table of rounds and queues at a time.
PLACES, TABLE = 16, 1 << 21
#: Characters whose words are encoded as a whole: rare white space, and a sigma, which lower-casing treats by its place.
_WHOLE = regex.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u03a3]")
#: Fixed value: how this kind of vocabulary splits text.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of texts.  A text's ids are those of its words in turn, and a word's those of its pieces (white space is
    dropped by this kind of vocabulary): so each distinct word of a slice is looked up once, and each distinct piece
    is encoded once while it stays in the memo.  Words are told apart by 64-bit hashes that leave A-Z's case out."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_file(path), array("I", [end_id]).tobytes()
        # For pieces, which are in normal form and split already.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: tuple[dict[int, bytes], dict[int, bytes]] = {}, {}  # by generation
        self.pieces: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def run(self, texts: list[str], plain: bool = False) -> list[bytes]:
        encoder = self.plain if plain else self.tokenizer
        return [array("I", e.ids).tobytes() for i in range(0, len(texts), 20_000) for e in encoder.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]

    def fresh(self, words: list[str]) -> list[bytes]:
        """ids of words that the memo doesn't know."""
        split: list[list[str]] = []
        known, old = self.pieces
        missing, whole = {}, []
        for w in words:
            if w.isascii() or not _WHOLE.search(w):
                low = (w if w.isascii() else unicodedata.normalize("NFC", w)).lower()
                own = [low] if low.isalpha() else _PIECES.findall(low) if w.isprintable() else None
            else:
                own = None
            if own is None:  # as a whole; what it holds is no white space to us
                whole.append(w)
                own = []
            for x in own:
                if x not in known:
                    if x in old:
                        known[x] = old[x]
                    else:
                        missing[x] = None
            split.append(own)
        known.update(zip(missing, self.run(list(missing), plain=True), strict=True))
        rest = iter(self.run(whole))
        is_whole = iter(whole)
        want = next(is_whole, None)
        out = []
        for w, own in zip(words, split, strict=True):
            if not own and w is want:
                out.append(next(rest))
                want = next(is_whole, None)
            else:
                out.append(known[own[0]] if len(own) == 1 else b"".join([known[x] for x in own]))
        if len(known) > MEMO:
            self.pieces = {}, known
        return out

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts side by side, each with the end id, and where each text's begin."""
        if b"<|" in data.tobytes():  # special tokens are told apart by case: each text as a whole
            got = [x + self.end for x in self.run([data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])]
            return np.frombuffer(b"".join(got), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int64)
        w = words_of(data, bounds)
        order = np.argsort(w.hash, kind="stable")
        ranked = w.hash[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        first = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        keys = ranked[new].tolist()
        known, old = self.words
        got = list(map(known.get, keys))
        missing = []
        for i in [i for i, g in enumerate(got) if g is None]:
            if (g := old.get(keys[i])) is None:
                missing.append(i)
            else:
                got[i] = known[keys[i]] = g
        if missing:
            raw = data.tobytes()
            at = first[missing]
            fresh = self.fresh([raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            for i, g in zip(missing, fresh, strict=True):
                got[i] = known[keys[i]] = g
        if len(known) > MEMO:
            self.words = {}, known
        got.append(self.end)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), "<u4")
        start = np.cumsum(size) - size
        # The words of all texts in turn, with the end (the last entry) after each text.
        n = np.diff(w.first)
        edge = np.concatenate([[0], np.cumsum(n + 1)])
        entry = np.empty(edge[-1], np.int64)
        inner = np.ones(edge[-1], bool)
        inner[edge[1:] - 1] = False
        entry[inner], entry[edge[1:] - 1] = of, len(got) - 1
        count = size[entry]
        stop = np.cumsum(count)
        ids = flat[np.repeat(start[entry] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.concatenate([[0], stop[edge[1:] - 1]]).astype(np.int64)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """This process's encoder: the next task of a worker finds the vocabulary loaded and the memo filled."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """_id (rises in the order of the rows), doc_id, source, ids (binary, little-endian unsigned 32 bits, with the end
    id), doc_tokens for every row."""
    path = path or default_vocabulary()
    schema = "_id long, doc_id long, source string, ids binary, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, end_id)
        gc.freeze()
        gc.disable()  # lists of words come and go, and hold no cycles
        try:
            for part, data, bounds in slices(batches):
                ids, edge = encoder.encode(data, bounds)
                yield pa.record_batch([*part.columns[:3], binary(ids, edge), pa.array(np.diff(edge))], names=["_id", "doc_id", "source", "ids", "doc_tokens"])
        finally:  # the worker serves other tasks later
            gc.enable()
            gc.unfreeze()

    return docs.select(F.monotonically_increasing_id().alias("_id"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


def binary(ids: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Stretches of ids between the edges as a column of bytes, without copies of the ids."""
    return pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer((edge.astype(np.int64) * 4).tobytes()), pa.py_buffer(ids)]).cast(pa.binary())


class Queues:
    """Quanta (in 1 / 2**PLACES tokens) and sizes of the queues; the last one is that of the sources without their own."""

    def __init__(self, length: int, own: list[tuple[float, int]], rest: tuple[float, int]):
        """own, rest: share of a window and tokens."""
        self.length = length
        share, self.tokens = np.array([w for w, _ in (*own, rest)]), np.array([t for _, t in (*own, rest)], np.int64)
        self.quantum = np.maximum(1 << PLACES, np.rint(share * length * (1 << PLACES)).astype(np.int64))
        self.rounds = -(-(self.tokens << PLACES) // self.quantum)  # that each takes

    def sent(self, turn: np.ndarray, queue) -> np.ndarray:
        """Tokens that queues have sent after so many rounds."""
        turn = np.minimum(turn, self.rounds[queue])  # also keeps the product within 64 bits
        return np.minimum(self.tokens[queue], (turn * self.quantum[queue]) >> PLACES)

    def turn(self, place: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """The round that sends the token with that place in its queue."""
        return -(-((place + 1) << PLACES) // self.quantum[queue])

    def begins(self, turn: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Where in the stream a round's tokens of a queue begin: after all of the rounds before, and after the queues
        before it in the round."""
        out = np.empty(len(turn), np.int64)
        u, of = np.unique(turn, return_inverse=True)
        order = np.argsort(of, kind="stable")
        every, step = np.arange(len(self.tokens)), max(1, TABLE // len(self.tokens))
        for i in range(0, len(u), step):
            rows = order[np.searchsorted(of[order], i) : np.searchsorted(of[order], i + step)]
            now = u[i : i + step, None]
            before = self.sent(now - 1, every[None, :])
            own = self.sent(now, every[None, :]) - before
            table_ = before.sum(1, keepdims=True) + np.cumsum(own, 1) - own
            out[rows] = table_[of[rows] - i, queue[rows]]
        return out

    def pieces(self, place: np.ndarray, size: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents with these places in their queues and sizes: each piece's document, start in it, length, and place
        in the stream, cut at the ends of windows; and each document's last round."""
        first, last = self.turn(place, queue), self.turn(place + size - 1, queue)
        doc, k = spread(last - first + 1)
        turn, own = first[doc] + k, queue[doc]
        sent = self.sent(turn - 1, own)
        lo, hi = np.maximum(place[doc], sent), np.minimum((place + size)[doc], self.sent(turn, own))
        at = self.begins(turn, own) + lo - sent
        # What follows itself in the stream, as when one queue alone is left, is one piece.
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1])]) if len(doc) else np.zeros(0, bool)
        edge = np.flatnonzero(new)
        doc, lo, at = doc[edge], lo[edge], at[edge]
        hi = hi[np.append(edge[1:], len(new)) - 1] if len(edge) else hi
        which, k = spread((at + hi - lo - 1) // self.length - at // self.length + 1)
        start = np.maximum(at[which], (at[which] // self.length + k) * self.length)
        stop = np.minimum((at + hi - lo)[which], (start // self.length + 1) * self.length)
        return doc[which], (lo - place[doc])[which] + start - at[which], stop - start, start, last


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as it counts, and the places 0, 1, ... of these."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def queues_of(rows: DataFrame, length: int, mixture: dict[str | None, float] | float) -> tuple[Queues, DataFrame]:
    """The queues, and for each row (with source and doc_tokens) its queue."""
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit(""))
    sums = rows.groupBy(key(F.col("source")).alias("_s")).agg(F.sum("doc_tokens").alias("tokens"))
    if isinstance(mixture, dict):
        total = max(1.0, float(sum(mixture.values())))
        named = F.create_map(*(F.lit(x) for k, v in mixture.items() for x in ("" if k is None else f"s{k}", float(v) / total))) if mixture else F.create_map(F.lit(""), F.lit(0.0))
        sums = sums.withColumn("w", F.coalesce(named[F.col("_s")], F.lit(0.0)))
    else:
        total = sums.agg(F.sum(F.pow("tokens", F.lit(float(mixture))))).head()[0] or 1.0
        sums = sums.withColumn("w", F.pow("tokens", F.lit(float(mixture))) / F.lit(total))
    large = F.col("w") * length >= 1
    own = sorted((r["_s"], r["w"], r["tokens"]) for r in sums.where(large).select("_s", "w", "tokens").collect())  # at most `length`
    rest = sums.where(~large).agg(F.sum("w"), F.sum("tokens")).head()
    names = rows.sparkSession.createDataFrame([(s, i) for i, (s, *_) in enumerate(own)], "_s string, queue int")
    dealt = rows.withColumn("_s", key(F.col("source"))).join(F.broadcast(names), "_s", "left").withColumn("queue", F.coalesce("queue", F.lit(len(own)))).drop("_s")
    return Queues(length, [(w, t) for _, w, t in own], (rest[0] or 0.0, rest[1] or 0)), dealt


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, mixture: dict[str | None, float] | float = 1.0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, source, round (in which the
    document's last token is sent).

    mixture: target share of tokens by source (a source not named shares the last queue), or the power of a source's
    tokens that its share is in proportion to (1: as in the corpus)."""
    stages = Stages(docs.sparkSession, "pack")
    coded = stages.write(tokenize(docs, path))
    queues, rows = queues_of(coded.select("_id", "source", "doc_tokens"), length, mixture)
    rows = rows.select("_id", F.shiftright("_id", 33).alias("_file"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row"), "queue", "doc_tokens")
    rows = running_total(rows, ["queue"], "doc_tokens", "_before").select("_id", "queue", "_before")
    held = docs.sparkSession.sparkContext.broadcast(queues)  # length + 1 queues at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, queue, before = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
            edge = np.concatenate([[0], np.cumsum(n)])
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(edge, edge[i] + (1 << 20), "right")) - 1)
                doc, start, size, at, turn = held.value.pieces(before[i:j], n[i:j], queue[i:j])
                ids = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(2)[i:j]), "<u4")
                out = pa.array(doc + i)
                yield pa.record_batch([batch.column(0).take(out), pa.array(start), pa.array(size), binary(ids, np.concatenate([[0], np.cumsum(size)])), pa.array(n[i:j][doc]), pa.array(at // length), pa.array(at % length), batch.column(1).take(out), pa.array(turn[doc])], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source", "round"])
                i = j

    joined = coded.join(rows, "_id").select("doc_id", "source", "ids", "doc_tokens", "queue", "_before")
    return joined.mapInArrow(place, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string, round long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "round")


def op10_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), mixture=POWER))


QUERIES = {"op10_drr_packing": op10_drr_packing}
SQL: dict[str, str] = {}
