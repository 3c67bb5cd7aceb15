"""SentencePiece encoding and decoding over sorted distinct words, reusing forward states along shared prefixes.

White space is marked and stays with the word that follows, and no piece runs over a word's start; so a text's pieces
are those of its words in turn.  A batch's distinct marked words are sorted and walked depth-first, as in a trie: the
forward states of the prefix that a word shares with the one before are kept, only the rest is computed.

For a unigram model a prefix's state is its best score and last piece (Viterbi).  A model of merged pairs has no sum
that its encoding maximises, so the largest sum of scores gives other pieces than SentencePiece does; there a state is
the last piece of the prefix's own encoding: that piece is the one whose pair with the last piece of what stands before
it stays apart when the two are merged alone.  Both kinds share the walk.  Characters that no piece covers become
bytes.

Null is empty and has no pieces; repeated rows are encoded each; a very long text is walked as its distinct words like
any other; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .text import slices

MARK = "▁"
#: Distinct words that a worker keeps in each of two generations.
MEMO = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer."""
    import struct

    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + n])[0]
            at += n


class Pieces:
    """A model's pieces, and the walk that encodes words by them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            raw = f.read()
        self.processor = SentencePieceProcessor(model_proto=raw)  # its normaliser
        self.kind, self.names, self.scores, self.types = UNIGRAM, [], [], []
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(piece.get(2, 0.0))
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram models and models of merged pairs have pieces of this kind")
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        self.ids = {self.names[i]: i for i in usable}
        self.score = {self.names[i]: self.scores[i] for i in usable}
        self.longest = max((len(n) for n in self.ids), default=1)
        self.bytes = {int(n[3:5], 16): i for i, (n, t) in enumerate(zip(self.names, self.types, strict=True)) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        self.unknown_score = min(self.scores[i] for i in usable) - 10 if usable else -10.0
        inner = [n for n in self.ids if MARK in n.lstrip(MARK)]
        if inner:
            raise ValueError("a piece runs over a word's start")
        self.single = "".join(sorted({"\n", "\t"} - set("".join(self.ids))))  # characters that always stand alone
        alone = re.escape(self.single) if self.single else ""
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[{alone}]|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.apart: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.text = [bytes([int(n[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else n.replace(MARK, " ").encode() for n, t in zip(self.names, self.types, strict=True)]

    # -- merged pairs

    def merged(self, symbols: list[str]) -> list[str]:
        """The adjacent pair that makes the best piece is merged, leftmost of equals, until none does."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def stays_apart(self, a: str, b: str) -> bool:
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            got = self.apart[a, b] = self.merged(list(a + b)) == [a, b]
        return got

    # -- the walk

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each of the words (sorted, distinct) with its pieces."""
        states: list[tuple] = [(0.0, 0, "")]  # for each prefix: score, where its last piece starts, that piece
        before, ids, score, longest, pairs = "", self.ids, self.score, self.longest, self.kind == BPE
        for word in words:
            n = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                n += 1
            del states[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                best = None
                for s in range(max(0, i - longest), i):
                    piece = word[s:i]
                    if piece not in ids and s != i - 1:
                        continue
                    past = states[s]
                    if pairs:
                        if (s == 0 or self.stays_apart(past[2], piece)) and (s > 0 or i == 1 or self.merged(list(piece)) == [piece]):
                            best = (0.0, s, piece)
                            break
                    else:
                        total = past[0] + score.get(piece, self.unknown_score)
                        if best is None or total > best[0]:
                            best = (total, s, piece)
                states.append(best)
            before = word
            out, i = [], len(word)
            while i:
                out.append(states[i][2])
                i = states[i][1]
            yield word, out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit bytes."""
        split = [self.words.findall(n) for n in self.processor.normalize(texts)] if texts else []
        known, old = self.known, self.old
        missing = {w for ws in split for w in ws if w not in known}
        for w in [w for w in missing if w in old]:
            known[w] = old[w]
            missing.discard(w)
        for word, pieces in self.walk(sorted(missing)):
            known[word] = array("I", self.ids_of(pieces)).tobytes()
        out = [b"".join([known[w] for w in ws]) for ws in split]
        if len(known) > MEMO:
            self.old, self.known = known, {}
        return out

    def decode(self, ids: bytes) -> str:
        """The text; a leading space is the mark that encoding puts before the first word."""
        table_ = self.text
        text = b"".join([table_[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, path: str | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary), n_tokens, decoded for every row."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for part, _, _ in slices(batches):
            ids = model.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([model.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_crc32, text_crc32, round_trip: what op7 returns, without sending texts back."""
    path = path or default_model()
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "text_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for part, _, _ in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids = model.encode(texts)
            back = [model.decode(x) for x in ids]
            crc = lambda xs: pa.array([zlib.crc32(x) for x in xs], pa.int64())
            yield pa.record_batch([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), crc(ids), crc(b.encode() for b in back), crc(t.encode() for t in texts), pa.array([a == b for a, b in zip(texts, back, strict=True)])], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, text_crc32 long, round_trip boolean")


def op7_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_shared_prefix_pieces": op7_shared_prefix_pieces}
SQL: dict[str, str] = {}
