"""Language model, pieces, media, archives, shards, packing."""

import base64
import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import lm, media, packing, pieces, sharding, warc

# --- language model


def test_language_model_against_brute_force(spark, frame):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("The cat sat on a mat dog Ran".split()) for _ in range(rnd.randrange(12)))) for i in range(60)] + [(100, None), (101, "new words THE cat"), (101, "new words THE cat")]
    tokens = [(i, [w.encode().lower() for w in (t or "").encode().decode().split()] + [None]) for i, t in rows]
    train = [t for i, t in tokens if i < 50]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pair = collections.Counter(p for t in train for p in zip(["begin", *t], t, strict=False))
    cont, total, kinds = collections.Counter(w for _, w in pair), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (h, _), k in pair.items():
        total[h] += k
        kinds[h][min(k, 3) - 1] += 1

    def discount(values):
        m = collections.Counter(min(x, 5) for x in values)
        return lm.discounts(np.array([m[i] for i in range(1, 5)]))

    d2, d1 = discount(pair.values()), discount(cont.values())
    k1 = collections.Counter(min(x, 3) for x in cont.values())
    low = lambda w: max(cont[w] - d1[min(cont[w], 3)], 0) / len(pair) + sum(d1[i] * k1[i] for i in (1, 2, 3)) / len(pair) / (v + 1)

    def p(h, w):
        if not total[h]:
            return low(w)
        return max(pair[h, w] - d2[min(pair[h, w], 3)], 0) / total[h] + sum(d2[i + 1] * kinds[h][i] for i in range(3)) / total[h] * low(w)

    assert sum(p("begin", w) for w in c) + p("begin", "?") == pytest.approx(1)
    got = collections.defaultdict(list)
    for r in lm.score(frame(rows), F.col("doc_id") < 50).collect():
        got[r.doc_id].append(r)
    for i, t in tokens:
        r = got[i][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["begin", *t], t, strict=False)))
    assert len(got[101]) == 2


@pytest.mark.parametrize(("order", "shard_bytes"), [(2, lm.SHARD_BYTES), (3, lm.SHARD_BYTES), (4, lm.SHARD_BYTES), (2, 40), (3, 40), (4, 40), (5, 15)])
def test_language_model_of_higher_order(frame, order, shard_bytes):
    """Counts of each order by definition, and the recursion over them; in many shards, most words are hot, and so are
    pairs of words (a third of all words is one word)."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("the the the the cat sat on a mat dog ran".split()) for _ in range(rnd.randrange(14)))) for i in range(90)] + [(200, "new the cat sat"), (201, "cat the new sat")]
    tokens = {i: ["BEGIN", *t.split(), "END"] for i, t in rows}
    train = [t for i, t in tokens.items() if i < 70]
    counts = {order: collections.Counter(tuple(t[i : i + order]) for t in train for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        runs = {tuple(t[i : i + k + 1]) for t in train for i in range(len(t) - k)}
        counts[k] = collections.Counter(r[1:] for r in runs) + collections.Counter(tuple(t[:k]) for t in train if k > 1 and len(t) >= k)
    v = len({w for t in train for w in t[1:]})
    d = {k: lm.discounts(np.array([sum(min(x, 5) == i for x in c.values()) for i in range(1, 5)])) for k, c in counts.items()}

    def p(h, w):
        k = len(h) + 1
        seen = [n for r, n in counts[k].items() if r[:-1] == h]
        low = p(h[1:], w) if h else 1 / (v + 1)
        if not seen:
            return low
        n = counts[k][(*h, w)]
        return max(n - d[k][min(n, 3)], 0) / sum(seen) + sum(d[k][min(x, 3)] for x in seen) / sum(seen) * low

    got = {r.doc_id: r.score for r in lm.score(frame(rows), F.col("doc_id") < 70, order, shard_bytes).collect()}
    for i, t in tokens.items():
        assert got[i] == pytest.approx(sum(math.log10(p(tuple(t[max(0, j - order + 1) : j]), t[j])) for j in range(1, len(t))))


def test_hot_histories_are_dealt_out(spark, frame):
    """One word, and one pair, with a third of all runs each: no shard gets more than its share of them."""
    rnd = random.Random(1)
    rows = [(i, " ".join(f"{'the of' if rnd.random() < 0.6 else f'x{rnd.randrange(3000)}'} w{rnd.randrange(5000)}" for _ in range(60))) for i in range(300)]
    about = lm.count(frame(rows), shard_bytes=4000, order=3)
    routes = about["routes"]
    word = np.array([lm.words_of(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash[0] for w in (b"the", b"of")], np.uint64)
    assert routes.bits >= 4 and routes.is_hot(1, word).all() and routes.is_hot(2, lm.longer(word[1:], lm.first32(word[:1]))).all()
    model = lm.Model(about)
    assert model.own(word).tolist() == [sum(t.split().count(w) for _, t in rows) for w in ("the", "of")]
    sizes = [model.stored(f"run.3-{s}").n for s in range(1 << routes.bits)]
    assert max(sizes) < 3 * np.median(sizes)
    late = {w for _, t in rows for a, w in zip(t.split(), t.split()[1:], strict=False) if a == "of"}
    assert sum(model.stored(f"run.2-late-{s}").n for s in range(1 << routes.bits)) > len(late) * 0.99


def test_stored_counts(tmp_path):
    """Keys that share their leading bits, counts of one byte and larger ones, and keys that aren't there."""
    from loomgraph.llm.common import Folder

    rng = np.random.default_rng(4)
    key = np.unique(np.concatenate([rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 2**50, 3000, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]))
    count = rng.choice([1, 2, 254, 255, 256, 2**33], len(key))
    lm.store(Folder(str(tmp_path)), "x", key, count)
    got = lm.Stored(Folder(str(tmp_path)), "x")
    asked = np.concatenate([key, key + np.uint64(1), key - np.uint64(1), rng.integers(0, 2**64, 1000, np.uint64)])
    have = dict(zip(key.tolist(), count.tolist(), strict=True))
    assert got.get(asked).tolist() == [have.get(k, 0) for k in asked.tolist()]
    assert (got.lower(asked) == np.searchsorted(key, asked)).all()
    lm.store(Folder(str(tmp_path)), "none", key[:0], count[:0])
    assert lm.Stored(Folder(str(tmp_path)), "none").get(key[:3]).tolist() == [0, 0, 0]


def test_query_against_brute_force(spark, small, documents):
    """The query's own columns and split, from the texts alone."""
    words = {d["doc_id"]: [w for w in re.split(rb"[\x20\x09-\x0D]+", (d["text"] or "").encode().lower()) if w] for d in documents}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = collections.Counter(w for i, t in words.items() if not held[i] for w in [*t, None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.op4_kneser_ney(spark, small).collect()}
    assert set(got) == set(words) and 0 < sum(held.values()) < len(held)
    for i, t in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t) + 1, sum(c[w] > 0 for w in [*t, None]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, None]))
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    mean = lambda f: np.mean([f(r) for r in got.values() if r.held_out and r.n_tokens > 20])
    assert mean(lambda r: r.score / r.n_tokens) > mean(lambda r: r.base_score / r.n_tokens)


def test_query_tells_words_beyond_the_pair(frame):
    rows = [(i, "a b c" if i % 2 else "d b e") for i in range(40)] + [(100, "a b c"), (101, "a b e")]
    got = {r.doc_id: r.score for r in lm.score(frame(rows), F.col("doc_id") < 40, lm.ORDER).collect()}
    assert lm.ORDER >= 3 and got[100] > got[101] + 0.5


def test_language_model_of_nothing(frame):
    r = lm.score(frame([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in sorted(r)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert lm.score(frame([]), F.lit(True)).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.default_model())


def test_pieces_are_sentencepieces(model, documents):
    from sentencepiece import SentencePieceProcessor

    sp, rnd = SentencePieceProcessor(model_file=pieces.default_model()), random.Random(2)
    texts = [d["text"] or "" for d in documents] + ["", " ", "  a  b ", "\n\n x\ty", "你好 😀 ▁a▁", "<s> </s> <0x0A>", "a" * 300, "==== ----"] + ["".join(rnd.choice("abteinsor é\n") for _ in range(60)) for _ in range(200)]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == sp.encode(t)
        assert model.decode(ids) == sp.decode(sp.encode(t))


def test_viterbi_of_a_unigram_model(model):
    """The walk over shared prefixes against a search over all splits."""
    u = object.__new__(pieces.Pieces)
    u.kind, u.score = pieces.UNIGRAM, {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.1, "ba": -5.5, "aba": -6.0, "bab": -9.0}
    u.ids, u.longest, u.unknown_score = {k: i for i, k in enumerate(u.score)}, 3, -20.0

    def best(w):
        if not w:
            return 0.0
        return max(best(w[:i]) + u.score.get(w[i:], -20.0 if len(w) - i == 1 else -1e9) for i in range(len(w)))

    words = sorted({"▁" + "".join(random.Random(i).choice("abc") for _ in range(i % 9)) for i in range(60)})
    for word, split in u.walk(words):
        assert "".join(split) == word and sum(u.score.get(s, -20.0) for s in split) == pytest.approx(best(word))


def test_pieces_query(spark, small, documents, frame):
    out = {r.doc_id: r for r in pieces.op7_shared_prefix_pieces(spark, small).collect()}
    assert all(out[d["doc_id"]].text_crc32 == zlib.crc32((d["text"] or "").encode()) and out[d["doc_id"]].round_trip for d in documents)
    got = pieces.encode(frame([(1, None), (2, ""), (3, "a b"), (3, "a b")])).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in got) == [(1, 0, ""), (2, 0, ""), (3, 2, "a b"), (3, 2, "a b")]
    assert pieces.encode(frame([])).count() == 0
    text = ("some words " * 150_000).strip()
    long = pieces.encode(frame([(1, text), (None, "x")])).collect()
    assert {r.doc_id: r.decoded for r in long} == {1: text, None: "x"}


# --- media


@pytest.mark.parametrize("kind", sorted(media.WRITERS))
def test_formats_round_trip_and_are_found(kind):
    payload = media.pad(b"RIFF BM GIF8 \x89PNG\r\n\x1a\n P5\n" * 50)
    blob = media.WRITERS[kind](payload)
    sniffer = media.Sniffer()
    assert sniffer.sniff(blob, "image/gif") == (kind, [media.Found(kind, 0, len(blob))])
    assert media.read_samples(blob, kind) == payload
    carrier = b"BM RIFF junk " + blob + b" tail \xff\xd8\xff" + blob
    assert sniffer.find(carrier) == [media.Found(kind, 13, 13 + len(blob)), media.Found(kind, 23 + len(blob) - 1, 22 + 2 * len(blob))]
    assert sniffer.find(blob[:-5]) == []


def test_other_formats():
    sniffer = media.Sniffer()
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03x\x12\xff\x00\x34\xff\xd9"
    page = b"OggS\x00\x02" + bytes(20) + b"\x01\x03abc"
    for blob, kind in ((gif, "image/gif"), (jpeg, "image/jpeg"), (page * 2, "application/ogg")):
        assert sniffer.find(b"xx" + blob + b"yy") == [media.Found(kind, 2, 2 + len(blob))]
    assert sniffer.find(b"") == [] and sniffer.sniff(b"plain", None) == ("application/octet-stream", [])


def test_media_query(frame):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "é\x00BM"), (4, "é\x00BM"), (5, "long " * 100_000)]
    out = media.describe(media.to_media(frame(rows))).collect()
    for r, (i, t) in zip(sorted(out, key=lambda r: r.doc_id), rows, strict=True):
        p = media.pad((t or "").encode())
        assert len(p) % 576 == 0 and p
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert media.describe(media.to_media(frame([]))).count() == 0


def test_media_query_against_the_texts(spark, small, documents):
    """Every column of the query's result from the text alone."""
    got = {r.doc_id: r for r in media.op6_signature_media(spark, small).collect()}
    assert len(got) == len(documents)
    for d in documents:
        text = (d["text"] or "").encode()
        p = text + b"\xff" * (576 - len(text) % 576 if len(text) % 576 or not text else 0)
        kind, stored = media.store(p)
        x = list(p)
        mean = sum(x) * 1000 // len(x)
        var = (sum(v * v for v in x) * len(x) - sum(x) ** 2) * 1000 // len(x) ** 2
        cross = sum((a >= 128) != (b >= 128) for a, b in zip(x[1:], x[:-1], strict=True))
        r = got[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.media_bytes, r.media_sha256, r.declared) == (len(stored), hashlib.sha256(stored).hexdigest(), kind)
        assert r.feature == f"{r.carved} mean={mean} var={var} cross={cross} values={len(set(x))}"
        assert r.detected == (r.carved if r.at == 0 else "application/octet-stream") and stored[r.at :].startswith(media.FORMATS[r.carved][0])


def test_every_file_of_a_carrier_is_carved(spark):
    one, two, three = (media.WRITERS[k](media.pad(bytes([i]) * 700)) for i, k in enumerate(("image/png", "audio/wav", "image/bmp"), 1))
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    rows = [(1, 1, "image/png", b"head" + one + b"--" + two + three + gif + b"tail"), (2, 1, None, b"nothing"), (3, 1, None, None), (4, 1, "image/bmp", one + one)]
    out = {r.doc_id: r for r in media.describe(spark.createDataFrame(rows, "doc_id long, n_bytes long, declared string, media binary")).collect()}
    files = out[1].files
    assert [(f.kind, bytes(f.bytes)) for f in files] == [("image/png", one), ("audio/wav", two), ("image/bmp", three), ("image/gif", gif)]
    assert all(rows[0][3][f.start : f.end] == bytes(f.bytes) for f in files)
    assert [f.payload_sha256 for f in files[:3]] == [hashlib.sha256(media.pad(bytes([i]) * 700)).hexdigest() for i in (1, 2, 3)]
    assert (out[1].carved, out[1].at, out[1].detected) == ("image/png", 4, "application/octet-stream")
    assert out[2].files == out[3].files == [] and out[2].payload_sha256 is None and [bytes(f.bytes) for f in out[4].files] == [one, one]


# --- archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_is_parsed_by_version_and_length(version):
    body = b"<html>\n\nhttp://x 1 2 3 4 5\n</html>"
    arc = warc.page_arc("a.arc", version, [(7, "http://a/b", body), (8, "http://c", b"")])
    first, one, two = warc.parse_arc(arc)
    assert first.fields["URL"].startswith("filedesc://") and list(one.fields) == warc.FIELDS[version].split()
    assert warc.http_split(one.block)[1] == body and two.fields["URL"] == "http://c" and not two.truncated
    out = [dict(x.split(": ", 1) for x in raw.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for raw in warc.convert([first, one, two], "a.arc", {"8": ("7", "http://a/b")})]
    assert [x["WARC-Type"] for x in out] == ["warcinfo", "response", "revisit"]
    assert out[1]["WARC-Date"] == "2024-01-01T00:00:00Z" and out[1]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert out[2]["WARC-Refers-To"] == out[1]["WARC-Record-ID"]


def test_arc_oddities():
    old = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain 77\n1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n\n\n" + b"http://a/with space 1.2.3.4 19961104142103 text/html 5\nhello\ndns:a 1.2.3.4 19961104 text/dns 3\nabc\nhttp://b 1.2.3.4 19961104142103 text/html 50\nshort"
    _, a, d, b = warc.parse_arc(old)
    assert a.fields["URL"] == "http://a/with space" and a.block == b"hello" and b.truncated and b.block == b"short"
    kinds = [x.split(b"\r\n")[1:2] + [x.split(b"Content-Type: ")[1].split(b"\r\n")[0]] for x in warc.convert([a, d, b], "x")]
    assert kinds == [[b"WARC-Type: resource", b"text/html"], [b"WARC-Type: resource", b"text/dns"], [b"WARC-Type: resource", b"text/html"]]
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"no header"))


def test_pages_with_the_scheme_of_version_blocks(spark):
    rows = [(1, "filedesc://a.arc 0", "x"), (2, "filedesc://", "x"), (3, "dns:filedesc://a", "y")]
    out = warc.read_archives(warc.archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id, r.target_uri, r.record_type, r.refers_to) for r in out) == [(1, "filedesc://a.arc%200", "revisit", 2), (2, "filedesc://", "response", None), (3, "dns:filedesc://a", "response", None)]


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c d", ""), (5, "u", "x" * 100_000), (2, "http://b", "same")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, archive string")
    out = warc.read_archives(warc.archives(pages)).collect()
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in out)
    assert got == sorted([(1, 4, b32("same"), "revisit", 2), (2, 4, b32("same"), "response", 0), (2, 4, b32("same"), "response", 0), (3, 0, b32(""), "revisit", 4), (4, 0, b32(""), "response", 0), (5, 100_000, b32("x" * 100_000), "response", 0)])
    assert {r.record_type for r in warc.read_archives(warc.archives(pages, least=10)).collect()} == {"response"}
    assert warc.read_archives(warc.archives(pages.limit(0))).count() == 0


# --- shards


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**63, 50_000).astype(np.uint64)
    before = sharding.jump(keys, 1)
    assert (before == 0).all()
    for n in range(2, 40):
        now = sharding.jump(keys, n)
        moved = now != before
        assert (now[moved] == n - 1).all() and moved.mean() == pytest.approx(1 / n, abs=0.01)
        before = now


def test_shards_are_those_of_a_scalar_jump_hash(spark, small):
    """The published loop, one key at a time, over 64-bit integers."""
    whole = (1 << 64) - 1

    def mixed(x):
        x = (x + 0x9E3779B97F4A7C15) & whole
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
        return x ^ (x >> 31)

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) & whole
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    for r in sharding.op8_jump_sharding(spark, small).collect():
        assert (r.shard, r.grown_shard) == tuple(jump(mixed(r.doc_id & whole), n) for n in (24, 25))
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(i).randrange(-(2**62), 2**62) for i in range(500))]
    got = sharding.jump(sharding.mix(np.array(keys, np.int64).view(np.uint64)), 1000)
    assert got.tolist() == [jump(mixed(k & whole), 1000) for k in keys]


def test_shards(spark, frame, documents, small):
    for out, n in ((sharding.op8_jump_sharding(spark, small), len(documents)), (sharding.shard(frame([(1, None), (None, "a"), (None, "é"), (3, "x"), (3, "x")])), 5), (sharding.shard(frame([])), 0)):
        rows = out.collect()
        assert len(rows) == n and all(r.law == "key" and r.grown_shard in (r.shard, 24) for r in rows)
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = sorted((r.doc_id or 0, r.size, r.text_crc32) for r in sharding.shard(frame([(1, None), (None, "é")])).collect())
    assert got == [(0, 10, zlib.crc32("é".encode())), (1, 8, 0)]


def test_keys_of_other_types(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z"), (None, "w"), ("17", "v")], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.shard, r.grown_shard) for r in sharding.shard(rows).collect())
    assert got[2][1:] == got[3][1:] != got[4][1:] and all(0 <= s < 24 and g in (s, 24) for _, s, g in got)
    small = sharding.shard(rows.where("doc_id = '17'").selectExpr("cast(doc_id as int) as doc_id", "text")).head()
    long = sharding.shard(rows.where("doc_id = '17'").selectExpr("cast(doc_id as bigint) as doc_id", "text")).head()
    assert small.shard == long.shard


# --- packing


def check_pieces(rows, docs, length):
    """Pieces tile documents and sequences, and hold the tokenizer's ids."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_vocabulary())
    ids = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0 and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        copies = sum(k == i for k, _ in docs)
        assert sum(n for _, n in by_doc[i]) == copies * len(own)
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for offset, n in sorted(by_sequence[s]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes))) and all(n == length for n in sizes[:-1])


def test_packing_query(spark, small, documents):
    check_pieces(packing.op10_drr_packing(spark, small).collect(), [(d["doc_id"], d["text"]) for d in documents], 4096)


def test_packing_query_keeps_its_mixture(spark, small, documents):
    """Each window, while all sources last, holds the sources in proportion to the power of their tokens."""
    rows = packing.op10_drr_packing(spark, small).collect()
    tokens, got = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in rows:
        tokens[r.source] += r.length
        got[r.sequence_id][r.source] += r.length
    total = sum(v**packing.POWER for v in tokens.values())
    want = {s: 4096 * v**packing.POWER / total for s, v in tokens.items()}
    whole = int(min(tokens[s] / want[s] for s in want)) - 1
    assert whole >= 1 and all(abs(got[k][s] - want[s]) <= 2 + len(want) for k in range(whole) for s in want)


def test_packing_edge_cases(frame):
    rows = [(1, None, "a"), (2, "", None), (3, "word " * 3000, "a"), (4, "one two three", "b"), (4, "one two three", "b"), (5, "ΑΣ <|endoftext|> x y", "c"), (6, "<|EndOfText|> É", "c")]
    check_pieces(packing.digest(packing.pack(frame(rows), length=64)).collect(), [(r[0], r[1]) for r in rows], 64)
    assert packing.pack(frame([])).count() == 0


def test_rounds_are_those_of_a_round_robin(spark, frame):
    """The closed form against the queues themselves, with a mixture that isn't the corpus's."""
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randrange(1, 40), f"s{rnd.choice([0, 0, 0, 1, 2])}") for i in range(150)]
    got = {r.doc_id: r["round"] for r in packing.pack(frame(rows).coalesce(1), length=100, mixture={"s0": 0.2, "s1": 0.5, "s2": 0.3}).collect()}
    want = {}
    for source, share in (("s0", 0.2), ("s1", 0.5), ("s2", 0.3)):
        queue = [(i, len(t.split()) + 1) for i, t, s in rows if s == source]
        credit, turn = 0.0, 0
        while queue:
            turn += 1
            credit += share * 100
            while queue and queue[0][1] <= credit + 1e-9:
                i, n = queue.pop(0)
                credit -= n
                want[i] = turn
    assert got == want


def test_windows_hold_each_source_in_proportion(frame):
    """Target shares in every window while all sources last, one document of many windows among them."""
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(1, 60), f"s{i % 3}") for i in range(600)] + [(1000, "w " * 12_000, "s1")]
    left = collections.Counter()
    for _, t, s in rows:
        left[s] += len(t.split()) + 1
    share = {"s0": 0.255, "s1": 0.5, "s2": 0.245}
    out = packing.pack(frame(rows), length=200, mixture=share).collect()
    got = collections.defaultdict(collections.Counter)
    for r in out:
        got[r.sequence_id][r.source] += r.length
    whole = int(min(left[s] / (200 * share[s]) for s in share))
    assert whole > 40
    for k in range(whole):
        assert all(abs(got[k][s] - 200 * share[s]) <= 2 for s in share)
    check_pieces(packing.digest(packing.pack(frame(rows), length=200, mixture=share)).collect(), [(i, t) for i, t, _ in rows], 200)
    corpus = collections.defaultdict(collections.Counter)
    for r in packing.pack(frame(rows), length=200).collect():
        corpus[r.sequence_id][r.source] += r.length
    total = sum(left.values())
    for k in range(len(corpus) - 1):
        assert all(abs(corpus[k][s] - 200 * left[s] / total) <= 3 for s in share)


def test_queues_against_the_round_robin_itself():
    """Every token's place in the stream, with more sources than tokens in a window and queues of very unlike sizes."""
    rnd = random.Random(8)
    for length in (8, 64):
        sizes = [rnd.choice([1, 5, 40, 700]) for _ in range(6)]
        share = [rnd.random() for _ in sizes]
        share = [x / sum(share) for x in share]
        queues = packing.Queues(length, list(zip(share, sizes, strict=True))[:-1], (share[-1], sizes[-1]))
        stream, sent, turn = [], [0] * len(sizes), 0
        while sent != sizes:
            turn += 1
            for s in range(len(sizes)):
                upto = min(sizes[s], int(turn * queues.quantum[s]) // (1 << packing.PLACES))
                stream += [(s, k, turn) for k in range(sent[s], upto)]
                sent[s] = upto
        docs = [(s, a, min(17, sizes[s] - a)) for s in range(len(sizes)) for a in range(0, sizes[s], 17)]
        queue, place, size = (np.array(x, np.int64) for x in zip(*docs, strict=True))
        doc, start, n, at, last = queues.pieces(place, size, queue)
        got = {}
        for d, a, k, p in zip(doc, start, n, at, strict=True):
            assert p // length == (p + k - 1) // length
            got |= {int(p) + i: (docs[d][0], docs[d][1] + int(a) + i) for i in range(int(k))}
        assert [got[i] for i in range(len(stream))] == [(s, k) for s, k, _ in stream] and len(got) == len(stream)
        assert [int(x) for x in last] == [next(t for s, k, t in stream if (s, k) == (q, a + b - 1)) for q, a, b in docs]


def test_sources_without_a_queue_of_their_own(frame):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randrange(0, 30), None if i % 50 == 0 else f"s{i % 40}" if i % 2 else "big") for i in range(300)]
    for mixture in (1.0, 0.0, 0.7, {"big": 0.5, None: 0.4}):
        got = packing.pack(frame(rows), length=32, mixture=mixture)
        check_pieces(packing.digest(got).collect(), [(i, t) for i, t, _ in rows], 32)


# --- pipeline


def test_pipeline(spark, small, documents):
    import corpus_pipeline
    from loomgraph.llm import minhash, quality, toxicity
    from tests.llm.test_minhash import brute

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-duplicates", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    one = corpus_pipeline.STAGES[0][1](spark, docs, small)
    want = {r.doc_id for r in toxicity.score(docs, labels.where(toxicity.remainder(3) != 1)).collect() if not r.predicted}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want
    two = corpus_pipeline.STAGES[1][1](spark, docs, small)
    want = {r.doc_id for r in quality.score(docs, labels.where(toxicity.remainder(4) != 2)).collect() if r.predicted}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == want
    three = corpus_pipeline.STAGES[2][1](spark, docs, small)
    classes = brute([(d["doc_id"], d["text"]) for d in documents])
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == set(classes.values())
    assert minhash.THRESHOLD == 0.8
    rows = corpus_pipeline.run(spark, small).collect()
    kept = {r.doc_id for r in rows}
    check_pieces(rows, [(d["doc_id"], d["text"]) for d in documents if d["doc_id"] in kept], 4096)


def test_pipeline_edge_cases(spark, small, documents, tmp_path):
    """Nulls in any column, an empty and a very long text, repeated rows, clashing names; then no documents at all."""
    import corpus_pipeline

    own = [(d["doc_id"], d["text"], d["source"]) for d in documents[:120]]
    own += [(900_001, None, "s"), (900_002, "", None), (None, "no id but a text of some good words", "s"), (own[0][0], own[0][1], "s"), (900_003, "one quiet word after another " * 30_000, None), (900_004, own[1][1], "s")]
    names = "doc_id long, text string, lang string, source string, n_chars long, _id long, queue int, y int, node string, digest string, _file string"
    rows = [(i, t, None, s, None, 1, 2, 3, "n", "d", "f") for i, t, s in own]
    for name, data in (("some", rows), ("none", [])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "labels.parquet").symlink_to(f"{small}/labels.parquet")
        spark.createDataFrame(data, names).write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, str(folder))
            assert kept.columns == docs.columns and kept.exceptAll(before).count() == 0
        ids = [r.doc_id for r in kept.collect()]
        assert len({i for i in ids if i is not None}) == len([i for i in ids if i is not None])
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in out} == set(ids)
        if data:
            texts = dict((i, t) for i, t, _ in own)
            check_pieces(out, [(i, texts[i]) for i in ids], 4096)
            assert not {own[1][0], 900_004} <= set(ids)
        else:
            assert out == []
