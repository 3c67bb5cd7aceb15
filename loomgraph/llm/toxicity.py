"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs, trained in
numpy; a text's score comes from its most toxic window, and windows overlap and cover the whole text.

Word inputs are a class log-odds (document frequencies over all labelled training rows) and a hashed vector; character
inputs are the log-odds of the word's first bytes (stems, so that unseen forms are known) and the mean of hashed
trigram vectors.  White space alone parts words; what it leaves longer than LONG bytes is taken apart by parts_of().
Labels never meet texts in a join: they are written as sorted ids with their labels to the shared folder, and tasks that
read texts look their rows' ids up there, so texts aren't shuffled at any size.

The network itself is fitted on at most FIT_DOCS labelled ids of each class, of which a quarter is kept for calibration;
what a text itself adds to the frequencies is taken off both while it is learned from and while it calibrates.  Of rows
with one id the one with the least hash of its text is used for fitting.  Null and empty texts get the score of a window
without words; repeated rows get equal scores; very long texts are scored window by window; of windows with equal heat
the first ones are learned from; without labels of both classes every score is the training share (0.5 without any); an
empty table gives no rows; other columns are not read."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PACKED, Folder, add_up, packed, shared_dir, table
from .text import LOWER, SEGMENT, Words, hash_of, mix, slices, words_of

WINDOW, STRIDE = 32, 16
HIDDEN, DIM, ROWS, ATTEND = 8, 6, 4096, 8
#: Rows of the table of document frequencies by hashed word or stem; bytes of the stems.
FREQ = 1 << 19
STEMS = (4, 6, 8)
#: Bytes that a word has at most before it is taken apart.
LONG = 64
ODDS = 1 + len(STEMS)
#: Labelled ids of each class that the network is fitted on at most (chosen by a hash of the ids).
FIT_DOCS = 2000
#: Bytes of text that a task looks at together.
SLICE = 2 << 20
#: Labels in one shared file, on average.
LABELS = 1 << 20
#: Windows that one training text gives: those of highest log-odds, and others by chance.
TOP, OTHERS = 2, 2
THRESHOLD = 0.7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


# --- the network


def new_params(rng: np.random.Generator) -> dict[str, np.ndarray]:
    inputs = ODDS + 2 * DIM
    p = {"word": rng.normal(0, 0.1, (ROWS, DIM)), "char": rng.normal(0, 0.1, (ROWS, DIM)), "att_w": rng.normal(0, 0.4, (2 * HIDDEN, ATTEND)), "att_v": rng.normal(0, 0.4, ATTEND), "out_w": rng.normal(0, 0.4, 2 * HIDDEN), "out_b": np.zeros(1)}
    for d in "fb":
        p |= {f"w_{d}": rng.normal(0, 0.4, (inputs, 3 * HIDDEN)), f"u_{d}": rng.normal(0, 0.4, (HIDDEN, 3 * HIDDEN)), f"c_{d}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def states(p, d: str, steps: Iterator[tuple[np.ndarray, np.ndarray]], keep: list | None = None) -> list[np.ndarray]:
    """Hidden states along the steps; each step: projected inputs (n, 3H) and mask (n, 1)."""
    out, h, u = [], None, p[f"u_{d}"]
    for a, m in steps:
        h = np.zeros((len(a), HIDDEN), np.float32) if h is None else h
        b = h @ u
        g = sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if keep is not None:
            keep.append((h, z, r, n, b[:, 2 * HIDDEN :], m))
        h = h + m * (new - h)
        out.append(h)
    return out


def attend(p, h: np.ndarray, mask: np.ndarray):
    """h: (n, T, 2H).  Logit of each window, and what the gradient needs."""
    t = np.tanh(h @ p["att_w"])
    e = np.where(mask, t @ p["att_v"], np.float32(-30))
    e = np.exp(e - e.max(1, keepdims=True))
    alpha = e / e.sum(1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", alpha, h)
    return pooled @ p["out_w"] + p["out_b"], t, alpha, pooled


def forward(p, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """x: (n, T, inputs)."""
    steps, hs = x.shape[1], []
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        saved: list = []
        a = x @ p[f"w_{d}"] + p[f"c_{d}"]
        got = states(p, d, ((a[:, t], mask[:, t, None].astype(np.float32)) for t in order), saved if keep is not None else None)
        hs.append(np.stack(got if d == "f" else got[::-1], 1))
        if keep is not None:
            keep[d] = saved
    h = np.concatenate(hs, 2)
    logit, t, alpha, pooled = attend(p, h, mask)
    if keep is not None:
        keep |= {"h": h, "t": t, "alpha": alpha, "pooled": pooled}
    return logit


def backward(p, x: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters, and of x."""
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
    h, t, alpha, pooled = (keep[k] for k in ("h", "t", "alpha", "pooled"))
    g["out_w"], g["out_b"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
    dpooled = dlogit[:, None] * p["out_w"]
    dh = alpha[:, :, None] * dpooled[:, None]
    dalpha = np.einsum("nth,nh->nt", h, dpooled)
    de = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
    g["att_v"] = np.einsum("nt,nta->a", de, t)
    dt = de[:, :, None] * p["att_v"] * (1 - t * t)
    g["att_w"] = np.einsum("nth,nta->ha", h, dt)
    dh = dh + dt @ p["att_w"].T
    dx, steps = np.zeros_like(x), x.shape[1]
    for k, d in enumerate("fb"):
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        u, carry = p[f"u_{d}"], np.zeros((len(x), HIDDEN), np.float32)
        for s, t_ in zip(reversed(keep[d]), reversed(list(order)), strict=True):
            h0, z, r, n, bn, m = s
            total = carry + dh[:, t_, k * HIDDEN : (k + 1) * HIDDEN]
            dnew = total * m
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (h0 - n) * z * (1 - z)
            dr = dn * bn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            db = np.concatenate([dz, dr, dn * r], 1)
            g[f"u_{d}"] += h0.T @ db
            g[f"w_{d}"] += x[:, t_].T @ da
            g[f"c_{d}"] += da.sum(0)
            dx[:, t_] += da @ p[f"w_{d}"].T
            carry = total * (1 - m) + dnew * z + db @ u.T
    return g, dx


# --- inputs


def parts_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of texts, those of more than LONG bytes as overlapping parts, so that nothing depends on where a text
    without white space happens to be cut.

    Such a word falls into runs of ASCII signs and Unicode spaces, of letters of up to two bytes, and of characters of
    three and more (scripts without spaces among them).  In the last, each character and the next are a part; other
    runs over LONG bytes give a part of that size every LONG / 2 bytes."""
    w = words_of(data, bounds)
    size = w.end - w.start
    if not len(size) or size.max() <= LONG:
        return w
    starts, ends, of = [], [], []
    long = np.flatnonzero(size > LONG)
    for i in long.tolist():
        a, b = int(w.start[i]), int(w.end[i])
        while a < b:  # a stretch at a time; the next one begins with the character that this one ends with
            stop = b if b - a <= SEGMENT else a + SEGMENT - int(np.argmax((data[a + SEGMENT - 4 : a + SEGMENT + 1] & 0xC0)[::-1] != 0x80))
            s, e, last = _parts(data[a:stop])
            starts.append(s + a), ends.append(e + a), of.append(np.full(len(s), i))
            a = b if stop == b else max(a + last, a + 1)
    keep = np.flatnonzero(size <= LONG)
    start, end = np.concatenate([w.start[keep], *starts]), np.concatenate([w.end[keep], *ends])
    of = np.concatenate([keep, *of])
    order = np.argsort(of, kind="stable")
    start, end, of = start[order], end[order], of[order]
    hashes = np.empty(len(of), np.uint64)
    cut = size[of] > LONG
    hashes[~cut], hashes[cut] = w.hash[of[~cut]], hash_of(data, start[cut], end[cut])
    return Words(data, start, end, hashes, np.searchsorted(of, w.first))


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and ends of the parts of one word, and where its last run's last part starts."""
    at = np.flatnonzero((x & 0xC0) != 0x80)  # where characters begin
    at = at if len(at) and at[0] == 0 else np.concatenate([[0], at])
    edge = np.append(at, len(x))
    lead, nth = x[at], lambda k: x[np.minimum(at + k, len(x) - 1)]
    kind = np.where(lead >= 0xE0, 2, 1)
    letter = ((lead | 32) >= 97) & ((lead | 32) <= 122) | (lead >= 48) & (lead <= 57)
    two, three = nth(1), nth(2)
    space = (lead == 0xC2) & ((two == 0xA0) | (two == 0x85)) | (lead == 0xE3) & (two == 0x80) & (three == 0x80) | (lead == 0xE1) & (two == 0x9A) & (three == 0x80)
    space |= (lead == 0xE2) & ((two == 0x80) & ((three <= 0x8B) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
    kind[space | (lead < 128) & ~letter] = 0
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    stop = np.append(first[1:], len(at))
    # Of wide characters: each with the next; a single one alone.
    wide = np.flatnonzero(kind == 2)
    run_stop = np.repeat(stop, stop - first)
    alone = np.repeat(stop - first == 1, stop - first)
    wide = wide[(wide + 1 < run_stop[wide]) | alone[wide]]
    s, e = [at[wide]], [edge[np.minimum(wide + 2, run_stop[wide])]]
    # Of other runs: stretches of LONG bytes that overlap by half, cut where characters begin.
    first, stop = first[kind[first] < 2], stop[kind[first] < 2]
    lo, hi = edge[first], edge[stop]
    count = np.maximum(1, -(-(hi - lo - LONG // 2) // (LONG // 2)))
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lo, hi = np.repeat(lo, count) + k * (LONG // 2), np.repeat(hi, count)
    begins = lambda v: edge[np.searchsorted(edge, v, "right") - 1]
    s.append(begins(lo)), e.append(begins(np.minimum(lo + LONG, hi)))
    start, end = np.concatenate(s), np.concatenate(e)
    order = np.lexsort((end, start))
    return start[order], end[order], int(start.max())


def entries(w, at: np.ndarray) -> np.ndarray:
    """(words, ODDS) places in the table of frequencies: of the words at the given places, and of their stems (the
    whole word where it is shorter)."""
    out = np.empty((len(at), ODDS), np.int64)
    out[:, 0] = (w.hash[at] & np.uint64(FREQ - 1)).astype(np.int64)
    start, size = w.start[at], w.end[at] - w.start[at]
    packed = np.zeros(len(at), np.uint64)
    for k in range(max(STEMS)):
        b = LOWER[w.data[np.minimum(start + k, max(0, len(w.data) - 1))]].astype(np.uint64) if len(w.data) else np.zeros(len(at), np.uint64)
        packed |= np.where(k < size, b, np.uint64(0)) << np.uint64(8 * k)
        if k + 1 in STEMS:
            i = STEMS.index(k + 1)
            out[:, 1 + i] = (mix(packed ^ mix(np.array([i + 1], np.uint64))) & np.uint64(FREQ - 1)).astype(np.int64)
    return out


class Vocabulary:
    """The distinct words of some texts, and the places of their character trigrams."""

    def __init__(self, words, odds: np.ndarray):
        uniq, first, self.of = np.unique(words.hash, return_index=True, return_inverse=True)
        self.row = (mix(uniq) & np.uint64(ROWS - 1)).astype(np.int64)
        self.odds = odds[entries(words, first)]
        start, size = words.start[first], words.end[first] - words.start[first]
        self.size = size + 1  # with a mark at each end: as many trigrams as bytes, and one
        self.offset = np.cumsum(self.size) - self.size
        inner = np.arange(self.size.sum()) - np.repeat(self.offset, self.size)
        at, n = np.repeat(start, self.size) + inner, np.repeat(size, self.size)
        data = words.data if len(words.data) else np.zeros(1, np.uint8)
        take = lambda k: np.where((inner + k >= 0) & (inner + k < n), data[np.clip(at + k, 0, len(data) - 1)], 0).astype(np.uint64)
        a, b, c = take(-1), take(0), take(1)
        a, b, c = (np.where((v >= 65) & (v <= 90), v + np.uint64(32), v) for v in (a, b, c))
        self.tri = (mix((a << np.uint64(16)) | (b << np.uint64(8)) | c) & np.uint64(ROWS - 1)).astype(np.int64)

    def inputs(self, p) -> np.ndarray:
        if not len(self.row):
            return np.zeros((0, ODDS + 2 * DIM), np.float32)
        chars = np.add.reduceat(p["char"][self.tri], self.offset, axis=0) / self.size[:, None]
        return np.concatenate([self.odds, p["word"][self.row], chars], 1).astype(np.float32)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each window, and its text; every text has one at least, and its windows cover all its words."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - STRIDE) // STRIDE)).astype(np.int64)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][text] + k * STRIDE
    return start, np.minimum(WINDOW, first[1:][text] - start), text


def place(start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's words as places in the vocabulary, and the mask."""
    t = np.arange(WINDOW)
    mask = t < size[:, None]
    if not len(of):
        return np.zeros((len(start), WINDOW), np.int64), mask
    return of[np.minimum(start[:, None] + t, len(of) - 1)], mask


def max_logits(p, words, odds: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """Highest logit of each text's windows."""
    vocabulary = Vocabulary(words, odds)
    x = vocabulary.inputs(p)
    a = {d: x @ p[f"w_{d}"] + p[f"c_{d}"] if len(x) else np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}
    start, size, text = windows(words.first)
    out = np.empty(len(start), np.float32)
    for i in range(0, len(start), chunk):
        at, mask = place(start[i : i + chunk], size[i : i + chunk], vocabulary.of)
        longest = max(1, int(size[i : i + chunk].max()))
        m = mask.astype(np.float32)
        h = np.empty((len(at), longest, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            order = range(longest) if d == "f" else range(longest - 1, -1, -1)
            for t, got in zip(order, states(p, d, ((a[d][at[:, t]], m[:, t, None]) for t in order)), strict=True):
                h[:, t, k * HIDDEN : (k + 1) * HIDDEN] = got
        out[i : i + chunk] = attend(p, h, mask[:, :longest])[0]
    return np.maximum.reduceat(out, np.searchsorted(text, np.arange(len(words.first) - 1)))


# --- fitting


def log_odds(counts: np.ndarray, n: np.ndarray, strength: float = 3.0) -> np.ndarray:
    """counts: (2, FREQ) texts of each class with the word; n: texts of each class.  Scaled to about one."""
    share = n / n.sum()
    up, down = counts[1] + strength * share[1], counts[0] + strength * share[0]
    return (np.clip(np.log(up / down) - np.log(share[1] / share[0]), -4, 6) / 3).astype(np.float32)


class Labels:
    """Labels by id, from sorted arrays in the shared folder: published once, mapped by every worker."""

    def __init__(self, about: dict):
        self.bits, self.folder, self.maps = about["bits"], Folder(about["folder"]), {}

    @staticmethod
    def shard(ids: np.ndarray, bits: int) -> np.ndarray:
        return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)

    @staticmethod
    def publish(labels: DataFrame) -> dict:
        """labels: distinct doc_id (long, not null) and y.  Ids and labels alone are shuffled."""
        about = {"bits": max(0, int(np.ceil(np.log2(max(1, labels.count()) / LABELS)))), "folder": f"{shared_dir(labels.sparkSession)}/labels-{uuid.uuid4().hex}"}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([*batch.columns, pa.array(Labels.shard(batch.column(0).to_numpy(), about["bits"]).astype(np.int32))], names=["doc_id", "y", "shard"])

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list] = {}  # rows come by shard
            n = 0

            def flush() -> None:
                for shard, own in parts.items():
                    ids, y = (np.concatenate(x) for x in zip(*own, strict=True))
                    Folder(about["folder"]).write(f"id-{shard}", ids.astype("<i8")), Folder(about["folder"]).write(f"y-{shard}", y.astype("<i1"))
                parts.clear()

            for batch in batches:
                shard = batch.column(2).to_numpy()
                edge = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if int(shard[a]) not in parts:
                        flush()
                    parts.setdefault(int(shard[a]), []).append((batch.column(0).to_numpy()[a:b], batch.column(1).to_numpy()[a:b]))
                n += batch.num_rows
            flush()
            yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

        dealt = labels.select("doc_id", "y").mapInArrow(deal, "doc_id long, y int, shard int").repartition(1 << about["bits"], "shard").sortWithinPartitions("shard", "doc_id")
        dealt.mapInArrow(write, "n long").agg(F.sum("n")).head()
        return about

    def of(self, ids: pa.Array) -> np.ndarray:
        """The label of each id; -1 for those without."""
        out = np.full(len(ids), -1, np.int8)
        here = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[here]
        shard = Labels.shard(keys, self.bits)
        for s in np.unique(shard).tolist():
            if s not in self.maps:
                self.maps[s] = self.folder.map(f"id-{s}", "<i8"), self.folder.map(f"y-{s}", "<i1")
            have, y = self.maps[s]
            own = shard == s
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
                out[here[own]] = np.where(have[at] == keys[own], y[at], -1)
        return out


def frequencies(docs: DataFrame, about: dict) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each class by hashed word, over all labelled rows of docs (doc_id, text): each task sends a table of
    fixed size at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, labels = np.zeros(2 * FREQ, np.int64), np.zeros(2, np.int64), Labels(about)
        for part, data, bounds in slices((own for own, _ in labelled(batches, labels)), size=SLICE):
            y = part.column(2).to_numpy().astype(np.int64)
            w = parts_of(data, bounds)
            doc = np.repeat(np.arange(len(y)), np.diff(w.first))
            _, one = np.unique(doc * FREQ + (w.hash & np.uint64(FREQ - 1)).astype(np.int64), return_index=True)
            key = np.unique((doc[one, None] * FREQ + entries(w, one)).ravel())
            counts += np.bincount(y[key // FREQ] * FREQ + key % FREQ, minlength=2 * FREQ)
            n += np.bincount(y, minlength=2)
        yield packed(np.concatenate([counts, n]))

    sums = add_up(docs.select("doc_id", "text").mapInArrow(run, PACKED), 2 * FREQ + 2)
    return sums[:-2].reshape(2, FREQ), sums[-2:]


def labelled(batches: Iterator[pa.RecordBatch], labels: Labels) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The labelled rows of doc_id and text, with y as a third column."""
    for batch in batches:
        y = labels.of(batch.column(0))
        own = y >= 0
        if own.any():
            yield pa.record_batch([*batch.filter(pa.array(own)).columns, pa.array(y[own])], names=["doc_id", "text", "y"]), y[own]


def leave_out(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds for a text of each class, without what that text itself adds."""
    return np.stack([log_odds(np.maximum(counts - np.array([[c == 0], [c == 1]]), 0), n) for c in (0, 1)])


def calibrates(doc_id: int) -> bool:
    return int(mix(np.array([doc_id], np.int64).view(np.uint64) ^ np.uint64(0xCA11B))[0]) % 4 == 0


def lessons(doc_id: int, text: str, y: int, odds: np.ndarray) -> list[tuple]:
    """The windows that a text gives to the fit, each as words of its own: starts, ends, hashes and bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = parts_of(data, np.array([0, len(data)]))
    start, size, _ = windows(w.first)
    heat = odds[entries(w, np.arange(len(w.hash)))].max(1)
    hot = np.argsort([-(heat[a : a + n].max() if n else 0) for a, n in zip(start, size, strict=True)], kind="stable")
    rng = np.random.default_rng(doc_id & 0xFFFFFFFFFFFF)
    out = []
    for k in list(hot[:TOP]) + (list(rng.choice(hot[TOP:], min(OTHERS, len(hot) - TOP), replace=False)) if not y and len(hot) > TOP else []):
        a, b = start[k], start[k] + size[k]
        lo, hi = (int(w.start[a]), int(w.end[a:b].max())) if size[k] else (0, 0)
        out.append((w.start[a:b] - lo, w.end[a:b] - lo, w.hash[a:b], data[lo:hi].tobytes()))
    return out


def fit(picked: list[tuple], target: np.ndarray, counts: np.ndarray, n: np.ndarray, seed: int = 7, epochs: int = 5, batch: int = 128) -> dict[str, np.ndarray]:
    """The network's parameters; picked: windows by lessons(), target: their texts' labels."""
    rng = np.random.default_rng(seed)
    p = new_params(rng)
    odds, without = log_odds(counts, n), leave_out(counts, n)
    target = target.astype(np.float32)
    size = np.array([len(x[3]) for x in picked], np.int64)
    base = np.cumsum(size) - size
    cat = [np.concatenate(x) if x else np.empty(0, t) for x, t in (([s + a for (s, _, _, _), a in zip(picked, base, strict=True)], np.int64), ([e + a for (_, e, _, _), a in zip(picked, base, strict=True)], np.int64), ([x[2] for x in picked], np.uint64))]
    words = Words(np.frombuffer(b"".join(x[3] for x in picked), np.uint8), *cat, np.concatenate([[0], np.cumsum([len(x[0]) for x in picked])]).astype(np.int64))
    vocabulary = Vocabulary(words, odds)
    at, mask = place(words.first[:-1], np.diff(words.first), vocabulary.of)
    own_odds = without[np.repeat(target.astype(np.int64), np.diff(words.first))[:, None], entries(words, np.arange(len(words.hash)))]
    spot = np.minimum(words.first[:-1, None] + np.arange(WINDOW), max(0, len(words.hash) - 1))
    pick = np.arange(len(target))
    epochs = max(epochs, min(40, 600 * batch // max(1, len(pick))))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    weight = (np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum())) * len(pick)).astype(np.float32)
    step = 0
    for _ in range(epochs if len(words.hash) else 0):
        rng.shuffle(pick)
        for i in range(0, len(pick), batch):
            own = pick[i : i + batch]
            used, inverse = np.unique(at[own], return_inverse=True)
            x_words = vocabulary_inputs(vocabulary, p, used)
            x = x_words[inverse.reshape(len(own), WINDOW)]
            x[:, :, :ODDS] = own_odds[spot[own]]
            keep: dict = {}
            logit = forward(p, x, mask[own], keep)
            g, dx = backward(p, x, keep, ((sigmoid(logit) - target[own]) * weight[own] / len(own)).astype(np.float32))
            flat = np.zeros((len(used), x.shape[2]), np.float32)
            np.add.at(flat, inverse.ravel(), (dx * mask[own][:, :, None]).reshape(-1, x.shape[2]))
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            add_gradient(vocabulary, used, g["word"], g["char"], flat)
            step += 1
            for k in p:
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] ** 2 - v)
                p[k] = (p[k] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def vocabulary_inputs(v: Vocabulary, p, used: np.ndarray) -> np.ndarray:
    size = v.size[used]
    offset = np.cumsum(size) - size
    tri = v.tri[np.repeat(v.offset[used] - offset, size) + np.arange(size.sum())]
    chars = np.add.reduceat(p["char"][tri], offset, axis=0) / size[:, None]
    return np.concatenate([v.odds[used], p["word"][v.row[used]], chars], 1).astype(np.float32)


def add_gradient(v: Vocabulary, used: np.ndarray, g_word, g_char, dx: np.ndarray) -> None:
    size = v.size[used]
    offset = np.cumsum(size) - size
    tri = v.tri[np.repeat(v.offset[used] - offset, size) + np.arange(size.sum())]
    np.add.at(g_word, v.row[used], dx[:, ODDS : ODDS + DIM])
    np.add.at(g_char, tri, np.repeat(dx[:, ODDS + DIM :] / size[:, None], size, axis=0))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit with a little ridge; Newton steps, halved until the loss falls."""
    x, y, w = x.astype(np.float64), y.astype(np.float64), np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    loss = lambda v: float((weight * (np.logaddexp(0, a @ v) - y * (a @ v))).sum() + 0.005 * ((v - [1.0, 0.0]) ** 2).sum())
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (q - y)) + 0.01 * (w - [1.0, 0.0])
        step = np.linalg.solve((a * (weight * q * (1 - q))[:, None]).T @ a + 0.01 * np.eye(2), grad)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, column: str, fit_docs: int = FIT_DOCS):
    """labels: doc_id and column (0 or 1) of the rows to learn from.  Returns a function of words to probabilities."""
    y = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts, n = frequencies(docs, Labels.publish(y))
    if not n.all():
        return None, float(n[1] / n.sum()) if n.sum() else 0.5
    odds = log_odds(counts, n)
    best = y.withColumn("_h", F.xxhash64("doc_id"))
    chosen = best.where("y = 1").orderBy("_h", "doc_id").limit(fit_docs).union(best.where("y = 0").orderBy("_h", "doc_id").limit(fit_docs)).select("doc_id", "y")
    rows = docs.join(F.broadcast(chosen), "doc_id").withColumn("_t", F.struct(F.xxhash64("text"), F.md5(F.col("text").cast("binary"))))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((counts, n))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds_ = log_odds(*held.value)
        for batch in batches:
            own = [(i, t, c, h) for i, t, c, h in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) if not calibrates(i)]
            yield pa.record_batch([pa.array([i for i, *_ in own], pa.int64()), pa.array([c for *_, c, _ in own], pa.int32()), pa.array([h for *_, h in own], batch.schema.field(3).type), pa.array([pickle.dumps(lessons(i, t, c, odds_)) for i, t, c, _ in own], pa.binary())], names=["doc_id", "y", "_t", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, c, x) for batch in batches for i, c, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        picked = [(w, c) for _, c, x in found for w in pickle.loads(x)]
        yield pa.record_batch([pa.array([pickle.dumps(fit([w for w, _ in picked], np.array([c for _, c in picked], np.int64), *held.value))], pa.binary())], names=["model"])

    # One row for each id reaches the one task that fits the network: a few windows each, 2 * fit_docs rows at most.
    one = lambda df, *columns: df.groupBy("doc_id").agg(*(F.min_by(c, "_t").alias(c) for c in columns))
    taught = one(rows.select("doc_id", "text", "y", "_t").mapInArrow(teach, f"doc_id long, y int, _t {rows.schema['_t'].dataType.simpleString()}, x binary"), "y", "x")
    p = pickle.loads(taught.repartition(1).mapInArrow(learn, "model binary").head()[0])
    network = spark.sparkContext.broadcast(p)

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without = leave_out(*held.value)
        for batch in batches:
            own = [(i, t, c, h) for i, t, c, h in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) if calibrates(i)]
            top = [float(max_logits(network.value, parts_of(data := np.frombuffer(t.encode(), np.uint8), np.array([0, len(data)])), without[c])[0]) for _, t, c, _ in own]
            yield pa.record_batch([pa.array([i for i, *_ in own], pa.int64()), pa.array([c for *_, c, _ in own], pa.int32()), pa.array([h for *_, h in own], batch.schema.field(3).type), pa.array(top, pa.float64())], names=["doc_id", "y", "_t", "x"])

    examined = one(rows.select("doc_id", "text", "y", "_t").mapInArrow(examine, f"doc_id long, y int, _t {rows.schema['_t'].dataType.simpleString()}, x double"), "y", "x")
    got = sorted(tuple(r) for r in examined.collect())  # three numbers for each of 2 * fit_docs ids at most
    c, top = np.array([r[1] for r in got], np.int64), np.array([r[2] for r in got])
    scale = 1.0, 0.0
    if 0 < c.sum() < len(c):
        # Classes were chosen apart; weights give them the shares that they have among all labelled rows.
        weight = (n / n.sum())[c] / (np.bincount(c, minlength=2) / len(c))[c]
        scale = platt(top, c, weight)
    return (p, odds, scale), None


def probabilities(model, constant: float | None, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(bounds) - 1, constant)
    p, odds, (slope, offset) = model
    top = max_logits(p, parts_of(data, bounds), odds).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(slope * top + offset, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row; labels: those to learn from."""
    model, constant = train(docs, labels, column)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: two hashed tables and a small network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches, size=SLICE):
            q = probabilities(held.value, constant, data, bounds)
            yield pa.record_batch([part.column(0), pa.array(q), pa.array((q >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns; nothing is shuffled."""
    model, constant = train(docs, labels, column)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches, size=SLICE):
            yield part.filter(pa.array(probabilities(held.value, constant, data, bounds) < threshold))

    return docs.mapInArrow(run, docs.schema)


def remainder(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op3_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(remainder(3) != 1))
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op3_gru_toxicity": op3_gru_toxicity}
SQL: dict[str, str] = {}
