import collections
import random

import numpy as np
import pytest

from loomgraph.llm import minhash


def shingle_sets(rows, size=5):
    out = {}
    for k, t in rows:
        w = (t or "").lower().split()
        out[k] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    return out


def brute(rows, threshold=0.8):
    sets = shingle_sets(rows)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for k in sorted(sets):
        near = collections.Counter(j for s in sets[k] for j in index[s])
        for j, n in near.items():
            if n / (len(sets[k]) + len(sets[j]) - n) >= threshold:
                a, b = root(j), root(k)
                parent[max(a, b)] = min(a, b)
        for s in sets[k]:
            index[s].append(k)
    return {k: root(k) for k in sets}


def test_probability_jaccard_of_sets_and_scale():
    u, v = np.arange(0, 10), np.arange(5, 20)
    one = lambda x: np.ones(len(x))
    assert minhash.probability_jaccard(u, one(u), v, one(v)) == pytest.approx(5 / 20)
    x, y = np.array([1.0, 2.0, 3.0]), np.array([3.0, 1.0, 1.0])
    k = np.arange(3)
    want = sum(1 / sum(max(x[j] / x[d], y[j] / y[d]) for j in range(3)) for d in range(3))
    assert minhash.probability_jaccard(k, x, k, y) == pytest.approx(want)
    assert minhash.probability_jaccard(k, 7 * x, k, y) == pytest.approx(want)


def test_registers_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    wa, wb = 1 + rng.random(300) * 3, 1 + rng.random(300) * 3
    sig = minhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 300), np.concatenate([wa, wb]), 2, registers=4000)
    order_a, order_b = np.argsort(a), np.argsort(b)
    want = minhash.probability_jaccard(a[order_a], wa[order_a], b[order_b], wb[order_b])
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_registers_of_one_shingle_and_of_none():
    sig = minhash.signatures(np.array([5 << 40], np.uint64), np.array([1]), np.array([1.0]), 2)
    assert (sig[1] == (5 << 40) >> 32).all() and (sig[0] == 0).all()


def test_against_brute_force(spark, small, documents):
    got = {r.doc_id: r.class_id for r in minhash.op1_probminhash_dedup(spark, small).collect()}
    assert got == brute([(d["doc_id"], d["text"]) for d in documents])


def test_large_near_group_and_rest(spark, frame, monkeypatch):
    """Many edits of one text, whose similarities spread over the threshold, in blocks of a few."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SALT", 16)
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            t[rnd.randrange(80)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r.class_id for r in minhash.classes(frame(rows)).collect()}
    assert got == brute(rows)


def test_edge_cases(frame):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "One  TWO"), (None, "one two"), (7, "z " * 30000), (8, "z " * 30000)]
    out = minhash.classes(frame(rows)).collect()
    got = collections.Counter((r.doc_id, r.class_id, r.kept) for r in out)
    assert got == collections.Counter([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 4, False), (None, None, True), (7, 7, True), (8, 7, False)])
    assert minhash.classes(frame([])).count() == 0
    kept = minhash.one_of_each(frame([*rows, (9, "solo text"), (9, "solo text")]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 7, 9] and "score" in kept.columns
