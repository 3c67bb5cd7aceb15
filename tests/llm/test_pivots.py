import numpy as np
import pytest

from loomgraph.llm import pivots


def brute(rows, cosine=0.98):
    ok = lambda v: v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
    n = {i: 0 for i, _, _ in rows}
    parent = {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, l1, v) in enumerate(rows):
        for j, l2, u in rows[:a]:
            if l1 is not None and l1 == l2 and ok(v) and ok(u) and len(u) == len(v):
                x, y = np.array(v, float), np.array(u, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
    return {i: (n[i], root(i)) for i in n}


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, lb, v, 0) for i, lb, v in rows], "vec_id long, label int, embedding array<double>, node int")


def test_groups_of_copies_and_near_copies(vectors, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), int(g % 3), (base + rng.normal(size=24) * rng.choice([0, 0.05, 0.15])).tolist()))
    near = rng.normal(size=24)
    rows += [(len(rows) + i, 1, (near + rng.normal(size=24) * 0.13).tolist()) for i in range(80)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(vectors(rows)).collect()}
    want = brute(rows)
    assert sum(v[0] for v in want.values()) > 1000
    # The index may miss a few of the links that brute force finds; it adds none.
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values()) and all(got[k][0] <= want[k][0] for k in want)


@pytest.mark.parametrize("mean", [0.0, 0.85, 0.93])
def test_vectors_with_a_common_direction(vectors, monkeypatch, mean):
    """As embeddings have them: all cosines are near `mean`, and a pivot is near every vector."""
    monkeypatch.setattr(pivots, "BLOCK", 16), monkeypatch.setattr(pivots, "ALONE", 40)
    rng = np.random.default_rng(7)
    common = pivots.unit(rng.normal(size=(1, 32)))
    base = np.sqrt(mean) * common + np.sqrt(1 - mean) * pivots.unit(rng.normal(size=(700, 32)))
    near = np.repeat(base[:30], 5, axis=0)
    near = 0.9805 * near + np.sqrt(1 - 0.9805**2) * pivots.unit(rng.normal(size=near.shape))
    rows = [(i, 0, v.tolist()) for i, v in enumerate(np.concatenate([base, near, np.repeat(base[40:41], 60, axis=0) + rng.normal(size=(60, 32)) * 0.012]))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(vectors(rows)).collect()}
    x = pivots.unit(np.array([v for _, _, v in rows]))
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert want.sum() > 2000 and sum(n for n, _ in got.values()) >= 0.97 * want.sum() and all(got[i][0] <= want[i] for i in range(len(rows)))
    chosen = pivots.Pivots(x[rng.permutation(len(x))[:400]], 0.98)
    assert len(chosen.away) > 100 and chosen.shared >= 1


def test_labels_of_chains_and_crowds():
    """Least places that links reach, in pair lists and in blocks, against a walk."""
    rng = np.random.default_rng(3)
    for n, share in ((2, 1.0), (60, 0.0), (60, 0.01), (60, 0.03), (60, 0.3)):
        ok = np.triu(rng.random((n, n)) < share, 1)
        ok[np.arange(n // 2), np.arange(n // 2) + 1] |= share > 0.02  # a chain
        want = np.arange(n)
        for _ in range(n):
            want = np.minimum(want, np.where(ok | ok.T, want[None, :], n).min(1))
        assert pivots.least_labels(n, *np.nonzero(ok)).tolist() == want.tolist()
        assert pivots.block_labels(ok | ok.T | np.eye(n, dtype=bool))[:n].tolist() == want.tolist()
        half = n // 2
        cross = ok[:half, half:]
        both = np.zeros((n, n), bool)
        both[:half, half:] = cross
        assert pivots.block_labels(cross).tolist() == pivots.least_labels(n, *np.nonzero(both)).tolist()


def test_the_first_list_of_a_pair_is_one():
    """Each pair that shares enough pivots has one list, by both ways to tell."""
    rng = np.random.default_rng(6)
    near = np.stack([rng.permutation(12)[:6] for _ in range(40)]).astype("<u2")
    seen = np.zeros((40, 40), int)
    for p in range(12):
        for q in range(p + 1, 12):
            at = np.flatnonzero((near == p).any(1) & (near == q).any(1))
            own = pivots.first_shared(near[at], near[at], p, q)
            i, j = (x.ravel() for x in np.meshgrid(at, at, indexing="ij"))
            assert (pivots.first_of_pairs(near[i], near[j], np.full(len(i), p), np.full(len(i), q)) == own.ravel()).all()
            seen[np.ix_(at, at)] += own
    shared = (near[:, None, :, None] == near[None, :, None, :]).sum((2, 3))
    assert (seen == (shared >= 2)).all()


def test_filter_of_ids(spark):
    from loomgraph.llm import common

    rows = spark.range(0, 3000, 7).union(spark.createDataFrame([(-5,), (2**62,)], "id long"))
    passes = common.id_filter(rows, "id")
    all_ = spark.range(-10, 200_000).union(spark.createDataFrame([(2**62,)], "id long"))
    got = {r.id for r in all_.where(passes("id")).collect()}
    assert {r.id for r in rows.collect()} <= got and len(got) < 500


def test_edge_cases(vectors):
    rows = [(1, 0, None), (2, 0, []), (3, 0, [0.0, 0.0]), (4, 0, [1.0, None]), (5, 0, [float("nan"), 1.0]), (6, 0, [1.0, 2.0]), (7, 0, [2.0, 4.0]), (8, 1, [1.0, 2.0]), (9, None, [1.0, 2.0]), (10, None, [1.0, 2.0]), (11, 0, [1.0, 2.0]), (12, 0, [1e-200, 2e-200]), (13, 0, [float("inf"), 1.0]), (14, 0, [1.0, 2.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(vectors(rows)).collect()}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 8, 9, 10, 13, 14)}
    assert got == alone | {6: (3, 6, True), 7: (3, 6, False), 11: (3, 6, False), 12: (3, 6, False)}
    none = pivots.near_duplicates(vectors([(None, 0, [1.0, 2.0]), (1, 0, [1.0, 2.0]), (None, None, None)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in none) == [(0, 0, True), (0, 0, True), (1, 0, True)]
    assert pivots.near_duplicates(vectors([])).count() == 0
    assert sorted((r.vec_id, r.n_links) for r in pivots.near_duplicates(vectors([rows[5], rows[5]])).collect()) == [(6, 1), (6, 1)]


def test_against_brute_force(spark, small):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{small}/embeddings.parquet").to_pylist()
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.op2_pivot_dedup(spark, small).collect()}
    assert got == brute([(r["vec_id"], r["label"], r["embedding"]) for r in t])
