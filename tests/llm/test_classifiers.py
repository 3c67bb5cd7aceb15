import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomgraph.llm import quality, toxicity
from loomgraph.llm.text import words_of

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(rng).items()}
    x = rng.normal(size=(3, 5, toxicity.ODDS + 2 * toxicity.DIM))
    mask = np.arange(5) < np.array([[5], [3], [1]])

    def loss(q, x_=x):
        return float(np.logaddexp(0, toxicity.forward(q, x_, mask)).sum())

    keep: dict = {}
    z = toxicity.forward(p, x, mask, keep)
    g, dx = toxicity.backward(p, x, keep, 1 / (1 + np.exp(-z)))
    for name in ("w_f", "u_f", "c_f", "w_b", "u_b", "c_b", "att_w", "att_v", "out_w", "out_b"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=2e-3), name
    up, down = x.copy(), x.copy()
    up[1, 2, 4] += 1e-3
    down[1, 2, 4] -= 1e-3
    assert dx[1, 2, 4] == pytest.approx((loss(p, up) - loss(p, down)) / 2e-3, abs=2e-3)


def test_windows_cover_everything():
    first = np.array([0, 0, 1, 33, 33 + 200])
    start, size, text = toxicity.windows(first)
    for i in range(4):
        own = text == i
        seen = {k for a, n in zip(start[own], size[own], strict=True) for k in range(a, a + n)}
        assert own.sum() >= 1 and seen == set(range(first[i], first[i + 1]))


@pytest.mark.parametrize(
    ("module", "query", "column", "folder", "recall", "precision", "loss"),
    [(toxicity, "op3_gru_toxicity", "toxic", LARGE, 0.8, 0.8, 0.5), (quality, "op5_random_indexing_quality", "quality", MIDDLE, 0.95, 0.95, 0.5)],
)
def test_held_out_rows(spark, module, query, column, folder, recall, precision, loss):
    """Recall and precision of what is predicted, and the log loss as a share of that of the base rate alone."""
    import zlib

    got = {r.doc_id: r for r in getattr(module, query)(spark, folder).collect()}
    labels = {r["doc_id"]: r[column] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    assert len(got) == pq.read_metadata(f"{folder}/documents.parquet").num_rows
    of, rest = (3, 1) if column == "toxic" else (4, 2)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % of == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for k, r in got.items())
    held = [k for k in labels if got[k].held_out]
    y, own = np.array([labels[k] for k in held]), np.array([got[k].predicted for k in held])
    assert (own * y).sum() >= recall * y.sum() and (own * y).sum() >= precision * own.sum()
    score = np.clip([got[k].score for k in held], 1e-6, 1 - 1e-6)
    entropy = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert entropy(score) <= loss * entropy(y.mean())


def test_calibration_is_the_best_logistic_fit():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-6, 3, 500), rng.normal(8, 4, 60)])
    y, weight = np.repeat([0, 1], [500, 60]), np.repeat([0.5, 3.0], [500, 60])
    loss = lambda a, b: float((weight * (np.logaddexp(0, a * x + b) - y * (a * x + b))).sum())
    a, b = toxicity.platt(x, y, weight)
    assert a > 0 and all(loss(a, b) <= loss(a + s, b + t) + 0.05 for s in (-0.1, 0, 0.1) for t in (-0.2, 0, 0.2))


def test_labels_are_looked_up(spark, monkeypatch):
    """Ids in many shared files, among them negative and unknown ones."""
    monkeypatch.setattr(toxicity, "LABELS", 16)
    rnd = random.Random(1)
    want = {rnd.randrange(-(2**62), 2**62): rnd.randrange(2) for _ in range(500)} | {0: 1, -1: 0, 2**63 - 1: 1}
    labels = toxicity.Labels(toxicity.Labels.publish(spark.createDataFrame(list(want.items()), "doc_id long, y int")))
    assert labels.bits > 3
    asked = [*want, *(k + 1 for k in list(want)[:200]), None]
    import pyarrow as pa

    assert labels.of(pa.array(asked, pa.int64())).tolist() == [want.get(k, -1) for k in asked]
    none = toxicity.Labels(toxicity.Labels.publish(spark.createDataFrame([], "doc_id long, y int")))
    assert none.of(pa.array([1, None], pa.int64())).tolist() == [-1, -1]


def test_sums_of_tasks_arrays(spark):
    from loomgraph.llm import common

    size = common.PACK * 2 + 5
    arrays = [np.random.default_rng(i).integers(-(10 ** (i % 12)), 10 ** (i % 12) + 1, size) * (np.arange(size) % (i + 1) == 0) for i in range(20)]

    def send(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield common.packed(arrays[i])

    got = common.add_up(spark.range(20).repartition(7).mapInArrow(send, common.PACKED), size)
    assert (got == sum(arrays)).all()


def _texts():
    rnd = random.Random(1)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        words = [rnd.choice(clean) for _ in range(rnd.choice([5, 60, 120]))]
        if bad:
            words[rnd.randrange(len(words))] = "scumbag"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), int(not bad)))
    return rows, labels


def test_one_word_in_a_long_text_and_edge_cases(spark, frame):
    rows, labels = _texts()
    rows += [(1000, None), (1001, ""), (1002, "w1 " * 20000 + "scumbag " + "w2 " * 500), (1003, "w1 " * 20000), (1003, "w1 " * 20000), (None, "w1 w2")]
    table = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, toxic int, quality int")
    out = toxicity.score(frame(rows), table).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.predicted for r in out}
    assert got[1000] == got[1001] == got[1003] == 0 and got[1002] == 1
    assert np.mean([got[i] == t for i, t, _ in labels]) > 0.95
    kept = toxicity.without_toxic(frame(rows), table)
    assert kept.columns == frame(rows).columns and {r.doc_id for r in kept.collect()} == {k for k in got if got[k] == 0}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_documents(spark, frame, module):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert [(r.score, r.predicted) for r in module.score(frame([(1, "a b"), (2, None)]), none).collect()] == [(0.5, 0)] * 2
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    assert [r.score for r in module.score(frame([(1, "a b")]), one).collect()] == [1.0]
    assert module.score(frame([]), one).count() == 0


def test_quality_edge_cases(spark, frame):
    rows = [(i, ("Good words make a text here " * 5) if i % 3 else ("###$$ %%% &&& " * 12)) for i in range(90)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 300_000), (1003, "same text"), (1003, "same text")]
    table = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    out = quality.score(frame(rows), table).collect()
    got = {r.doc_id: r.predicted for r in out}
    assert len(out) == len(rows) and all(got[i] == int(i % 3 > 0) for i in range(90))
    kept = quality.only_good(frame(rows), table)
    assert kept.columns == frame(rows).columns and {r.doc_id for r in kept.collect()} == {k for k in got if got[k]}


def test_index_vectors_are_sums_over_neighbours():
    data = np.frombuffer(b"aa bb cc aa", np.uint8)
    w = words_of(data, np.array([0, 5, 11]), keep_case=True)
    out = np.zeros((quality.ROWS + quality.SHAPES, quality.DIM))
    quality.accumulate(w, out)
    shape = quality.rows_of(w)[1]

    def vector(i):
        v = np.zeros(quality.DIM)
        for place, sign in (quality.index_vectors(w.hash[i : i + 1]), quality.index_vectors(shape[i : i + 1].astype(np.uint64))):
            np.add.at(v, place[0], sign[0])
        return v

    rows = quality.rows_of(w)[0]
    assert np.allclose(out[rows[0]], vector(1) + vector(2)) and np.allclose(out[rows[2]], vector(3)) and np.allclose(out[rows[1]], vector(0))


def test_parts_of_long_words():
    rnd = random.Random(4)
    texts = ["short words", "x" * 64, "ab" * 100, "a-b/" * 40, "\u00a0".join(["scumbag"] * 20), "\u3000".join(["scumbag"] * 20), "你好吗" * 30, "é" * 50 + "你" + "x" * 40, "ж" * 700_000, "你" * 500_000, "-" * 2_000_000]
    texts += ["".join(rnd.choice("a9-é你\u00a0😀") * rnd.choice([1, 1, 50]) for _ in range(rnd.randrange(60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    w = toxicity.parts_of(data, bounds)
    assert (w.end > w.start).all() and (w.end - w.start <= toxicity.LONG + 2).all()
    for i in range(len(raw)):
        seen = np.zeros(len(data) + 1, np.int64)
        own = slice(w.first[i], w.first[i + 1])
        np.add.at(seen, w.start[own], 1), np.add.at(seen, w.end[own], -1)
        covered = np.cumsum(seen)[bounds[i] : bounds[i + 1]] > 0
        assert all(c or b in b" " for c, b in zip(covered, raw[i], strict=True))
        if own.stop - own.start < 5000:
            for a, b, h in zip(w.start[own], w.end[own], w.hash[own], strict=True):
                part = data[a:b].tobytes()
                assert part.decode() and (b" " in part or "\u00a0" not in part.decode() or words_of(data[a:b], np.array([0, b - a])).hash[0] == h)
    words = [data[a:b].tobytes() for a, b in zip(w.start[w.first[4] : w.first[6]], w.end[w.first[4] : w.first[6]], strict=True)]
    assert words.count(b"scumbag") == 40


def test_a_term_late_in_a_text_without_white_space(spark, frame):
    rows, labels = _texts()
    wide = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    rnd = random.Random(2)
    plain = lambda n: "".join(rnd.choice(wide) for _ in range(n))
    for i in range(160, 320):
        bad = i % 4 == 0
        rows.append((i, plain(rnd.randrange(60, 200)) + ("恶棍" if bad else "") + plain(rnd.randrange(60))))
        labels.append((i, int(bad), int(not bad)))
    long = {}
    for k, sign in enumerate(["-", "/", "\u00a0", "\u3000", "<br>"]):
        long[1000 + k], long[2000 + k] = sign.join(["w1", "w2", "w3"] * 60 + ["scumbag", "w4"]), sign.join(["w1", "w2", "w3"] * 60 + ["w4"])
    for k in range(5):
        long[1100 + k], long[2100 + k] = plain(300 + k) + "恶棍" + plain(90), plain(390 + k)
    table = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r.predicted for r in toxicity.score(frame(rows + list(long.items())), table).collect()}
    assert {i: got[i] for i in long} == {i: int(i < 2000) for i in long}
