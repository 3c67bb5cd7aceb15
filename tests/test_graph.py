import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resolve, search, validate
from loomgraph.operators.graph import Graph, coerce
from loomgraph.plans.schema import GraphError, Schema
from loomgraph.sources.store import Registry
from loomgraph.streaming.upsert import upsert_stream

SCHEMA = Schema.of({
    "name": "t",
    "node_types": {
        "Item": {"properties": {"name": {"type": "string", "required": True}, "tag": {"type": "string", "indexed": True}, "level": {"type": "int", "indexed": True, "range": [0, 9]}, "ok": {"type": "bool", "indexed": True}, "score": {"type": "float", "indexed": True}, "kind": {"type": "enum", "values": ["a", "b"]}, "words": {"type": "list:string"}, "when": {"type": "datetime"}, "tier": {"type": "string", "default": "standard", "required": True}}},
    },
    "edge_types": {"LIKES": {"from": "Item", "to": "Item", "properties": {"weight": {"type": "float", "range": [0, 1]}, "source": {"type": "string"}}}},
})


def problems(spark, d):
    df = spark.createDataFrame([("x", d if isinstance(d, str) else json.dumps(d))], "node_id string, properties string")
    row = validate.validate_nodes(df, SCHEMA, "Item").head()
    return {e["property"]: e["message"] for e in row["errors"]}, json.loads(row["properties"])


@pytest.mark.parametrize(
    ("d", "want"),
    [
        ({"name": "n"}, {}),
        ({}, {"name": "required property is missing"}),
        ({"name": None}, {"name": "required property cannot be null"}),
        ({"name": "n", "tag": None}, {}),
        ({"name": "n", "level": 3.0}, {"level": "expected type Int, got float"}),
        ({"name": "n", "score": 1}, {"score": "expected type Float, got int"}),
        ({"name": "n", "level": 10}, {"level": "value 10 out of range [0, 9]"}),
        ({"name": "n", "level": 9}, {}),
        ({"name": "n", "ok": "true"}, {"ok": "expected type Bool, got string"}),
        ({"name": "n", "kind": "c"}, {"kind": "invalid enum value 'c', expected one of [\"a\", \"b\"]"}),
        ({"name": "n", "words": ["a", 1]}, {"words": "list:string element 1 is not a string: got int"}),
        ({"name": "n", "words": ["a", None]}, {"words": "list:string element 1 is not a string: got null"}),
        ({"name": "n", "words": []}, {}),
        ({"name": "n", "when": "2026-04-26T00:00:00Z"}, {}),
        ({"name": "n", "when": 42}, {"when": "expected type Datetime, got int"}),
        ({"name": {"a": 1}}, {"name": "expected type String, got map"}),
        ({"name": "n", "more": {"deep": [1]}}, {}),
    ],
)
def test_values(spark, d, want):
    assert problems(spark, d)[0] == want


def test_defaults_fill_absent_keys_only(spark):
    assert problems(spark, {"name": "n"})[1]["tier"] == "standard"
    assert problems(spark, {"name": "n", "tier": "gold"})[1]["tier"] == "gold"
    found, got = problems(spark, {"name": "n", "tier": None})
    assert got["tier"] is None and found == {"tier": "required property cannot be null"}
    assert problems(spark, " { } ")[1] == {"tier": "standard"}


def test_typed_keeps_absent_and_extra(spark):
    df = spark.createDataFrame([("x", '{"name":"n","tag":null,"more":[1,2]}')], "node_id string, properties string")
    row = validate.typed(df, SCHEMA.node_types["Item"]).head()
    assert row["name"] == "n" and row["tag"] is None and row["_present"] == ["more", "name", "tag"] and row["_extra"] == {"more": "[1,2]"}


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([("a", "red", 1), ("b", "blue", 2), ("c", "red", 3)], "node_id string, tag string, level long")
    edges = spark.createDataFrame([("a", "b", 0.5, "s"), ("b", "c", 0.1, None), ("c", "gone", 0.2, None)], "from_id string, to_id string, weight double, source string")
    emb = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.95, 0.1, 0.0]), ("c", [0.0, 0.0, 1.0])], "node_id string, embedding array<float>")
    return Graph(SCHEMA, {"Item": nodes}, {"LIKES": edges}, {"Item": emb})


def ids(df, c="node_id"):
    return sorted(r[c] for r in df.collect())


def test_filters(graph):
    assert ids(graph.list_nodes("Item", "tag", "red")) == ["a", "c"] and ids(graph.list_nodes("Item", "level", "2")) == ["b"]
    assert ids(graph.nodes_where("Item", "name", "x")) == []
    for args in (("tag", None), ("score", "1.0"), ("words", "a"), ("level", "two"), ("ok", "yes"), ("nothing", "x")):
        with pytest.raises(GraphError):
            graph.list_nodes("Item", *args)
    assert coerce(SCHEMA, "Item", "ok", "true") is True


@pytest.mark.parametrize("text", ["1_0", " 7 ", "99999999999999999999", "", "+", "1.0", "0x1", "٣"])
def test_whole_numbers_are_those_of_64_bits(text):
    with pytest.raises(GraphError):
        coerce(SCHEMA, "Item", "level", text)
    assert [coerce(SCHEMA, "Item", "level", x) for x in ("-3", "+4", "007", str(2**63 - 1), str(-(2**63)))] == [-3, 4, 7, 2**63 - 1, -(2**63)]


def test_graph_ids(spark):
    names = ["abc", "a-b_C9", "abc\n", "", "a b", "x" * 100, "x" * 101, None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(validate.valid_graph_id(F.col("n"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, True, False, False]


def test_many_defaults_plan_quickly(spark):
    """The expression grows with the number of defaults; absent ones are filled at once."""
    schema = Schema.of({"name": "d", "node_types": {"N": {"properties": {f"p{i}": {"type": "int", "default": i, "range": [0, 5]} for i in range(12)} | {"odd name": {"type": "string", "default": 'say "x"'}}}}})
    rows = spark.createDataFrame([("a", "{}"), ("b", ' { "p3" : null, "more": [1] } \n'), ("c", None)], "node_id string, properties string")
    began = time.time()
    out = validate.validate_nodes(rows, schema, "N")
    out._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5 and len(out._jdf.queryExecution().analyzed().toString()) < 60_000
    got = {r.node_id: (json.loads(r.properties), [(e["property"], e["message"]) for e in r.errors]) for r in out.collect()}
    full = {f"p{i}": i for i in range(12)} | {"odd name": 'say "x"'}
    wrong = [(f"p{i}", f"value {i} out of range [0, 5]") for i in sorted(range(6, 12), key=str)]
    assert got == {"a": (full, wrong), "b": (full | {"p3": None, "more": [1]}, wrong), "c": (full, wrong)}


def test_create_and_replace_are_checked(spark):
    raw = lambda *rows: spark.createDataFrame([(i, json.dumps(p) if p is not None else None, k) for k, (i, p) in enumerate(rows)], "node_id string, properties string, seq int")
    done = Graph(SCHEMA).create_nodes("Item", raw(("a", {"name": "one", "level": 3, "more": 1}), ("b", {"level": 3}), ("c", {"name": "x", "level": 12, "kind": "z"}), ("a", {"name": "two", "tag": None}), ("d", None)))
    stored = {r.node_id: (r["name"], r.level, r.tier, list(r._present)) for r in done.stored.collect()}
    assert stored == {"a": ("two", None, "standard", ["name", "tag", "tier"])}
    assert sorted((r.node_id, r.property) for r in done.refused.collect()) == [("b", "name"), ("c", "kind"), ("c", "level"), ("d", "name")]
    again = done.graph.replace_node_properties("Item", raw(("a", {"name": "three", "tier": "gold"}), ("zz", {"name": "nobody"}), ("a", {"name": 5})))
    assert {r.node_id: (r["name"], r.tier, r.tag) for r in again.graph.nodes["Item"].collect()} == {"a": ("three", "gold", None)}
    assert [(r.node_id, r.property, r.message) for r in again.refused.collect()] == [("a", "name", "expected type String, got int")]
    for f in (Graph(SCHEMA).create_nodes, Graph(SCHEMA).replace_node_properties):
        with pytest.raises(GraphError) as e:
            f("Nothing", raw(("a", {})))
        assert e.value.kind == "unknown_node_type"
    assert Graph(SCHEMA).replace_node_properties("Item", raw(("a", {"name": "x"}))).stored.count() == 0


def test_create_edges_is_checked(graph, spark):
    rows = [("LIKES", "Item", "a", "Item", "c", {"weight": 0.25}, 1), ("LIKES", "Item", "a", "Item", "b", {"weight": 7.5}, 1), ("LIKES", "Item", "b", "Other", "c", {}, 1), ("HATES", "Item", "a", "Item", "c", {}, 1), ("LIKES", "Item", "a", "Item", "c", {"source": "later"}, 2)]
    raw = spark.createDataFrame([(*r[:5], json.dumps(r[5]), r[6]) for r in rows], "edge_type string, from_type string, from_id string, to_type string, to_id string, properties string, seq int")
    done = graph.create_edges(raw)
    got = {(r.from_id, r.to_id): (r.weight, r.source) for r in done.graph.edges["LIKES"].collect()}
    assert got == {("a", "b"): (0.5, "s"), ("b", "c"): (0.1, None), ("c", "gone"): (0.2, None), ("a", "c"): (None, "later")}
    assert [(r.edge_type, r.from_id, r.to_id, json.loads(r.properties)) for r in done.stored.collect()] == [("LIKES", "a", "c", {"source": "later"})]
    assert sorted((r.edge_type, r.to_id, r.property, r.message) for r in done.refused.collect()) == sorted([
        ("LIKES", "b", "weight", "value 7.5 out of range [0, 1]"), ("LIKES", "c", None, "Invalid edge: LIKES cannot connect Item to Other"), ("HATES", "c", None, "Unknown edge type: HATES"),
    ], key=lambda x: (x[0], x[1]))


def test_what_deletes_answer_and_single_vectors(graph, spark):
    keys = spark.createDataFrame([("a",), ("zz",), ("a",)], "node_id string")
    assert {r.node_id: r.existed for r in graph.nodes_existed("Item", keys).collect()} == {"a": True, "zz": False}
    assert {r.node_id: r.existed for r in graph.embeddings_existed("Item", keys).collect()} == {"a": True, "zz": False}
    assert {r.node_id: r.existed for r in graph.nodes_existed("Nothing", keys).collect()} == {"a": False, "zz": False}
    ends = spark.createDataFrame([("a", "b"), ("b", "a")], "from_id string, to_id string")
    assert {r.from_id: r.existed for r in graph.edges_existed("LIKES", ends).collect()} == {"a": True, "b": False}
    assert [r.node_id for r in graph.get_embedding("Item", ["a", "zz"]).collect()] == ["a"]
    with pytest.raises(GraphError):
        graph.get_embedding("Nothing", ["a"])


def test_adjacency_and_dangling(graph):
    assert ids(graph.outgoing("a"), "to_id") == ["b"] and ids(graph.incoming("c"), "from_id") == ["b"]
    assert ids(graph.dangling_edges(), "to_id") == ["gone"]
    assert [tuple(r) for r in graph.two_hop("LIKES", "LIKES", "a").collect()] == [("a", "b", "c")]


def test_delete_takes_edges_and_vectors_along(graph, spark):
    g = graph.delete_nodes("Item", spark.createDataFrame([("b",), ("gone",)], "node_id string"))
    assert ids(g.nodes["Item"]) == ["a", "c"] and g.edges["LIKES"].count() == 0 and ids(g.embeddings["Item"]) == ["a", "c"]
    assert graph.edges["LIKES"].count() == 3


def test_merge_overlays(graph, spark):
    rows = spark.createDataFrame([("a", "b", 0.9, None, ["weight"]), ("b", "c", 0.1, None, ["source"]), ("x", "y", 1.0, None, ["weight"])], "from_id string, to_id string, weight double, source string, _present array<string>")
    got = {(r.from_id, r.to_id): (r.weight, r.source) for r in graph.merge_edges("LIKES", rows).edges["LIKES"].collect()}
    assert got == {("a", "b"): (0.9, "s"), ("b", "c"): (0.1, None), ("c", "gone"): (0.2, None)}


def test_upsert_last_wins_and_batch(graph, spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("z", "w", 1)], "node_id string, tag string, seq int")
    batch = graph.batch().add("upsert_nodes", "Item", rows)
    assert ids(graph.nodes["Item"]) == ["a", "b", "c"]
    g, n = batch.commit()
    got = {r.node_id: (r.tag, r.level) for r in g.nodes["Item"].collect()}
    assert n == 1 and got == {"a": ("y", None), "b": ("blue", 2), "c": ("red", 3), "z": ("w", None)}
    assert batch.commit()[1] == 0


def test_embeddings(graph, spark):
    new = spark.createDataFrame([("a", [0.0, 1.0, 0.0]), ("gone", [1.0, 1.0, 1.0])], "node_id string, embedding array<float>")
    assert ids(graph.set_embeddings("Item", new).embeddings["Item"]) == ["a", "b", "c"]
    with pytest.raises(GraphError):
        graph.set_embeddings("Item", spark.createDataFrame([("a", [1.0])], "node_id string, embedding array<float>"))
    assert [r.node_id for r in search.similar(graph.embeddings["Item"], [1.0, 0.0, 0.0], 3).collect()] == ["a", "b", "c"]
    for q, k in (([], 3), ([1.0], 0)):
        with pytest.raises(GraphError):
            search.similar(graph.embeddings["Item"], q, k)


def test_cosine_of_zero_and_opposite(spark):
    from loomgraph.functions import vector

    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vector.cosine("a", "b")).collect()] == [0.0, -1.0, 1.0, None]
    one = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>").select(vector.dot("a", "b"), vector.hadamard("a", "b"), vector.euclidean(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))).head()
    assert tuple(one) == (32.0, [4.0, 10.0, 18.0], 5.0)


def plain_jaro_winkler(a, b):
    """One pair at a time, character by character."""
    a, b = a.lower(), b.lower()
    if a == b:
        j = 1.0
    else:
        reach, used, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
        for i, c in enumerate(a):
            for k in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if k not in used and b[k] == c:
                    used.add(k)
                    left.append(c)
                    break
        right, m = [b[k] for k in sorted(used)], len(left)
        j = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) / 2) / m) / 3 if m else 0.0
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return math.floor((j + same * 0.1 * (1 - j)) * 100 + 0.5)


def plain_score(a, b):
    ordered = lambda x: " ".join(sorted(x.split()))
    return max(plain_jaro_winkler(a, b), plain_jaro_winkler(ordered(a), ordered(b)))


def made_up_names(n, seed=3):
    """Names of few parts, so that many are alike: with swapped words, dropped and doubled letters."""
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        words = [rnd.choice(["Brass", "brasse", "copper", "coper", "tin", "Ölkanne", "valve", "valves", "hinge", "x"]) for _ in range(rnd.randrange(1, 4))]
        name = " ".join(words)
        if rnd.random() < 0.4:
            k = rnd.randrange(len(name))
            name = name[:k] + name[k] * rnd.choice([0, 2]) + name[k + 1 :]
        out.add(name)
    return sorted(out)


def test_textbook_pairs():
    from loomgraph.functions import fuzzy

    pairs = {("martha", "marhta"): 96, ("dwayne", "duane"): 84, ("abc", "xyz"): 0, ("", ""): 100, ("word", ""): 0, ("A", "a"): 100}
    assert {(a, b): fuzzy.jaro_winkler_score(a, b) for a, b in pairs} == pairs
    assert fuzzy.token_sort_score("valve brass", "brass valve") == 100 > fuzzy.jaro_winkler_score("valve brass", "brass valve")


def test_name_scores_and_their_bound_against_single_pairs():
    from loomgraph.functions import fuzzy

    names = [*made_up_names(120), "", " ", "a" * 70]
    pairs = [(a, b) for a in names for b in names]
    want = np.array([plain_score(a, b) for a, b in pairs])
    assert fuzzy.name_scores(*map(list, zip(*pairs, strict=True))).tolist() == want.tolist()
    most = fuzzy.Bags(names).most(fuzzy.Bags(names)).ravel()
    assert (most >= want).all() and (most < 70).any()


def test_candidates_and_tiers_against_all_pairs(spark, monkeypatch):
    """With small blocks, so that queries and names meet in many tasks."""
    monkeypatch.setattr(resolve, "BLOCK", 20), monkeypatch.setattr(resolve, "GROUP", 50), monkeypatch.setattr(resolve, "CHUNK", 7)
    rng = np.random.default_rng(5)
    names = made_up_names(130)
    have = [(f"e{i}", n, i, rng.normal(size=3).tolist() if i % 5 else None) for i, n in enumerate(names[:90] + names[:10])]
    asks = [(f"q{i}", n, rng.normal(size=3).tolist() if i % 7 else None) for i, n in enumerate([*names[60:], "zzzz", "", None])]
    existing = spark.createDataFrame(have, "id string, name string, pos long, embedding array<double>")
    queries = spark.createDataFrame(asks, "query_id string, query string, query_embedding array<double>")
    score = {(q, e): plain_score(n, m) for q, n, _ in asks if n is not None for e, m, *_ in have}
    for least in (0, 75):
        got = [((r.query_id, r.id), r.score) for r in resolve.candidates(queries, existing, least).collect()]
        assert dict(got) == {k: v for k, v in score.items() if v >= least} and len(got) == len(dict(got))
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    t = resolve.Thresholds(70, 0.5, 96)
    want, plain = {}, {}
    for q, n, v in asks:
        best = max(((score[q, e], -pos, e) for e, _, pos, _ in have), default=None) if n is not None else None
        near = max(((cos(v, w), pos, e) for e, _, pos, w in have if v and w and score[q, e] >= 70), default=None) if n is not None else None
        new = ("create_new", None)
        plain[q] = (*(("auto_merge", best[2]) if best and best[0] >= 96 else new), best[0] if best else 0)
        want[q] = (*(("auto_merge", best[2]) if best and best[0] >= 96 else ("vector_merge", near[2]) if best and best[0] >= 70 and near and near[0] >= 0.5 else new), best[0] if best else 0)
    read = lambda df: {r.query_id: (r.decision, r.id, r.best_score) for r in df.collect()}
    assert read(resolve.resolve(queries, existing, t)) == want and {w[0] for w in want.values()} == {"auto_merge", "vector_merge", "create_new"}
    assert read(resolve.resolve(queries.drop("query_embedding"), existing, t)) == plain
    assert {r.decision for r in resolve.resolve(queries, existing.limit(0)).collect()} == {"create_new"}


def test_thresholds_of_a_type():
    assert resolve.Thresholds.of(None) == resolve.Thresholds(70, float(np.float32(0.85)), 90)
    assert resolve.Thresholds.of({"fuzzy_threshold": 50, "vector_threshold": 0.5, "auto_merge_threshold": 60}) == resolve.Thresholds(50, 0.5, 60)


def _wide(n: int):
    from loomgraph.plans.schema import Schema

    kinds = [{"type": "int", "range": [0, 9]}, {"type": "enum", "values": ["a", "b"]}, {"type": "list:string"}, {"type": "float", "default": 1.5}, {"type": "string", "required": True, "default": "x"}]
    properties = {f"p{i}": kinds[i % 5] for i in range(n)}
    return Schema.of({"name": "wide", "node_types": {"N": {"properties": properties}}, "edge_types": {"E": {"from": "N", "to": "N", "properties": properties}, "G": {}}})


def _times(df, what: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


EDGE = "edge_type string, from_type string, from_id string, to_type string, to_id string, properties string"


@pytest.mark.parametrize("n", [2, 15])
def test_properties_are_parsed_once_however_many_are_declared(spark, n):
    """Also in the filters that the optimizer makes of what follows."""
    raw = spark.createDataFrame([("E", "N", "1", "N", "2", '{"p0": 10, "p1": "b", "p2": ["a", 5]}')] * 2, EDGE).distinct()
    out = validate.validate_edges(raw, _wide(n)).select("from_id", F.explode("errors").alias("e"))
    assert 1 <= _times(out, "parseJson") <= 3 and _times(out, "schemaOfVariant") <= 3 * (n + n // 5)
    assert [r.e.message for r in out.collect()] == ["value 10 out of range [0, 9]", "list:string element 1 is not a string: got int"][: 1 if n < 3 else 2]


@pytest.mark.parametrize("n", [2, 15])
def test_written_edges_are_parsed_once(spark, n):
    from loomgraph.operators.graph import Graph

    rows = [("E", "N", "1", "N", "2", '{"p0": 10}'), ("E", "N", "1", "N", "3", '{"p0": 9}'), ("E", "X", "1", "N", "4", "{}")]
    done = Graph(_wide(n)).create_edges(spark.createDataFrame(rows, EDGE).distinct())
    kept = done.graph.edges["E"]
    assert 1 <= _times(kept, "parseJson") <= 2 and 1 <= _times(done.refused, "parseJson") <= 3
    assert [(r.to_id, r.p0) for r in kept.collect()] == [("3", 9)]
    assert sorted((r.to_id, r.message) for r in done.refused.collect()) == [("2", "value 10 out of range [0, 9]"), ("4", "Invalid edge: E cannot connect X to N")]


def test_edges_are_checked_once_by_compiled_code(spark):
    """Of written and of refused edges: one check a row, without lambdas and without paths to names that may be absent
    (either costs several times what the check does)."""
    rows = [("E", "N", "1", "N", str(i), p) for i, p in enumerate(('{"p0": 10, "p1": "c"}', '{"p0": "9"}', '{"p1": "b", "more": 1}', "{}", '["p0"]', None))]
    done = Graph(_wide(2)).create_edges(spark.createDataFrame([*rows, ("E", "X", "1", "N", "6", '{"p0": 10}')], EDGE).distinct())
    kept = done.graph.edges["E"].select("to_id", "p0", "p1")
    for df in (kept, done.refused):
        assert _times(df, "parseJson") == 1 and _times(df, "lambdafunction") == 0 and _times(df, "$.p") == 0
    assert sorted((r.to_id, r.p0, r.p1) for r in kept.collect()) == [("2", None, "b"), ("3", None, None), ("4", None, None), ("5", None, None)]
    assert sorted((r.to_id, r.property, r.message) for r in done.refused.collect()) == [
        ("0", "p0", "value 10 out of range [0, 9]"), ("0", "p1", "invalid enum value 'c', expected one of [\"a\", \"b\"]"), ("1", "p0", "expected type Int, got string"), ("6", None, "Invalid edge: E cannot connect X to N"),
    ]


@pytest.mark.parametrize("n", [5, 15])
def test_nodes_with_defaults_are_read_once(spark, n):
    from loomgraph.operators.graph import Graph

    rows = [("1", '{"p0": 3}'), ("2", '{"p3": null, "p4": "y", "more": 7}'), ("3", '{"p0": "z"}'), ("4", " { } \t")]
    done = Graph(_wide(n)).create_nodes("N", spark.createDataFrame(rows, "node_id string, properties string").distinct())
    kept = done.graph.nodes["N"]
    assert _times(kept, "from_json(") <= 2 and 1 <= _times(kept, "parseJson") <= 2 and _times(kept, "regexp_replace(") <= 1
    assert {r.node_id: (r.p0, r.p3, r.p4, dict(r._extra)) for r in kept.collect()} == {"1": (3, 1.5, "x", {}), "2": (None, None, "y", {"more": "7"}), "4": (None, 1.5, "x", {})}
    assert [(r.node_id, r.property, r.message) for r in done.refused.collect()] == [("3", "p0", "expected type Int, got string")]


# --- search


def test_the_nearest_of_almost_equal_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0004]), (2, [1.0, 0.0001]), (3, [1.0, 0.0002]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in search.similar(rows, [1.0, 0.0], 2, "vec_id").collect()] == [2, 3]
    got = {(r.vec_id, r["rank"]): r.neighbour for r in search.nearest_neighbours(rows, 2).collect()}
    assert got[2, 1] == 3 and got[2, 2] == 1 and got[1, 1] == 3 and got[3, 1] == 2


def test_neighbours_and_index_against_all_pairs(spark, monkeypatch):
    """Small blocks and groups; clustered vectors, with a null and an empty one, and one that comes twice."""
    from loomgraph.operators.index import IndexConfig, VectorIndex

    monkeypatch.setattr(search, "BLOCK", 40), monkeypatch.setattr(search, "GROUP", 90)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 8)), 12, axis=0) + rng.normal(size=(360, 8)) * 0.3
    x[7] = x[8]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [])], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    want = {(i, int(j)) for i in range(360) for j in np.lexsort((np.arange(360), -s[i]))[:5]}
    assert {(r.vec_id, r.neighbour) for r in search.nearest_neighbours(rows, 5).collect()} == want
    some = rows.where("vec_id % 100 = 0")
    assert {(r.vec_id, r.neighbour) for r in search.nearest_neighbours(rows, 5, queries=some).collect()} == {p for p in want if p[0] % 100 == 0}
    index = VectorIndex.build(rows, IndexConfig(sample=200, recall=0.95))
    assert index.stats().head()["vectors"] == 360 and 1 <= index.probes < len(index.centres)
    got = {(r.vec_id, r.neighbour) for r in index.neighbours(5).collect()}
    assert len(got & want) >= 0.9 * len(want) and index.recall(5, some) >= 0.9
    assert [r.vec_id for r in index.search(x[3].tolist(), 1).collect()] == [3]
    index = index.remove(spark.createDataFrame([(3,)], "vec_id long")).insert(spark.createDataFrame([(500, x[3].tolist())], "vec_id long, embedding array<double>"))
    assert [r.vec_id for r in index.search(x[3].tolist(), 1).collect()] == [500]
    assert {r.vec_id: r.found for r in index.contains(spark.createDataFrame([(3,), (4,), (500,)], "vec_id long")).collect()} == {3: False, 4: True, 500: True}
    for q in ([], [1.0]):
        with pytest.raises(GraphError):
            index.search(q, 1)
    with pytest.raises(GraphError):
        VectorIndex.build(rows.limit(0))


def test_few_pairs_of_a_neighbour_join_are_sorted(monkeypatch):
    """Of the pairs that a block of queries and a stream of vectors make, those that may be among the nearest are scored;
    exact copies tie by id; vectors without a cosine are left out."""
    from loomgraph.operators.search import Nearest, Vectors

    rng, seen, put = np.random.default_rng(4), [], Nearest._put
    monkeypatch.setattr(Nearest, "_put", lambda self, i, j, given: (seen.append(len(i)), put(self, i, j, given))[1])
    x = rng.normal(size=(6000, 16))
    x[3000:3050], x[5000:5040] = x[7], x[:40] * 3
    x[11, 2], x[12, 0], x[13], x[14] = np.nan, np.inf, 0, x[15] * 1e-170
    ids = rng.permutation(6000)
    found = Nearest([Vectors(ids[:400], x[:400].copy()), Vectors(ids[400:1000], x[400:1000].copy())], 5)
    for a in range(0, 6000, 1500):
        found.meet(Vectors(ids[a : a + 1500], x[a : a + 1500].copy()))
    u = np.nan_to_num(x, nan=0, posinf=0)
    u[14] = x[15]
    n = np.sqrt((u * u).cumsum(1)[:, -1])
    for i, own in enumerate(found.ids):
        at = int(np.flatnonzero(ids == own)[0])
        s = np.array([(u[at] * u[j]).cumsum()[-1] / max(n[at] * n[j], 1e-30) for j in range(6000)]) if at < 60 else u @ u[at] / np.maximum(n * n[at], 1e-30)
        s[[at, 11, 12]] = -3
        assert np.allclose(np.sort(found.best[i])[::-1], np.sort(s)[::-1][:5], atol=1e-12) and own not in found.who[i]
        same = np.flatnonzero(s > 1 - 1e-12)
        if len(same) >= 5:
            assert found.who[i].tolist() == sorted(ids[same].tolist())[:5]
    assert len(found.ids) == 998 and sum(seen) < 0.05 * 998 * 6000


def test_nulls_and_lengths_of_neighbours(spark):
    kind = "vec_id long, embedding array<float>"
    rows = spark.createDataFrame([(1, [1.0, 0.5]), (2, [1.0, 0.25]), (3, [None, 1.0])], kind)
    assert {(r.vec_id, r.neighbour) for r in search.nearest_neighbours(rows, 2).collect()} == {(1, 2), (2, 1)}
    with pytest.raises(Exception, match="dimension mismatch"):
        search.nearest_neighbours(rows.union(spark.createDataFrame([(4, [1.0]), (5, [1.0, 1.0, 1.0])], kind)), 2).collect()


def test_placing_in_cells_makes_few_rows_at_a_time():
    import pyarrow as pa

    from loomgraph.operators import index

    x = np.random.default_rng(1).normal(size=(3000, 4))
    batch = pa.record_batch([pa.array(np.arange(3000)), pa.array(list(x))], names=["vec_id", "embedding"])
    centres = x[:50]
    sizes, got = [], []
    for part in index.placed(batch, centres, 20):
        sizes.append(part.num_rows)
        got += zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)
    want = np.argsort(-(index.unit(x) @ centres.T), axis=1, kind="stable")[:, :20]
    assert max(sizes) <= index.OUT and got == [(i, int(c)) for i, row in enumerate(want) for c in row]


# --- statistics


def test_statistics(spark):
    from loomgraph.functions import stats

    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip([1, 2, 3, 4, 5], [3, 1, 4, 5, 2], strict=True)] + [("b", 1.0, 2.0), ("b", 1.0, 3.0), ("b", 1.0, 4.0), ("c", 1.0, 1.0), ("c", 2.0, 3.0)], "g string, x double, y double")
    got = {r.g: (r.s, r.p) for r in df.groupBy("g").agg(stats.regression_slope(F.col("x"), F.col("y")).alias("s"), stats.pearson(F.col("x"), F.col("y")).alias("p")).collect()}
    assert got["a"][1] == pytest.approx(0.2) and got["b"] == (None, None) and got["c"] == (2.0, None)


def test_registry(spark, graph, tmp_path):
    r = Registry(spark, str(tmp_path))
    assert r.rehydrate() == []
    r.create("g1", SCHEMA), r.create("g10", SCHEMA)
    for bad in ("", "a b", "x" * 101):
        with pytest.raises(GraphError):
            r.create(bad, SCHEMA)
    with pytest.raises(GraphError):
        r.create("g1", SCHEMA)
    r.save("g1", graph), r.save("g10", graph)
    r.save("g1", r.get("g1").delete_nodes("Item", spark.createDataFrame([("a",)], "node_id string")))
    again = Registry(spark, str(tmp_path))
    assert again.rehydrate() == ["g1", "g10"] and again.rehydrate() == [] and again.list_ids() == ["g1", "g10"]
    assert ids(again.get("g1").nodes["Item"]) == ["b", "c"] and ids(again.get("g10").nodes["Item"]) == ["a", "b", "c"]
    d = SCHEMA.json()
    d["node_types"]["Item"]["properties"]["extra"] = {"type": "int"}
    assert "extra" in again.replace_schema("g10", Schema.of(d)).nodes["Item"].columns
    del d["node_types"]["Item"]["properties"]["tag"]
    with pytest.raises(GraphError):
        again.replace_schema("g10", Schema.of(d))
    assert again.clear("g1").nodes.get("Item") is None and "Item" in again.get("g10").nodes
    again.delete("g1")
    assert again.list_ids() == ["g10"]
    with pytest.raises(GraphError):
        again.get("g1")


def test_a_save_writes_what_changed_and_cleans_up(spark, graph, tmp_path):
    r = Registry(spark, str(tmp_path))
    r.create("g", SCHEMA)
    r.save("g", graph)
    tables = lambda: {p.name for p in (tmp_path / "g" / "tables").iterdir()}
    first, reader = tables(), r.get("g").nodes["Item"]
    r.save("g", r.get("g").delete_edges("LIKES", spark.createDataFrame([("a", "b")], "from_id string, to_id string")))
    second = tables()
    assert {x.split("-")[0] for x in second - first} == {"edges"} and first < second and reader.count() == 3
    r.save("g", r.get("g").upsert_nodes("Item", spark.createDataFrame([("n", "x", 1)], "node_id string, tag string, level long")))
    assert len(tables()) == 4 and len([p for p in (tmp_path / "g").iterdir() if p.name.startswith("state-")]) == 2
    other = Registry(spark, str(tmp_path))
    other.rehydrate()
    assert ids(other.get("g").nodes["Item"]) == ids(r.get("g").nodes["Item"]) == ["a", "b", "c", "n"]


def test_a_crash_before_the_state_is_in_place_changes_nothing(spark, graph, tmp_path, monkeypatch):
    r = Registry(spark, str(tmp_path))
    r.create("g", SCHEMA)
    r.save("g", graph)

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(r.files, "write", crash)
    with pytest.raises(OSError, match="gone"):
        r.save("g", r.get("g").delete_nodes("Item", spark.createDataFrame([("a",)], "node_id string")))
    other = Registry(spark, str(tmp_path))
    assert other.rehydrate() == ["g"] and ids(other.get("g").nodes["Item"]) == ["a", "b", "c"]
    (tmp_path / "g" / "state-9.0.new").write_text("half of a sta")  # what a crash within a write leaves
    assert Registry(spark, str(tmp_path)).rehydrate() == ["g"]
    with pytest.raises(GraphError) as e:  # a second writer's state is never written over
        other.files.write("g/state-2", "{}")
    assert e.value.kind == "conflict"


def test_a_broken_graph_is_an_error(spark, graph, tmp_path):
    import shutil

    r = Registry(spark, str(tmp_path))
    r.create("good", SCHEMA), r.create("torn", SCHEMA)
    r.save("torn", graph)
    shutil.rmtree(next(p for p in (tmp_path / "torn" / "tables").iterdir() if p.name.startswith("nodes")))
    with pytest.raises(GraphError) as e:
        Registry(spark, str(tmp_path)).rehydrate()
    assert e.value.kind == "storage"
    (tmp_path / "torn" / "state-2").write_text("{")
    with pytest.raises(GraphError):
        Registry(spark, str(tmp_path)).rehydrate()


def test_stream_of_changes(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "graphs"))
    r.create("g", SCHEMA)
    schema = "node_id string, tag string, seq long"
    for i, rows in enumerate([[("a", "one", 1), ("b", "x", 5)], [("a", "two", 2), ("b", "late", 3), ("c", "new", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), r, "g", "Item", str(tmp_path / "ckpt")).awaitTermination(120)
        assert i or r.get("g").nodes["Item"].count() == 2
    assert {x.node_id: x.tag for x in r.get("g").nodes["Item"].collect()} == {"a": "two", "b": "x", "c": "new"}
