"""Schemas, on the orders graph that the queries use and on small ones made where they are needed."""

import hashlib
import json

import pytest

from loomgraph.plans.schema import WIRE_VERSION, GraphError, Schema
from loomgraph.sources.tables import SCHEMA


def copy_of(schema=SCHEMA):
    return Schema.of(schema.json())


def refused(kind, f, *args):
    with pytest.raises(GraphError) as e:
        f(*args)
    assert e.value.kind == kind


# --- reading


def test_yaml_and_json_give_one_schema():
    text = "name: s\nnode_types: {A: {properties: {n: {type: int, range: [1, 2]}}}}\nedge_types: {E: {to: [A]}}"
    one = Schema.from_yaml(text)
    assert Schema.from_json(json.dumps(one.json())).json() == one.json()
    assert Schema.from_yaml("schema:\n  " + text.replace("\n", "\n  ")).json() == one.json()
    assert (one.version, one.edge_types["E"].source, one.edge_types["E"].target, one.node_types["A"].properties["n"].range) == (1, "*", ["A"], (1.0, 2.0))


def test_resolution_and_modes_have_their_defaults():
    r = Schema.of({"name": "s", "node_types": {"P": {"resolution": {"fuzzy_threshold": 55}}}, "extraction_modes": {"fast": {}, "all": {"max_tokens": 9}}})
    assert r.node_types["P"].resolution == {"strategy": "fuzzy_then_vector", "fuzzy_threshold": 55, "vector_threshold": 0.85, "auto_merge_threshold": 90}
    assert r.extraction_modes == {"fast": {"include": "*", "max_tokens": 4096}, "all": {"include": "*", "max_tokens": 9}}


@pytest.mark.parametrize("types", [{"P": {"properties": {"x": {"type": "decimal"}}}}, {"P": {"resolution": {"strategy": "guess"}}}])
def test_unknown_types_and_strategies(types):
    refused("validation", Schema.of, {"name": "s", "node_types": types})


def test_several_texts_are_laid_over_each_other():
    parts = ["name: a\nedge_types: {OWNS: {from: Shop, to: Lamp}}", "name: b\nnode_types: {Shop: {}}", "name: c\nnode_types: {Lamp: {}}"]
    got = Schema.from_yamls(parts)  # the first alone would name unknown types
    assert got.name == "a" and sorted(got.node_types) == ["Lamp", "Shop"]
    refused("validation", Schema.from_yamls, parts[:2])
    refused("validation", Schema.from_yamls, [])


# --- merging and adding


def test_merge_adds_and_never_replaces_properties():
    over = Schema.of({
        "name": "over", "node_types": {"Part": {"properties": {"size": {"type": "string"}, "weight": {"type": "float"}}, "extraction_hint": "read the label"}, "Crate": {}},
        "edge_types": {"LIVES_IN": {"inference_category": "home", "pass_1_extractable": True}},
    })
    before = SCHEMA.json()
    got = SCHEMA.merge(over)
    part, edge = got.node_types["Part"], got.edge_types["LIVES_IN"]
    assert (part.properties["size"].type, part.properties["weight"].type, part.extraction_hint, part.embedding_field) == ("int", "float", "read the label", "name")
    assert (edge.source, edge.target, edge.inference_category, edge.pass_1_extractable) == ("Customer", "Nation", "home", True)
    assert "Crate" in got.node_types and got.name == SCHEMA.name and SCHEMA.json() == before


def test_ensure_says_whether_it_added():
    s = copy_of()
    for add in (lambda: s.ensure_node_type("Crate"), lambda: s.ensure_edge_type("STORED_IN", {"from": "Part", "to": "Crate"}), lambda: s.ensure_node_property("Crate", "depth", {"type": "float"})):
        assert add() and not add()
    refused("unknown_node_type", s.ensure_node_property, "Barrel", "depth", {"type": "float"})


# --- checks


def test_ends_of_edges():
    for args, kind in ((("PLACED", "Supplier", "Order"), "invalid_edge"), (("PLACED", "Customer", "Part"), "invalid_edge"), (("RETURNED", "Customer", "Order"), "unknown_edge_type")):
        refused(kind, SCHEMA.validate_edge, *args)
    SCHEMA.validate_edge("PLACED", "Customer", "Order")
    refused("validation", Schema.of, {"name": "s", "node_types": {"Part": {}}, "edge_types": {"FITS": {"from": "Part", "to": ["Part", "Prat"]}}})


def evolve(change):
    d = SCHEMA.json()
    change(d)
    return SCHEMA.incompatibilities(Schema.of(d, check=False))


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (lambda d: d["node_types"].pop("Item"), ["removed node type: Item"]),
        (lambda d: d["edge_types"].pop("PLACED"), ["removed edge type: PLACED"]),
        (lambda d: d["node_types"]["Order"]["properties"].pop("total"), ["removed node property: Order.total"]),
        (lambda d: d["edge_types"]["CONTAINS"]["properties"].pop("discount"), ["removed edge property: CONTAINS.discount"]),
        (lambda d: d["node_types"]["Supplier"]["properties"]["solvent"].update(type="int"), ["changed node property type: Supplier.solvent Bool -> Int"]),
        (lambda d: d["edge_types"]["CONTAINS"]["properties"]["quantity"].update(type="int"), ["changed edge property type: CONTAINS.quantity Float -> Int"]),
        (lambda d: d["node_types"]["Part"]["properties"]["brand"].update(required=True), ["node property became required without a default: Part.brand"]),
        (lambda d: d["edge_types"]["CONTAINS"]["properties"]["discount"].update(required=True), ["edge property became required without a default: CONTAINS.discount"]),
        (lambda d: d["edge_types"]["SUPPLIES"].update({"from": "Nation"}), ["edge `from` endpoint narrowed: SUPPLIES"]),
        (lambda d: d["edge_types"]["SUPPLIES"].update(to="Order"), ["edge `to` endpoint narrowed: SUPPLIES"]),
    ],
)
def test_each_kind_of_break(change, want):
    assert evolve(change) == want


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d["node_types"].update(Crate={}),
        lambda d: d["edge_types"]["SUPPLIES"].update({"from": ["Customer", "Supplier"], "to": "*"}),
        lambda d: d["node_types"]["Part"]["properties"]["brand"].update(required=True, default="none"),
        lambda d: d["node_types"]["Part"]["properties"]["name"].update(required=False),
        lambda d: d["node_types"]["Customer"]["properties"]["segment"].update(values=["BUILDING"]),
        lambda d: d["node_types"]["Part"]["properties"]["size"].update(range=[5, 6]),
    ],
)
def test_what_breaks_nothing(change):
    assert evolve(change) == []


def test_several_breaks_come_in_order_of_text():
    got = evolve(lambda d: (d["node_types"].pop("Item"), d["edge_types"].pop("PLACED"), d["node_types"]["Part"]["properties"].pop("size")))
    assert got == sorted(got) and len(got) == 3


def test_any_end_is_wider_than_every_list():
    wide, narrow = (Schema.of({"name": "s", "node_types": {"P": {}}, "edge_types": {"E": {"to": t}}}) for t in ("*", ["P"]))
    assert wide.incompatibilities(narrow) == ["edge `to` endpoint narrowed: E"] and narrow.incompatibilities(wide) == []


# --- reports


def test_lists():
    assert SCHEMA.indexed_properties("Part") == ["brand", "name", "size"] and SCHEMA.indexed_properties("Barrel") == []
    assert SCHEMA.has_indexed_properties("Item") and not SCHEMA.has_indexed_properties("Order")
    assert SCHEMA.inference_edge_types() == ["LIVES_IN", "NATION_IN", "PLACED"] and SCHEMA.inference_edge_types("place") == ["LIVES_IN", "NATION_IN"]
    assert SCHEMA.inference_edge_types(extractable=True) == ["NATION_IN", "PLACED"]


def test_summary():
    lines = SCHEMA.summary().split("\n")
    assert lines[0] == "Schema: orders_graph (v1)" and lines.index("Node Types:") < lines.index("Edge Types:")
    assert "  Part — brand: String, name: String (required), size: Int" in lines and '  SUPPLIES — Single("Supplier") -> Single("Part")' in lines


def test_content_hash_is_that_of_the_canonical_text():
    s = Schema.of({"name": "é", "node_types": {"B": {}, "A": {"properties": {"x": {"type": "int"}}}}})
    text = (
        '{"edge_types":{},"extraction_modes":{},"name":"é","node_types":{"A":{"embedding_field":null,"extraction_hint":null,"properties":'
        '{"x":{"default":null,"indexed":false,"nullable":false,"range":null,"required":false,"type":"int","values":null}},"resolution":null},'
        '"B":{"embedding_field":null,"extraction_hint":null,"properties":{},"resolution":null}},"version":1}'
    )
    assert s.content_hash() == hashlib.sha256(text.encode()).hexdigest()
    other = Schema.of({"name": "é", "node_types": {"A": {"properties": {"x": {"type": "int"}}}, "B": {}}})
    assert other.content_hash() == s.content_hash() != SCHEMA.content_hash()
    assert s.wire("g") == {"id": "g", "wire_version": WIRE_VERSION, "content_hash": s.content_hash(), "schema": s.json()}
