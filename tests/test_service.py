"""Verbs and paths: statuses, bodies, and what comes first of several errors."""

import pytest

from loomgraph.service import Service
from loomgraph.sources.store import Registry

SHOP = {
    "name": "shop",
    "node_types": {"Lamp": {"properties": {"name": {"type": "string", "required": True}, "watts": {"type": "int", "indexed": True, "range": [1, 100]}, "fitting": {"type": "string", "default": "E27"}, "price": {"type": "float"}}}, "Room": {}},
    "edge_types": {"LIGHTS": {"from": "Lamp", "to": "Room", "properties": {"hours": {"type": "float"}}}},
}


@pytest.fixture
def call(spark, tmp_path):
    service = Service(Registry(spark, str(tmp_path)))
    assert service.call("POST", "/v1/graphs", body={"id": "g", "schema": SHOP})[0] == 201
    return service.call


def test_graphs_and_schemas(call):
    assert call("GET", "/health")[0] == call("GET", "/ready")[0] == 200
    assert call("GET", "/v1/graphs") == (200, {"graphs": ["g"]})
    for body, status in (({"id": "g", "schema": SHOP}, 409), ({"id": "a b", "schema": SHOP}, 400), ({"id": "x"}, 400), ({"id": "x", "schema": {"name": "s", "edge_types": {"E": {"to": "Nowhere"}}}}, 400)):
        assert call("POST", "/v1/graphs", body=body)[0] == status
    wire = call("GET", "/v1/graphs/g/schema")[1]
    assert wire["schema"]["name"] == "shop" and call("GET", "/v1/graphs/g")[1] == {k: wire[k] for k in ("id", "wire_version", "content_hash")}
    more = wire["schema"] | {"version": 2}
    assert call("PUT", "/v1/graphs/g/schema", body={"schema": more})[1]["content_hash"] != wire["content_hash"]
    assert call("PUT", "/v1/graphs/g/schema", body={"schema": {"name": "shop"}})[0] == 400
    assert call("PUT", "/v1/graphs/none/schema", body={})[0] == 404
    assert call("DELETE", "/v1/graphs/g") == (204, None) and call("GET", "/v1/graphs/g")[0] == 404
    assert call("PATCH", "/v1/graphs")[0] == 405 and call("GET", "/v2")[0] == 404


def test_nodes(call):
    at = "/v1/graphs/g/nodes"
    assert call("GET", at, {"type": "Lamp"}) == (200, {"nodes": []})
    made = call("POST", at, body={"node_type": "Lamp", "node_id": "a", "properties": {"name": "desk", "watts": 7, "colour": ["red"]}})
    assert made == (201, {"node_type": "Lamp", "node_id": "a", "properties": {"name": "desk", "watts": 7, "fitting": "E27", "colour": ["red"]}})
    for body in ({"node_type": "Lamp", "node_id": "b", "properties": {}}, {"node_type": "Lamp", "node_id": "b", "properties": {"name": "x", "watts": 101}}, {"node_type": "Fan", "node_id": "b"}, {"node_id": "b"}):
        assert call("POST", at, body=body)[0] == 400
    assert call("GET", f"{at}/Lamp/a")[1] == made[1] and call("GET", f"{at}/Lamp/b")[0] == call("GET", f"{at}/Fan/a")[0] == 404
    assert call("PUT", f"{at}/Lamp/a", body={"properties": {"name": "floor", "price": None}})[1]["properties"] == {"name": "floor", "price": None, "fitting": "E27"}
    assert call("PUT", f"{at}/Lamp/b", body={"properties": {}})[0] == 404 and call("PUT", f"{at}/Lamp/a", body={"properties": {}})[0] == 400
    call("POST", at, body={"node_type": "Lamp", "node_id": "c", "properties": {"name": "wall", "watts": 9}})
    ids = lambda q: [n["node_id"] for n in call("GET", at, q)[1]["nodes"]]
    assert ids({"type": "Lamp"}) == ["a", "c"] and ids({"type": "Lamp", "prop": "watts", "value": "9"}) == ["c"] and ids({"type": "Lamp", "prop": "watts", "value": "8"}) == []
    for q in ({}, {"type": "Lamp", "prop": "watts"}, {"type": "Lamp", "prop": "watts", "value": "many"}, {"type": "Lamp", "prop": "price", "value": "1.0"}, {"type": "Lamp", "prop": "none", "value": "1"}, {"type": "Fan", "prop": "x", "value": "1"}, {"type": "Room", "prop": "x", "value": "1"}):
        assert call("GET", at, q)[0] == 400
    assert call("DELETE", f"{at}/Lamp/a") == (204, None) and call("DELETE", f"{at}/Lamp/a")[0] == 404
    assert call("GET", "/v1/graphs/none/nodes", {})[0] == 404  # the graph comes before the query


def test_edges_and_vectors(call):
    for i in ("a", "b"):
        call("POST", "/v1/graphs/g/nodes", body={"node_type": "Lamp", "node_id": i, "properties": {"name": i}})
    at, one = "/v1/graphs/g/edges", {"edge_type": "LIGHTS", "from_type": "Lamp", "from_id": "a", "to_type": "Room", "to_id": "hall", "properties": {"hours": 2.5}}
    assert call("POST", at, body=one) == (201, {"edge_type": "LIGHTS", "from_id": "a", "to_id": "hall", "properties": {"hours": 2.5}})
    for change in ({"edge_type": "HEATS"}, {"from_type": "Room"}, {"properties": {"hours": "long"}}):
        assert call("POST", at, body=one | change)[0] == 400
    here = f"{at}/LIGHTS/a/hall"
    assert call("PATCH", here, body={"properties": {"note": "dim"}})[1]["properties"] == {"hours": 2.5, "note": "dim"}
    assert call("PATCH", here, body={"properties": {"hours": None}})[1] == call("GET", here)[1] and call("GET", here)[1]["properties"] == {"hours": None, "note": "dim"}
    assert call("PATCH", here, body={"properties": {"hours": "x"}})[0] == 400 and call("PATCH", f"{at}/LIGHTS/a/attic", body={})[0] == call("GET", f"{at}/HEATS/a/hall")[0] == 404
    nodes, similar = "/v1/graphs/g/nodes/Lamp", lambda v, k=2, t="Lamp": call("POST", "/v1/graphs/g/similar", body={"embedding": v, "top_k": k, "node_type": t})
    assert similar([1.0]) == (200, {"results": []}) and call("GET", f"{nodes}/a/embedding")[0] == 404
    assert call("PUT", f"{nodes}/a/embedding", body={"embedding": [1.0, 0.0]})[0] == call("PUT", f"{nodes}/b/embedding", body={"embedding": [0.0, 2.0]})[0] == 200
    assert call("PUT", f"{nodes}/zz/embedding", body={"embedding": [1.0, 0.0]})[0] == 404 and call("PUT", f"{nodes}/zz/embedding", body={"embedding": [1.0]})[0] == 400
    assert call("GET", f"{nodes}/b/embedding")[1]["embedding"] == [0.0, 2.0]
    assert [h["node_id"] for h in similar([0.1, 1.0])[1]["results"]] == ["b", "a"]
    for args in (([],), ([1.0, 0.0], 0), ([1.0, 0.0], 1, "Fan"), ([1.0],)):
        assert similar(*args)[0] == 400
    assert call("DELETE", f"{nodes}/b/embedding") == (204, None) and call("DELETE", f"{nodes}/b/embedding")[0] == 404
    assert call("DELETE", f"{nodes}/a") == (204, None) and call("GET", here)[0] == 404 and similar([1.0, 0.0])[1]["results"] == []
    assert call("DELETE", here)[0] == 404
