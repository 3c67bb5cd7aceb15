"""Graphs by verbs and paths, as callers outside see them: each call gives a status and a body, without a network.

Changes of one node, edge or vector become the graph's next state.  What is wrong with a call is found in one order: the
graph, the body, the type, then what is stored.  For many rows at once the methods of Graph are the way."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from .operators import search, validate
from .operators.graph import Graph, Written, put
from .plans.schema import GraphError, Schema
from .sources.store import Registry

#: The status of each kind of error; any other is ours (500).
STATUS = {"conflict": 409, "not_found": 404, "bad_request": 400, "validation": 400, "edge_validation": 400, "invalid_edge": 400, "unknown_node_type": 400, "unknown_edge_type": 400}

Answer = tuple[int, dict | None]
ROUTES: list[tuple[str, re.Pattern, Callable]] = []


def route(verb: str, path: str):
    """path: names in braces stand for one step of the path each."""

    def keep(f: Callable) -> Callable:
        ROUTES.append((verb, re.compile(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path)), f))
        return f

    return keep


def properties_of(row: Row, declared: dict) -> dict:
    """A stored row's properties: those that were given or filled in, with nulls and undeclared ones; of a row that came
    with its table, all that aren't null."""
    d = row.asDict()
    if d.get("_present") is None:
        return {k: d[k] for k in sorted(declared) if d.get(k) is not None}
    extra = d.get("_extra") or {}
    return {k: d[k] if k in declared else json.loads(extra[k]) if extra.get(k) is not None else None for k in d["_present"]}


def first(table: DataFrame | None) -> Row | None:
    return table.head() if table is not None else None


def checked(done: Written) -> Graph:
    """The graph after a change of one row, or its first violation."""
    if (wrong := done.refused.orderBy("property").head()) is not None:
        raise GraphError("validation", wrong["message"] if wrong["property"] is None else f"{wrong['property']}: {wrong['message']}")
    return done.graph


class Service:
    def __init__(self, registry: Registry):
        self.registry, self.spark = registry, registry.spark

    def call(self, verb: str, path: str, query: dict | None = None, body: dict | None = None) -> Answer:
        """Status and body; the body of an error has its kind and message."""
        for v, pattern, f in ROUTES:
            if v == verb and (m := pattern.fullmatch(path)):
                try:
                    return f(self, **m.groupdict(), **({"query": query or {}} if "query" in f.__code__.co_varnames[: f.__code__.co_argcount] else {}), **({"body": body or {}} if "body" in f.__code__.co_varnames[: f.__code__.co_argcount] else {}))
                except GraphError as e:
                    return STATUS.get(e.kind, 500), {"error": e.kind, "message": str(e)}
        known = any(p.fullmatch(path) for _, p, _ in ROUTES)
        return (405 if known else 404), {"error": "not_found", "message": f"no {verb} {path}"}

    # -- what handlers share

    @staticmethod
    def given(body: dict, *names: str) -> list:
        if missing := [n for n in names if n not in body]:
            raise GraphError("bad_request", f"missing: {', '.join(missing)}")
        return [body[n] for n in names]

    def one(self, schema: str, *values) -> DataFrame:
        return self.spark.createDataFrame([values], schema)

    def node(self, g: Graph, kind: str, node_id: str) -> Row:
        row = first(g.get_nodes(kind, [node_id])) if kind in g.nodes else None
        if row is None:
            raise GraphError("not_found", f"node {kind}/{node_id} not found")
        return row

    def edge(self, g: Graph, kind: str, a: str, b: str) -> Row:
        row = first(g.get_edge(kind, a, b)) if kind in g.edges else None
        if row is None:
            raise GraphError("not_found", f"edge {kind}/{a}/{b} not found")
        return row

    def vector(self, g: Graph, kind: str, node_id: str) -> Row:
        row = first(g.get_embedding(kind, [node_id])) if kind in g.embeddings else None
        if row is None:
            raise GraphError("not_found", f"node {kind}/{node_id} has no embedding")
        return row

    @staticmethod
    def node_body(g: Graph, kind: str, row: Row) -> dict:
        return {"node_type": kind, "node_id": row["node_id"], "properties": properties_of(row, g.schema.node_types[kind].properties)}

    @staticmethod
    def edge_body(g: Graph, kind: str, row: Row) -> dict:
        return {"edge_type": kind, "from_id": row["from_id"], "to_id": row["to_id"], "properties": properties_of(row, g.schema.edge_types[kind].properties)}

    # -- graphs and schemas

    @route("GET", "/health")
    @route("GET", "/ready")
    def health(self) -> Answer:
        return 200, {"status": "ok"}

    @route("GET", "/v1/graphs")
    def graphs(self) -> Answer:
        return 200, {"graphs": self.registry.list_ids()}

    @route("POST", "/v1/graphs")
    def create_graph(self, body: dict) -> Answer:
        graph_id, schema = self.given(body, "id", "schema")
        return 201, self.registry.create(graph_id, Schema.of(schema)).schema.wire(graph_id)

    @route("GET", "/v1/graphs/{graph_id}")
    def graph(self, graph_id: str) -> Answer:
        wire = self.registry.get(graph_id).schema.wire(graph_id)
        return 200, {k: wire[k] for k in ("id", "wire_version", "content_hash")}

    @route("DELETE", "/v1/graphs/{graph_id}")
    def delete_graph(self, graph_id: str) -> Answer:
        self.registry.delete(graph_id)
        return 204, None

    @route("GET", "/v1/graphs/{graph_id}/schema")
    def schema(self, graph_id: str) -> Answer:
        return 200, self.registry.get(graph_id).schema.wire(graph_id)

    @route("PUT", "/v1/graphs/{graph_id}/schema")
    def replace_schema(self, graph_id: str, body: dict) -> Answer:
        self.registry.get(graph_id)
        return 200, self.registry.replace_schema(graph_id, Schema.of(self.given(body, "schema")[0])).schema.wire(graph_id)

    # -- nodes

    @route("GET", "/v1/graphs/{graph_id}/nodes")
    def nodes(self, graph_id: str, query: dict) -> Answer:
        g = self.registry.get(graph_id)
        (kind,) = self.given(query, "type")
        if ("prop" in query) != ("value" in query):
            raise GraphError("bad_request", "prop and value go together")
        if "prop" in query and kind not in g.nodes:  # what is asked is checked though nothing is stored
            g = Graph(g.schema, {kind: self.one("node_id string", "").limit(0)}).widened() if kind in g.schema.node_types else g
        if kind not in g.nodes:
            if "prop" in query:
                raise GraphError("bad_request", f"unknown node type: {kind}")
            return 200, {"nodes": []}
        rows = g.list_nodes(kind, query.get("prop"), query.get("value")).orderBy("node_id")
        return 200, {"nodes": [self.node_body(g, kind, r) for r in rows.collect()]}

    @route("POST", "/v1/graphs/{graph_id}/nodes")
    def create_node(self, graph_id: str, body: dict) -> Answer:
        g = self.registry.get(graph_id)
        kind, node_id = self.given(body, "node_type", "node_id")
        g = self.registry.save(graph_id, checked(g.create_nodes(kind, self.one("node_id string, properties string", node_id, json.dumps(body.get("properties") or {})))))
        return 201, self.node_body(g, kind, self.node(g, kind, node_id))

    @route("GET", "/v1/graphs/{graph_id}/nodes/{kind}/{node_id}")
    def get_node(self, graph_id: str, kind: str, node_id: str) -> Answer:
        g = self.registry.get(graph_id)
        return 200, self.node_body(g, kind, self.node(g, kind, node_id))

    @route("PUT", "/v1/graphs/{graph_id}/nodes/{kind}/{node_id}")
    def replace_node(self, graph_id: str, kind: str, node_id: str, body: dict) -> Answer:
        g = self.registry.get(graph_id)
        self.node(g, kind, node_id)
        g = self.registry.save(graph_id, checked(g.replace_node_properties(kind, self.one("node_id string, properties string", node_id, json.dumps(body.get("properties") or {})))))
        return 200, self.node_body(g, kind, self.node(g, kind, node_id))

    @route("DELETE", "/v1/graphs/{graph_id}/nodes/{kind}/{node_id}")
    def delete_node(self, graph_id: str, kind: str, node_id: str) -> Answer:
        g = self.registry.get(graph_id)
        self.node(g, kind, node_id)
        self.registry.save(graph_id, g.delete_nodes(kind, self.one("node_id string", node_id)))
        return 204, None

    # -- edges

    @route("POST", "/v1/graphs/{graph_id}/edges")
    def create_edge(self, graph_id: str, body: dict) -> Answer:
        g = self.registry.get(graph_id)
        kind, from_type, a, to_type, b = self.given(body, "edge_type", "from_type", "from_id", "to_type", "to_id")
        g.schema.validate_edge(kind, from_type, to_type)
        columns = "edge_type string, from_type string, from_id string, to_type string, to_id string, properties string"
        g = self.registry.save(graph_id, checked(g.create_edges(self.one(columns, kind, from_type, a, to_type, b, json.dumps(body.get("properties") or {})))))
        return 201, self.edge_body(g, kind, self.edge(g, kind, a, b))

    @route("GET", "/v1/graphs/{graph_id}/edges/{kind}/{a}/{b}")
    def get_edge(self, graph_id: str, kind: str, a: str, b: str) -> Answer:
        g = self.registry.get(graph_id)
        return 200, self.edge_body(g, kind, self.edge(g, kind, a, b))

    @route("PATCH", "/v1/graphs/{graph_id}/edges/{kind}/{a}/{b}")
    def merge_edge(self, graph_id: str, kind: str, a: str, b: str, body: dict) -> Answer:
        """What is given overlays (null as well), the rest stays.  Values must fit the columns of declared properties."""
        g = self.registry.get(graph_id)
        declared = g.schema.edge_types[kind].properties if kind in g.schema.edge_types else {}
        merged = properties_of(self.edge(g, kind, a, b), declared) | (body.get("properties") or {})
        new = validate.typed(self.one("from_id string, to_id string, properties string", a, b, json.dumps(merged)), g.schema.edge_types[kind], ("from_id", "to_id"))
        if properties_of(new.head(), declared) != merged:
            raise GraphError("validation", "a value doesn't fit its property's type")
        g = self.registry.save(graph_id, Graph(g.schema, g.nodes, g.edges | {kind: put(g.edges[kind], new, ["from_id", "to_id"])}, g.embeddings))
        return 200, self.edge_body(g, kind, self.edge(g, kind, a, b))

    @route("DELETE", "/v1/graphs/{graph_id}/edges/{kind}/{a}/{b}")
    def delete_edge(self, graph_id: str, kind: str, a: str, b: str) -> Answer:
        g = self.registry.get(graph_id)
        self.edge(g, kind, a, b)
        self.registry.save(graph_id, g.delete_edges(kind, self.one("from_id string, to_id string", a, b)))
        return 204, None

    # -- vectors

    @route("GET", "/v1/graphs/{graph_id}/nodes/{kind}/{node_id}/embedding")
    def get_embedding(self, graph_id: str, kind: str, node_id: str) -> Answer:
        row = self.vector(self.registry.get(graph_id), kind, node_id)
        return 200, {"node_type": kind, "node_id": node_id, "embedding": list(row["embedding"])}

    @route("PUT", "/v1/graphs/{graph_id}/nodes/{kind}/{node_id}/embedding")
    def set_embedding(self, graph_id: str, kind: str, node_id: str, body: dict) -> Answer:
        g = self.registry.get(graph_id)
        (vector,) = self.given(body, "embedding")
        rows = self.one("node_id string, embedding array<float>", node_id, [float(x) for x in vector])
        if (one := first(g.embeddings.get(kind))) is not None and len(one["embedding"]) != len(vector):  # before anything else that is stored
            raise GraphError("bad_request", f"embedding dimension is not {len(one['embedding'])}")
        if not vector:
            raise GraphError("validation", "embedding must not be empty")
        self.node(g, kind, node_id)
        self.registry.save(graph_id, g.set_embeddings(kind, rows))
        return 200, {"node_type": kind, "node_id": node_id, "embedding": [float(x) for x in vector]}

    @route("DELETE", "/v1/graphs/{graph_id}/nodes/{kind}/{node_id}/embedding")
    def delete_embedding(self, graph_id: str, kind: str, node_id: str) -> Answer:
        g = self.registry.get(graph_id)
        self.vector(g, kind, node_id)
        self.registry.save(graph_id, g.delete_embeddings(kind, self.one("node_id string", node_id)))
        return 204, None

    @route("POST", "/v1/graphs/{graph_id}/similar")
    def similar(self, graph_id: str, body: dict) -> Answer:
        g = self.registry.get(graph_id)
        vector, k, kind = self.given(body, "embedding", "top_k", "node_type")
        if not vector:
            raise GraphError("bad_request", "the query vector is empty")
        if k <= 0:
            raise GraphError("bad_request", "top_k must be positive")
        if kind not in g.schema.node_types:
            raise GraphError("bad_request", f"unknown node type: {kind}")
        if (one := first(g.embeddings.get(kind))) is None:
            return 200, {"results": []}
        if len(one["embedding"]) != len(vector):
            raise GraphError("bad_request", f"embedding dimension is not {len(one['embedding'])}")
        return 200, {"results": [{"node_id": r["node_id"], "score": r["score"]} for r in search.similar(g.embeddings[kind], vector, k).collect()]}
