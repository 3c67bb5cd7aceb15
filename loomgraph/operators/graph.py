"""A property graph as DataFrames, and its scans and changes.  A Graph is immutable: changes give a new one."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import COLUMNS, GraphError, Schema
from . import validate


class Tables(Mapping):
    """Tables by name, each made when it is first asked for: a query reads (and plans) those that it needs."""

    def __init__(self, makers: Mapping):
        self._makers = dict(makers._makers) if isinstance(makers, Tables) else dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            t = self._makers[name]
            self._made[name] = t if isinstance(t, DataFrame) else t()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __or__(self, other: Mapping) -> Tables:
        return Tables(self._makers | Tables(other)._makers)

    def same(self, other: Tables, name: str) -> bool:
        """Whether both have the very same table (or maker of it) under the name."""
        return name in other._makers and self._makers[name] is other._makers[name]

    def each(self, change: Callable[[str, DataFrame], DataFrame]) -> Tables:
        return Tables({k: (lambda k=k: change(k, self[k])) for k in self._makers})


@dataclass(frozen=True)
class Graph:
    """nodes: a typed table for each node type, with node_id.  edges: one for each edge type, with from_id and to_id.
    embeddings: for each node type node_id, embedding."""

    schema: Schema
    nodes: Mapping[str, DataFrame] = field(default_factory=dict)
    edges: Mapping[str, DataFrame] = field(default_factory=dict)
    embeddings: Mapping[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("nodes", "edges", "embeddings"):
            object.__setattr__(self, name, Tables(getattr(self, name)))

    # -- scans

    def scan_nodes(self, node_type: str) -> DataFrame | None:
        return self.nodes.get(node_type)

    def nodes_where(self, node_type: str, prop: str, value: object, allow_unindexed: bool = False) -> DataFrame:
        """Equality on a property with an index; empty for others unless allowed.  The filter reaches the scan."""
        table = self.nodes[node_type]
        p = self.schema.node_types[node_type].properties.get(prop)
        if p is None or (not (p.indexed and p.type in ("string", "enum", "datetime", "int", "bool")) and not allow_unindexed):
            return table.limit(0)
        return table.where(F.col(prop) == F.lit(value))

    def list_nodes(self, node_type: str, prop: str | None = None, value: str | None = None) -> DataFrame:
        """By text, as a caller outside gives it."""
        if (prop is None) != (value is None):
            raise GraphError("bad_request", "prop and value go together")
        if prop is None:
            return self.nodes[node_type]
        return self.nodes_where(node_type, prop, coerce(self.schema, node_type, prop, value))

    def get_nodes(self, node_type: str, ids: list[str]) -> DataFrame:
        return self.nodes[node_type].where(F.col("node_id").isin(ids))

    def get_edge(self, edge_type: str, from_id: str, to_id: str) -> DataFrame:
        return self.edges[edge_type].where((F.col("from_id") == from_id) & (F.col("to_id") == to_id))

    def _adjacent(self, column: str, node_id: str, edge_type: str | None) -> DataFrame:
        kinds = [edge_type] if edge_type else sorted(self.edges)
        parts = [self.edges[k].where(F.col(column) == node_id).select(F.lit(k).alias("edge_type"), "from_id", "to_id") for k in kinds]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def outgoing(self, node_id: str, edge_type: str | None = None) -> DataFrame:
        return self._adjacent("from_id", node_id, edge_type)

    def incoming(self, node_id: str, edge_type: str | None = None) -> DataFrame:
        return self._adjacent("to_id", node_id, edge_type)

    def all_edges(self) -> DataFrame:
        out = None
        for k in sorted(self.edges):
            part = self.edges[k].select(F.lit(k).alias("edge_type"), "from_id", "to_id")
            out = part if out is None else out.unionByName(part)
        return out

    def node_ids(self) -> DataFrame:
        out = None
        for k in sorted(self.nodes):
            part = self.nodes[k].select(F.lit(k).alias("node_type"), "node_id")
            out = part if out is None else out.unionByName(part)
        return out

    def count_nodes(self) -> DataFrame:
        return self.node_ids().groupBy("node_type").agg(F.count("*").alias("n"))

    def get_embedding(self, node_type: str, ids: list[str]) -> DataFrame:
        """node_id, embedding of those of the nodes that have one."""
        table = self.embeddings.get(node_type)
        if table is None:
            raise GraphError("unknown_node_type", f"no embeddings of node type {node_type}")
        return table.where(F.col("node_id").isin(ids)).select("node_id", "embedding")

    def existed(self, tables: Mapping, name: str, keys: DataFrame, on: list[str]) -> DataFrame:
        """Each distinct key with whether the table has it: the answer of a delete, asked before it."""
        asked = keys.select(*on).distinct()
        if (table := tables.get(name)) is None:
            return asked.withColumn("existed", F.lit(False))
        here = table.select(*on).distinct().withColumn("_f", F.lit(True))
        return asked.join(here, on, "left").select(*on, F.coalesce("_f", F.lit(False)).alias("existed"))

    def nodes_existed(self, node_type: str, ids: DataFrame) -> DataFrame:
        return self.existed(self.nodes, node_type, ids, ["node_id"])

    def edges_existed(self, edge_type: str, keys: DataFrame) -> DataFrame:
        return self.existed(self.edges, edge_type, keys, ["from_id", "to_id"])

    def embeddings_existed(self, node_type: str, ids: DataFrame) -> DataFrame:
        return self.existed(self.embeddings, node_type, ids, ["node_id"])

    def dangling_edges(self) -> DataFrame:
        """Edges of which an end is no node: each end is joined to the distinct ids, on narrow columns."""
        ids = self.node_ids().select("node_id").distinct()
        marked = self.all_edges().join(ids.withColumn("_f", F.lit(1)), F.col("from_id") == F.col("node_id"), "left").drop("node_id")
        marked = marked.join(ids.withColumn("_t", F.lit(1)), F.col("to_id") == F.col("node_id"), "left").drop("node_id")
        return marked.where("_f is null or _t is null").select("edge_type", "from_id", "to_id")

    def two_hop(self, first: str, second: str, node_id: str | None = None) -> DataFrame:
        """Pairs two steps apart; an equi-join, from one node if given."""
        a = self.edges[first].select("from_id", F.col("to_id").alias("via"))
        a = a.where(F.col("from_id") == node_id) if node_id else a
        return a.join(self.edges[second].select(F.col("from_id").alias("via"), "to_id"), "via").select("from_id", "via", "to_id").distinct()

    # -- changes that are checked against the schema

    def create_nodes(self, node_type: str, rows: DataFrame) -> Written:
        """rows: node_id, properties (JSON text), seq if an id may come again (the last one counts).  Defaults are put
        in; rows that break the schema are refused with every violation, and the others take the place of nodes with
        their ids."""
        checked = validate.validate_nodes(rows, self.schema, node_type)
        good = validate.typed(checked.where(F.size("errors") == 0), self.schema.node_types[node_type])
        stored = latest(good, ["node_id"])
        graph = replace(self, nodes=self.nodes | {node_type: put(self.nodes.get(node_type), stored, ["node_id"])})
        return Written(graph, stored, violations(checked, ["node_id"]))

    def replace_node_properties(self, node_type: str, rows: DataFrame) -> Written:
        """As create_nodes for nodes that are there: the given properties (after defaults) are all that they have then.
        Rows of unknown ids change nothing and are in neither result."""
        if node_type not in self.schema.node_types:
            raise GraphError("unknown_node_type", f"Unknown node type: {node_type}")
        table = self.nodes.get(node_type)
        known = rows.limit(0) if table is None else rows.join(table.select("node_id"), "node_id", "left_semi")
        return self.create_nodes(node_type, known)

    def create_edges(self, rows: DataFrame) -> Written:
        """rows: edge_type, from_type, from_id, to_type, to_id, properties (JSON text), seq as for nodes.  The ends'
        types are checked, then the properties; the ends need not be there, an edge's end is an id alone."""
        keys = ["from_id", "to_id"]
        checked = validate.validate_edges(rows, self.schema)
        good, edges, stored = checked.where(F.size("errors") == 0), self.edges, None
        for kind, declared in sorted(self.schema.edge_types.items()):
            new = latest(validate.typed(good.where(F.col("edge_type") == kind), declared, tuple(keys)), keys)
            edges = edges | {kind: put(self.edges.get(kind), new, keys)}
            own = new.select(F.lit(kind).alias("edge_type"), *keys, F.to_json(F.struct(*[c for c in new.columns if c not in (*keys, "_present", "_extra")])).alias("properties")) if declared.properties else new.select(F.lit(kind).alias("edge_type"), *keys, F.lit("{}").alias("properties"))
            stored = own if stored is None else stored.unionByName(own)
        return Written(replace(self, edges=edges), stored, violations(checked, ["edge_type", *keys]))

    # -- changes of whole rows

    def upsert_nodes(self, node_type: str, rows: DataFrame) -> Graph:
        """Whole rows; they take the place of rows with their ids.  Of rows with one id the last by `seq` counts."""
        return replace(self, nodes=self.nodes | {node_type: upsert(self.nodes[node_type], rows, ["node_id"])})

    def replace_nodes(self, node_type: str, rows: DataFrame) -> Graph:
        """As upsert_nodes, but rows of unknown ids are left out."""
        known = rows.join(self.nodes[node_type].select("node_id"), "node_id", "left_semi")
        return self.upsert_nodes(node_type, known)

    def upsert_edges(self, edge_type: str, rows: DataFrame) -> Graph:
        return replace(self, edges=self.edges | {edge_type: upsert(self.edges[edge_type], rows, ["from_id", "to_id"])})

    def merge_edges(self, edge_type: str, rows: DataFrame) -> Graph:
        """rows: from_id, to_id, _present and values.  What is present overlays (null as well), the rest stays; unknown
        edges are left out."""
        old, keys = self.edges[edge_type], ["from_id", "to_id"]
        rows = latest(rows, keys)
        new = rows.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rows.columns if c not in keys])
        has = lambda c: F.coalesce(F.array_contains("_n__present", c), F.lit(False))
        merged = [c if c in keys or c not in rows.columns else F.when(has(c), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns]
        return replace(self, edges=self.edges | {edge_type: old.join(new, keys, "left").select(*merged)})

    def delete_edges(self, edge_type: str, keys: DataFrame) -> Graph:
        return replace(self, edges=self.edges | {edge_type: self.edges[edge_type].join(keys, ["from_id", "to_id"], "left_anti")})

    def delete_nodes(self, node_type: str, ids: DataFrame) -> Graph:
        """ids: node_id.  Takes the nodes' edges in both directions and their embeddings along, also of ids that are no
        nodes (an edge's end is an id alone)."""
        gone = ids.select("node_id").distinct()
        drop = lambda t, c: t.join(gone.withColumnRenamed("node_id", c), c, "left_anti").select(*t.columns)
        return replace(
            self, nodes=self.nodes | {node_type: drop(self.nodes[node_type], "node_id")},
            edges=self.edges.each(lambda _, e: drop(drop(e, "from_id"), "to_id")),
            embeddings=self.embeddings.each(lambda k, e: drop(e, "node_id") if k == node_type else e),
        )

    def set_embeddings(self, node_type: str, rows: DataFrame) -> Graph:
        """rows: node_id, embedding.  Empty vectors and ids without a node are left out; others take the old ones'
        place.  All vectors of a type have the length of those stored."""
        stored = self.embeddings.get(node_type)
        good = rows.where(F.size("embedding") > 0).join(self.nodes[node_type].select("node_id"), "node_id", "left_semi")
        if stored is not None and (one := stored.select(F.size("embedding").alias("n")).head()) is not None:
            if good.where(F.size("embedding") != one["n"]).limit(1).count():
                raise GraphError("bad_request", f"embedding dimension is not {one['n']}")
        base = stored if stored is not None else good.limit(0)
        return replace(self, embeddings=self.embeddings | {node_type: upsert(base, good, ["node_id"])})

    def delete_embeddings(self, node_type: str, ids: DataFrame) -> Graph:
        return replace(self, embeddings=self.embeddings | {node_type: self.embeddings[node_type].join(ids, "node_id", "left_anti")})

    def with_schema(self, schema: Schema) -> Graph:
        """Refuses a schema that breaks stored data; new properties of stored rows are null."""
        schema.validate()
        if wrong := self.schema.incompatibilities(schema):
            raise GraphError("bad_request", "; ".join(wrong))
        return replace(self, schema=schema).widened()

    def widened(self) -> Graph:
        """With a null column for each declared property that a stored table has no column for; a table that has them all
        stays the same table."""

        def widen(tables: Tables, types: dict) -> dict:
            def made(name: str) -> DataFrame:
                t, p = tables[name], types[name].properties if name in types else {}
                missing = {k: F.lit(None).cast(COLUMNS[d.type]) for k, d in p.items() if k not in t.columns}
                return t.withColumns(missing) if missing else t

            return {k: (lambda k=k: made(k)) for k in tables}

        return replace(self, nodes=widen(self.nodes, self.schema.node_types), edges=widen(self.edges, self.schema.edge_types))

    # -- batches

    def batch(self) -> Batch:
        return Batch(self)


@dataclass(frozen=True)
class Written:
    """What a checked change gives: the graph after it, the rows as stored, and the violations (keys, property, message)
    of those that were refused."""

    graph: Graph
    stored: DataFrame | None
    refused: DataFrame


def violations(checked: DataFrame, keys: list[str]) -> DataFrame:
    return checked.select(*keys, F.explode("errors").alias("_e")).select(*keys, "_e.property", "_e.message")


def put(old: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the place of those with their keys.  A table that has no columns for absent and undeclared properties
    yet gets them."""
    if old is None:
        return rows
    kept = old.join(rows.select(*keys), keys, "left_anti")
    for c in rows.columns:
        if c not in kept.columns:
            kept = kept.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    return kept.unionByName(rows, allowMissingColumns=True)


class Batch:
    """Changes that are seen by nobody until commit(), in order."""

    def __init__(self, graph: Graph):
        self.graph, self.ops = graph, []

    def add(self, method: str, *args) -> Batch:
        self.ops.append((method, args))
        return self

    def commit(self) -> tuple[Graph, int]:
        out = self.graph
        for method, args in self.ops:
            out = getattr(out, method)(*args)
        n, self.ops = len(self.ops), []
        return out, n

    def discard(self) -> Graph:
        self.ops = []
        return self.graph


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by seq (which goes), where there is one."""
    if "seq" not in rows.columns:
        return rows.dropDuplicates(keys)
    values = [c for c in rows.columns if c not in (*keys, "seq")]
    if not values:
        return rows.select(*keys).distinct()
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("_v"))
    return out.select(*keys, "_v.*")


def upsert(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    rows = latest(rows, keys)
    return old.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True).select(*old.columns)


def coerce(schema: Schema, node_type: str, prop: str, text: str) -> object:
    """A property's value from text."""
    n = schema.node_types.get(node_type)
    if n is None:
        raise GraphError("bad_request", f"Unknown node type: {node_type}")
    p = n.properties.get(prop)
    if p is None:
        raise GraphError("bad_request", f"unknown property {node_type}.{prop}")
    if p.type in ("string", "enum", "datetime"):
        return text
    if p.type == "int":
        if not re.fullmatch(r"[+-]?[0-9]+", text) or not -(1 << 63) <= int(text) < 1 << 63:
            raise GraphError("bad_request", f"{text!r} is not a whole number of 64 bits")
        return int(text)
    if p.type == "bool" and text in ("true", "false"):
        return text == "true"
    raise GraphError("bad_request", f"{node_type}.{prop} can't be filtered by {text!r}")
