"""Schemas of property graphs: typed, declared at run time, strict for declared properties and open for others."""

from __future__ import annotations

import copy
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: The declared types, their names in messages, and the columns that hold them.
TYPES = {"string": "String", "int": "Int", "float": "Float", "bool": "Bool", "datetime": "Datetime", "enum": "Enum", "list:string": "ListString"}
COLUMNS = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.StringType(), "enum": T.StringType(), "list:string": T.ArrayType(T.StringType())}
STRATEGIES = ("fuzzy_then_vector", "exact", "fuzzy_only", "vector_only")
ANY = "*"
#: Version of the shapes that callers outside get.
WIRE_VERSION = "0.2.0"


class GraphError(Exception):
    """kind: validation, edge_validation, not_found, invalid_edge, unknown_node_type, unknown_edge_type, conflict,
    bad_request."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Property:
    type: str = "string"
    required: bool = False
    indexed: bool = False
    nullable: bool = False
    default: object = None
    has_default: bool = False
    values: list[str] | None = None
    range: tuple[float, float] | None = None
    description: str | None = None

    @classmethod
    def of(cls, d: dict) -> Property:
        kind = d.get("type", "string")
        if kind not in TYPES:
            raise GraphError("validation", f"unknown property type {kind!r}")
        bounds = d.get("range")
        return cls(kind, bool(d.get("required", False)), bool(d.get("indexed", False)), bool(d.get("nullable", False)), d.get("default"), d.get("default") is not None, d.get("values"), tuple(map(float, bounds)) if bounds else None, d.get("description"))

    def json(self) -> dict:
        out = {"type": self.type, "required": self.required, "indexed": self.indexed, "nullable": self.nullable, "default": self.default, "values": self.values, "range": list(self.range) if self.range else None}
        return out | ({"description": self.description} if self.description is not None else {})


@dataclass
class NodeType:
    properties: dict[str, Property] = field(default_factory=dict)
    embedding_field: str | None = None
    resolution: dict | None = None
    extraction_hint: str | None = None

    @classmethod
    def of(cls, d: dict | None) -> NodeType:
        d = d or {}
        r = d.get("resolution")
        if r is not None:
            r = {"strategy": "fuzzy_then_vector", "fuzzy_threshold": 70, "vector_threshold": 0.85, "auto_merge_threshold": 90} | r
            if r["strategy"] not in STRATEGIES:
                raise GraphError("validation", f"unknown resolution strategy {r['strategy']!r}")
        return cls({k: Property.of(v or {}) for k, v in (d.get("properties") or {}).items()}, d.get("embedding_field"), r, d.get("extraction_hint"))

    def json(self) -> dict:
        return {"properties": {k: v.json() for k, v in self.properties.items()}, "embedding_field": self.embedding_field, "resolution": self.resolution, "extraction_hint": self.extraction_hint}

    def struct(self) -> T.StructType:
        return struct_of(self.properties)


def struct_of(properties: dict[str, Property]) -> T.StructType:
    return T.StructType([T.StructField(k, COLUMNS[p.type]) for k, p in sorted(properties.items())])


@dataclass
class EdgeType:
    source: str | list[str] = ANY
    target: str | list[str] = ANY
    properties: dict[str, Property] = field(default_factory=dict)
    extraction_hint: str | None = None
    inference_category: str | None = None
    pass_1_extractable: bool = False

    @classmethod
    def of(cls, d: dict | None) -> EdgeType:
        d = d or {}
        return cls(d.get("from", ANY), d.get("to", ANY), {k: Property.of(v or {}) for k, v in (d.get("properties") or {}).items()}, d.get("extraction_hint"), d.get("inference_category"), bool(d.get("pass_1_extractable", False)))

    def json(self) -> dict:
        return {"from": self.source, "to": self.target, "properties": {k: v.json() for k, v in self.properties.items()}, "extraction_hint": self.extraction_hint, "inference_category": self.inference_category, "pass_1_extractable": self.pass_1_extractable}

    def struct(self) -> T.StructType:
        return struct_of(self.properties)


def names_of(end: str | list[str]) -> list[str]:
    return [end] if isinstance(end, str) else list(end)


def accepts(end: str | list[str], node_type: str) -> bool:
    return ANY in names_of(end) or node_type in names_of(end)


def widens(old: str | list[str], new: str | list[str]) -> bool:
    """Whether everything that old accepts is accepted by new."""
    return ANY in names_of(new) or (ANY not in names_of(old) and set(names_of(old)) <= set(names_of(new)))


@dataclass
class Schema:
    name: str
    version: int = 1
    node_types: dict[str, NodeType] = field(default_factory=dict)
    edge_types: dict[str, EdgeType] = field(default_factory=dict)
    extraction_modes: dict[str, dict] = field(default_factory=dict)

    # -- reading

    @classmethod
    def of(cls, d: dict, check: bool = True) -> Schema:
        modes = {k: {"include": ANY, "max_tokens": 4096} | (v or {}) for k, v in (d.get("extraction_modes") or {}).items()}
        s = cls(d["name"], int(d.get("version", 1)), {k: NodeType.of(v) for k, v in (d.get("node_types") or {}).items()}, {k: EdgeType.of(v) for k, v in (d.get("edge_types") or {}).items()}, modes)
        if check:
            s.validate()
        return s

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls.of(json.loads(text))

    @classmethod
    def from_yaml(cls, text: str, check: bool = True) -> Schema:
        import yaml

        d = yaml.safe_load(text)
        return cls.of(d.get("schema", d), check)

    @classmethod
    def from_yamls(cls, texts: list[str]) -> Schema:
        """The first, with the others laid over it; checked once, as a whole."""
        if not texts:
            raise GraphError("validation", "no schema given")
        out, *rest = (cls.from_yaml(t, check=False) for t in texts)
        for s in rest:
            out = out.merge(s)
        out.validate()
        return out

    # -- changing

    def merge(self, over: Schema) -> Schema:
        """What is there stays; new types and properties are added; hints and the like are taken from `over`."""
        out = copy.deepcopy(self)
        for k, n in over.node_types.items():
            if (own := out.node_types.get(k)) is None:
                out.node_types[k] = copy.deepcopy(n)
                continue
            own.properties = copy.deepcopy(n.properties) | own.properties
            for a in ("embedding_field", "resolution", "extraction_hint"):
                setattr(own, a, getattr(n, a) if getattr(n, a) is not None else getattr(own, a))
        for k, e in over.edge_types.items():
            if (own := out.edge_types.get(k)) is None:
                out.edge_types[k] = copy.deepcopy(e)
                continue
            own.properties = copy.deepcopy(e.properties) | own.properties
            for a in ("extraction_hint", "inference_category"):
                setattr(own, a, getattr(e, a) if getattr(e, a) is not None else getattr(own, a))
            own.pass_1_extractable |= e.pass_1_extractable
        out.extraction_modes |= copy.deepcopy(over.extraction_modes)
        return out

    def ensure_node_type(self, name: str, d: dict | None = None) -> bool:
        if name in self.node_types:
            return False
        self.node_types[name] = NodeType.of(d)
        return True

    def ensure_edge_type(self, name: str, d: dict | None = None) -> bool:
        if name in self.edge_types:
            return False
        self.edge_types[name] = EdgeType.of(d)
        return True

    def ensure_node_property(self, node_type: str, name: str, d: dict) -> bool:
        if node_type not in self.node_types:
            raise GraphError("unknown_node_type", f"Unknown node type: {node_type}")
        if name in self.node_types[node_type].properties:
            return False
        self.node_types[node_type].properties[name] = Property.of(d)
        return True

    # -- checks

    def validate(self) -> None:
        for name, e in sorted(self.edge_types.items()):
            for end in (e.source, e.target):
                for n in names_of(end):
                    if n != ANY and n not in self.node_types:
                        raise GraphError("validation", f"edge type {name} names the unknown node type {n}")

    def validate_edge(self, edge_type: str, from_type: str, to_type: str) -> None:
        e = self.edge_types.get(edge_type)
        if e is None:
            raise GraphError("unknown_edge_type", f"Unknown edge type: {edge_type}")
        if not (accepts(e.source, from_type) and accepts(e.target, to_type)):
            raise GraphError("invalid_edge", f"Invalid edge: {edge_type} cannot connect {from_type} to {to_type}")

    def incompatibilities(self, new: Schema) -> list[str]:
        """What stored data would break under the new schema, in order of text; empty if nothing."""
        out = []
        for label, old_types, new_types in (("node", self.node_types, new.node_types), ("edge", self.edge_types, new.edge_types)):
            for t, old in old_types.items():
                if t not in new_types:
                    out.append(f"removed {label} type: {t}")
                    continue
                now = new_types[t]
                for p, was in old.properties.items():
                    if p not in now.properties:
                        out.append(f"removed {label} property: {t}.{p}")
                    elif now.properties[p].type != was.type:
                        out.append(f"changed {label} property type: {t}.{p} {TYPES[was.type]} -> {TYPES[now.properties[p].type]}")
                for p, q in now.properties.items():
                    was = old.properties.get(p)
                    if q.required and not q.has_default and not (was and was.required):
                        out.append(f"{label} property became required without a default: {t}.{p}")
                if label == "edge":
                    out += [f"edge `{side}` endpoint narrowed: {t}" for side, a, b in (("from", old.source, now.source), ("to", old.target, now.target)) if not widens(a, b)]
        return sorted(out)

    # -- reports

    def indexed_properties(self, node_type: str) -> list[str]:
        n = self.node_types.get(node_type)
        return sorted(k for k, p in n.properties.items() if p.indexed) if n else []

    def has_indexed_properties(self, node_type: str) -> bool:
        return bool(self.indexed_properties(node_type))

    def inference_edge_types(self, category: str | None = None, extractable: bool = False) -> list[str]:
        return sorted(k for k, e in self.edge_types.items() if e.inference_category is not None and (category is None or e.inference_category == category) and (not extractable or e.pass_1_extractable))

    def json(self) -> dict:
        return {"name": self.name, "version": self.version, "node_types": {k: v.json() for k, v in self.node_types.items()}, "edge_types": {k: v.json() for k, v in self.edge_types.items()}, "extraction_modes": self.extraction_modes}

    def wire(self, graph_id: str) -> dict:
        """The schema as a caller outside gets it, with what it compares against: our version and the content's hash."""
        return {"id": graph_id, "wire_version": WIRE_VERSION, "content_hash": self.content_hash(), "schema": self.json()}

    def content_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.json(), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def summary(self) -> str:
        """For a reader or a prompt: types and properties by name."""
        show = lambda end: f'Single("{end}")' if isinstance(end, str) else "Multiple([" + ", ".join(f'"{x}"' for x in end) + "])"
        nodes = [f"  {k} — " + ", ".join(f"{p}: {TYPES[d.type]}{' (required)' if d.required else ''}" for p, d in sorted(n.properties.items())) for k, n in sorted(self.node_types.items())]
        edges = [f"  {k} — {show(e.source)} -> {show(e.target)}" for k, e in sorted(self.edge_types.items())]
        return "\n".join([f"Schema: {self.name} (v{self.version})", "", "Node Types:", *nodes, "", "Edge Types:", *edges])
