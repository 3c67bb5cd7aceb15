"""Validation of node and edge properties, given as JSON text, without leaving the JVM: defaults, then required
properties, then values; every violation is reported, in order of property."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import TYPES, EdgeType, GraphError, NodeType, Property, Schema, accepts

ERROR = "struct<property:string,message:string>"


def parsed(properties: Column) -> Column:
    """The properties as variants by name, to be made once a row; null if the text is no object, and no properties are an
    empty one.  A path into a variant would be found by Spark too, but an absent name costs an exception a row there."""
    return F.try_variant_get(F.try_parse_json(F.coalesce(properties, F.lit("{}"))), "$", "map<string,variant>")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value).  The value is computed once however often it is named, also where the optimizer moves the expression
    beneath a projection (as it does with filters), for it can't put the value in the place of a lambda's variable."""
    return F.transform(F.array(value), then)[0]


def _value(body: Column, name: str, p: Property | None = None) -> Column:
    """A property of the parsed body as a variant: null if absent, a variant null if it is null; the default of `p`
    where that has one and the property is absent."""
    v = F.try_element_at(body, F.lit(name))
    return F.coalesce(v, F.parse_json(F.lit(json.dumps(p.default)))) if p is not None and p.has_default else v


def _kind(s: Column) -> Column:
    """The name in messages of a value's SQL type."""
    return F.when(s == "STRING", "string").when(s == "BIGINT", "int").when(s.startswith("DECIMAL") | (s == "DOUBLE"), "float").when(s == "BOOLEAN", "bool").when(s == "VOID", "null").when(s.startswith("ARRAY"), "list").otherwise("map")


def _shown(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def _accepted(s: Column, p: Property) -> Column:
    """Whether a value of that SQL type is of the declared type."""
    if p.type == "float":
        return F.substring_index(s, "(", 1).isin("DOUBLE", "DECIMAL")
    return s.startswith("ARRAY") if p.type == "list:string" else s == {"int": "BIGINT", "bool": "BOOLEAN"}.get(p.type, "STRING")


def message(v: Column, s: Column, x: Column, p: Property) -> Column:
    """What is wrong with a property's value (after defaults), or null.  s: its SQL type.  x: the number, if it is one
    that has a range."""
    out = F.when(v.isNull(), F.lit("required property is missing") if p.required else F.lit(None).cast("string"))
    out = out.when(F.is_variant_null(v), F.lit("required property cannot be null") if p.required and not p.nullable else F.lit(None).cast("string"))
    return out.when(_accepted(s, p), _outside(v, x, p)).otherwise(F.concat(F.lit(f"expected type {TYPES[p.type]}, got "), _kind(s)))


def _outside(v: Column, x: Column, p: Property) -> Column:
    """What is wrong with a value of the declared type, or null."""
    if p.type == "enum" and p.values is not None:
        listed, text = "[" + ", ".join(f'"{x}"' for x in p.values) + "]", F.try_variant_get(v, "$", "string")
        return F.when(~text.isin(p.values), F.concat(F.lit("invalid enum value '"), text, F.lit(f"', expected one of {listed}")))
    if p.type == "list:string":
        items = F.try_variant_get(v, "$", "array<variant>")
        kinds = F.transform(items, lambda x, i: once(once(F.schema_of_variant(x), _kind), lambda k: F.when(k != "string", F.concat(F.lit("list:string element "), i.cast("string"), F.lit(" is not a string: got "), k))))
        return once(F.array_compact(kinds), lambda found: F.when(F.size(found) > 0, F.element_at(found, 1)))
    if _ranged(p):
        shown = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
        return F.when((x < p.range[0]) | (x > p.range[1]), F.concat(F.lit("value "), shown, F.lit(f" out of range [{_shown(p.range[0])}, {_shown(p.range[1])}]")))
    return F.lit(None).cast("string")


def _ranged(p: Property) -> bool:
    return p.range is not None and p.type in ("int", "float")


def with_errors(rows: DataFrame, body: str, types: list[tuple[Column, dict[str, Property]]], first: Column | None = None) -> DataFrame:
    """Adds errors, an array of (property, message) in order of property, empty if all is well: those of the first type
    whose condition holds, or `first` where that isn't null.  Each step is a column of a projection of its own (the
    j-th of them is that of the j-th property of the row's type), and the errors come out of a generator: so the
    optimizer can't put a step in the place of its name, also not in the filters that it makes of what follows, and each
    is computed once a row, as compiled code (lambdas, as in `once`, are not compiled)."""
    types = [(own, sorted(d.items())) for own, d in types if d]
    n, empty = max((len(d) for _, d in types), default=0), F.array().cast(f"array<{ERROR}>")

    def of_type(step: Callable[[list[tuple[str, Property]]], Column | None], otherwise: Column) -> Column:
        for own, d in reversed(types):
            otherwise = F.when(own, c).otherwise(otherwise) if (c := step(d)) is not None else otherwise
        return otherwise

    def added(to: DataFrame, letter: str, kind: str, step: Callable[[int, str, Property], Column | None]) -> DataFrame:
        none = F.lit(None).cast(kind)
        return to.withColumns({f"_{letter}{j}": of_type(lambda d, j=j: none if j >= len(d) or (c := step(j, *d[j])) is None else c, none) for j in range(n)})

    v, s, x, m = ([F.col(f"_{letter}{j}") for j in range(n)] for letter in "vsxm")
    out = rows if first is None else rows.withColumn("_first", first)
    out = added(out, "v", "variant", lambda j, name, p: _value(F.col(body), name, p))
    out = added(out, "s", "string", lambda j, name, p: F.schema_of_variant(v[j]))
    out = added(out, "x", "double", lambda j, name, p: F.when(_accepted(s[j], p), F.try_variant_get(v[j], "$", "double")) if _ranged(p) else None)
    out = added(out, "m", "string", lambda j, name, p: message(v[j], s[j], x[j], p))
    found = of_type(lambda d: F.concat(*[F.when(m[j].isNull(), empty).otherwise(F.array(F.struct(F.lit(k).alias("property"), m[j].alias("message")))) for j, (k, _) in enumerate(d)]), empty)
    errors = F.when(F.coalesce(*m).isNotNull(), found).otherwise(empty) if n else empty
    errors = errors if first is None else F.coalesce("_first", errors)
    return out.withColumn("_errors", errors).withColumn("errors", F.explode(F.array("_errors"))).drop("_first", "_errors", *[f"_{c}{j}" for c in "vsxm" for j in range(n)])


def with_defaults(properties: Column, body: Column, declared: dict[str, Property]) -> Column:
    """JSON text with a default for each absent property that has one; explicit nulls stay.  All absent ones are put in
    at once, so the expression grows with the number of defaults and no faster."""
    text = F.coalesce(properties, F.lit("{}"))
    defaults = [(k, p) for k, p in sorted(declared.items()) if p.has_default]
    if not defaults:
        return text
    items = once(body, lambda b: F.array(*[F.when(_value(b, k).isNull(), F.lit(f"{json.dumps(k)}:{json.dumps(p.default)}")) for k, p in defaults]))

    def put(whole: Column, added: Column) -> Column:
        trimmed = F.regexp_replace(whole, r"\s+$", "")
        inner = once(trimmed, lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
        return once(inner, lambda t: F.concat(t, F.when(F.regexp_like(t, F.lit(r"^\s*\{\s*$")), F.lit("")).otherwise(F.lit(",")), added, F.lit("}")))

    return once(text, lambda whole: once(F.array_join(items, ","), lambda added: F.when(added == "", whole).otherwise(put(whole, added))))


def validate_nodes(nodes: DataFrame, schema: Schema, node_type: str) -> DataFrame:
    """nodes: node_id, properties.  Gives properties with defaults, and errors."""
    if node_type not in schema.node_types:
        raise GraphError("unknown_node_type", f"Unknown node type: {node_type}")
    declared = schema.node_types[node_type].properties
    done = with_errors(nodes.withColumn("_body", parsed(F.col("properties"))), "_body", [(F.lit(True), declared)])
    return done.withColumn("properties", with_defaults(F.col("properties"), F.col("_body"), declared)).drop("_body")


def validate_edges(edges: DataFrame, schema: Schema) -> DataFrame:
    """edges: edge_type, from_type, from_id, to_type, to_id, properties.  Gives properties with defaults and errors;
    a wrong type or end is an error without a property."""
    kinds = sorted(schema.edge_types.items())
    known = F.col("edge_type").isin([k for k, _ in kinds])
    fits = F.lit(False)
    for k, e in kinds:
        ends = [F.col(c).isin([n for n in schema.node_types if accepts(end, n)]) if "*" not in end else F.lit(True) for c, end in (("from_type", e.source), ("to_type", e.target))]
        fits = fits | ((F.col("edge_type") == k) & ends[0] & ends[1])
    wrong = F.when(~known, F.concat(F.lit("Unknown edge type: "), "edge_type")).when(~fits, F.concat(F.lit("Invalid edge: "), "edge_type", F.lit(" cannot connect "), "from_type", F.lit(" to "), "to_type"))
    text, types = F.col("properties"), [(F.col("edge_type") == k, e.properties) for k, e in kinds if e.properties]
    for own, declared in types:
        text = F.when(own, with_defaults(F.col("properties"), F.col("_body"), declared)).otherwise(text)
    ends = F.when(wrong.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("property"), wrong.alias("message"))))
    done = with_errors(edges.withColumn("_body", parsed(F.col("properties"))), "_body", types, ends)
    return done.withColumn("properties", text).drop("_body")


def typed(nodes: DataFrame, node_type: NodeType | EdgeType, keys: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """Valid nodes (or edges) as columns: the keys, one of its type for each declared property, _present (names of the
    keys that are there, so that absent and null differ) and _extra (JSON text of each undeclared one); and seq, where
    there is one."""
    names = sorted(node_type.properties)
    extra = F.map_filter("_whole", lambda k, v: ~k.isin(names)) if names else F.col("_whole")
    keep = [*keys, *(["seq"] if "seq" in nodes.columns and "seq" not in names else [])]
    read = nodes.select(*keep, F.from_json("properties", node_type.struct()).alias("_read"), F.from_json("properties", "map<string,variant>").alias("_whole"))
    return read.select(*keep, *[F.col("_read")[n].alias(n) for n in names], F.array_sort(F.map_keys("_whole")).alias("_present"), F.transform_values(extra, lambda _, v: F.to_json(v)).alias("_extra"))


def index_text(c: Column, kind: str) -> Column:
    """A value as the text that an equality index would hold: strings, whole numbers and truth values have one."""
    if kind in ("string", "enum", "datetime"):
        return c.cast("string")
    if kind == "int":
        return c.cast("long").cast("string")
    if kind == "bool":
        return F.when(c, "1").when(~c, "0")
    return F.lit(None).cast("string")


def valid_graph_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9_-]{1,100}\z"), F.lit(False))
