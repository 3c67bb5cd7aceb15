"""One query for each operator over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fuzzy, stats, vector
from .operators import resolve, search, validate
from .operators.index import VectorIndex
from .plans.schema import Schema
from .sources import store
from .sources.tables import SCHEMA, graph, key, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """A folder for graphs that a query stores: the one that driver and executors share.  Only where the executors run
    in the driver's own process may it be one of this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (got or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


# --- vectors


def _query_vector(vectors: DataFrame, vec_id: int) -> list[float]:
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").head()
    return [float(x) for x in row[0]] if row else []


def _rounded(found: DataFrame) -> DataFrame:
    """Scores as both engines print them; what is nearest was decided before."""
    return found.withColumn("score", F.round("score", 6))


@query("""select vec_id, round(list_cosine_similarity(embedding::double[], q.e), 6) as score
from embeddings, (select embedding::double[] as e from embeddings where vec_id = 0) q order by list_cosine_similarity(embedding::double[], q.e) desc, vec_id limit 10""")
def similar_topk(spark, sf):
    v = read(spark, sf, "embeddings")
    return _rounded(search.similar(v, _query_vector(v, 0), 10, "vec_id"))


@query("""select vec_id, round(list_cosine_similarity(embedding::double[], q.e), 6) as score
from embeddings, (select embedding::double[] as e from embeddings where vec_id = 0) q where vec_id % 3 <> 0 order by list_cosine_similarity(embedding::double[], q.e) desc, vec_id limit 10""")
def similar_after_delete(spark, sf):
    """Vectors whose nodes are deleted aren't found."""
    g = graph(spark, sf)
    dead = read(spark, sf, "embeddings").where("vec_id % 3 = 0").select(key("i", "vec_id").alias("node_id"))
    left = g.delete_nodes("Item", dead).embeddings["Item"].withColumn("vec_id", F.substring("node_id", 3, 18).cast("long"))
    return _rounded(search.similar(left, _query_vector(read(spark, sf, "embeddings"), 0), 10, "vec_id"))


@query("select vec_id, 0::double as score from embeddings where false")
def similar_empty(spark, sf):
    v = read(spark, sf, "embeddings")
    return _rounded(search.similar(v.where("false"), _query_vector(v, 0), 10, "vec_id"))


@query("""with s as (select a.vec_id, b.vec_id as neighbour, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score
from embeddings a join embeddings b on a.vec_id <> b.vec_id)
select vec_id, neighbour, round(score, 6) as score, "rank" from (select *, cast(row_number() over (partition by vec_id order by score desc, neighbour) as integer) as "rank" from s) where "rank" <= 5""")
def knn_join(spark, sf):
    return _rounded(search.nearest_neighbours(read(spark, sf, "embeddings"), 5))


_NEXT = "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"


def _pairs(spark, sf):
    v = read(spark, sf, "embeddings")
    return v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query(f"select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as value {_NEXT}")
def dot(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(vector.dot("a", "b"), 6).alias("value"))


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as value from embeddings")
def l2_norm(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(vector.l2_norm("embedding"), 6).alias("value"))


@query(f"select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as value {_NEXT}")
def cosine(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(vector.cosine("a", "b"), 6).alias("value"))


@query(f"select a.vec_id, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as value {_NEXT}")
def euclidean(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(vector.euclidean("a", "b"), 6).alias("value"))


@query(f"select a.vec_id, i as place, round(a.embedding[i]::double * b.embedding[i]::double, 9) as value {_NEXT}, (select unnest(range(1, 65)) as i) where i <= len(a.embedding)")
def hadamard(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.posexplode(vector.hadamard("a", "b")).alias("p", "v")).select("vec_id", (F.col("p") + 1).cast("long").alias("place"), F.round("v", 9).alias("value"))


@query("select 'i:' || vec_id as node_id, cast(len(embedding) as integer) as dim from embeddings")
def scan_embeddings_by_type(spark, sf):
    return graph(spark, sf).embeddings["Item"].select("node_id", F.size("embedding").alias("dim"))


@query("""select 'i:' || vec_id as node_id, round(case when vec_id % 5 = 0 then -embedding[1]::double else embedding[1]::double end, 6) as first from embeddings""")
def set_embedding(spark, sf):
    """New vectors for a fifth of the items; vectors of ids without a node are left out."""
    g = graph(spark, sf)
    new = read(spark, sf, "embeddings").where("vec_id % 5 = 0").select(key("i", "vec_id").alias("node_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    stray = new.withColumn("node_id", F.concat(F.lit("none-"), "node_id"))
    return g.set_embeddings("Item", new.union(stray)).embeddings["Item"].select("node_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query("select 'i:' || vec_id as node_id from embeddings where vec_id % 7 <> 0")
def delete_embedding(spark, sf):
    ids = read(spark, sf, "embeddings").where("vec_id % 7 = 0").select(key("i", "vec_id").alias("node_id"))
    return graph(spark, sf).delete_embeddings("Item", ids).embeddings["Item"].select("node_id")


# --- validation


def _raw_parts(spark, sf):
    """Parts as property JSON with missing, null and mistyped values, by key."""
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, "").when(k % 13 == 0, '"name":null,').when(k % 17 == 0, '"name":5,').otherwise(F.concat(F.lit('"name":"'), "p_name", F.lit('",')))
    size = F.when(k % 7 == 0, F.concat(F.lit('"size":"'), "p_size", F.lit('"'))).when(k % 19 == 0, F.concat(F.lit('"size":'), "p_size", F.lit(".5"))).otherwise(F.concat(F.lit('"size":'), "p_size"))
    return read(spark, sf, "part").select(key("p", "p_partkey").alias("node_id"), F.concat(F.lit("{"), name, size, F.lit("}")).alias("properties"))


_PART_ERRORS = """with e as (
select p_partkey k, 'name' as property, case when p_partkey % 11 = 0 then 'required property is missing' when p_partkey % 13 = 0 then 'required property cannot be null' when p_partkey % 17 = 0 then 'expected type String, got int' end as message from part
union all select p_partkey, 'size', case when p_partkey % 7 = 0 then 'expected type Int, got string' when p_partkey % 19 = 0 then 'expected type Int, got float' when p_size > 40 then 'value ' || p_size || ' out of range [1, 40]' end from part)
"""


@query(_PART_ERRORS + "select 'p:' || k as node_id, property, message from e where message is not null")
def validate_nodes_errors(spark, sf):
    out = validate.validate_nodes(_raw_parts(spark, sf), SCHEMA, "Part")
    return out.select("node_id", F.explode("errors").alias("e")).select("node_id", "e.property", "e.message")


@query(_PART_ERRORS + "select 'p:' || p_partkey as node_id, p_name as name, p_size::bigint as size from part where p_partkey not in (select k from e where message is not null)")
def validate_nodes_valid(spark, sf):
    out = validate.validate_nodes(_raw_parts(spark, sf), SCHEMA, "Part").where(F.size("errors") == 0)
    return validate.typed(out, SCHEMA.node_types["Part"]).select("node_id", "name", "size")


@query("""select 'c:' || c_custkey as node_id, case when c_custkey % 3 = 0 then 'standard' when c_custkey % 3 = 1 then null else 'gold' end as tier,
list_sort(case when c_custkey % 3 = 0 then ['name', 'tier'] else ['name', 'tier'] end)[2] as present from customer""")
def apply_defaults(spark, sf):
    """A default fills an absent tier; an explicit null stays."""
    k = F.col("c_custkey")
    tier = F.when(k % 3 == 0, "").when(k % 3 == 1, ',"tier":null').otherwise(',"tier":"gold"')
    raw = read(spark, sf, "customer").select(key("c", "c_custkey").alias("node_id"), F.concat(F.lit('{"name":"'), "c_name", F.lit('"'), tier, F.lit("}")).alias("properties"))
    out = validate.typed(validate.validate_nodes(raw, SCHEMA, "Customer"), SCHEMA.node_types["Customer"])
    return out.select("node_id", "tier", F.element_at("_present", 2).alias("present"))


def _raw_edges(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        F.when(k % 5 == 0, "BOUGHT").otherwise("PLACED").alias("edge_type"), F.when(k % 7 == 0, "Supplier").otherwise("Customer").alias("from_type"), key("c", "o_custkey").alias("from_id"),
        F.lit("Order").alias("to_type"), key("o", "o_orderkey").alias("to_id"), F.lit("{}").alias("properties"),
    )


@query("""select 'o:' || o_orderkey as to_id, case when o_orderkey % 5 = 0 then 'Unknown edge type: BOUGHT' else 'Invalid edge: PLACED cannot connect Supplier to Order' end as message
from orders where o_orderkey % 5 = 0 or o_orderkey % 7 = 0""")
def validate_edges_endpoints(spark, sf):
    out = validate.validate_edges(_raw_edges(spark, sf), SCHEMA)
    return out.select("to_id", F.explode("errors").alias("e")).select("to_id", "e.message")


@query("""with p as (select l_orderkey, l_partkey, sum(l_quantity) q, max(l_discount) d from lineitem group by 1, 2)
select 'o:' || l_orderkey as from_id, 'p:' || l_partkey as to_id, 'quantity' as property, case when l_orderkey % 9 = 0 then 'required property is missing' else 'value ' || case when q = floor(q) then q::bigint::varchar else q::varchar end || ' out of range [1, 50]' end as message from p where l_orderkey % 9 = 0 or q > 50
union all select 'o:' || l_orderkey, 'p:' || l_partkey, 'discount', 'value ' || d::varchar || ' out of range [0, 0.09]' from p where d > 0.09""")
def validate_edge_props(spark, sf):
    e = graph(spark, sf).edges["CONTAINS"]
    absent = F.substring("from_id", 3, 18).cast("long") % 9 == 0
    props = F.when(absent, F.to_json(F.struct("discount"))).otherwise(F.to_json(F.struct("quantity", "discount")))
    raw = e.select(F.lit("CONTAINS").alias("edge_type"), F.lit("Order").alias("from_type"), "from_id", F.lit("Part").alias("to_type"), "to_id", props.alias("properties"))
    out = validate.validate_edges(raw, SCHEMA).select("from_id", "to_id", F.explode("errors").alias("e"))
    return out.select("from_id", "to_id", "e.property", "e.message")


@query("""select p_partkey, p_size::varchar as size_key, p_name as name_key, case when p_size > 20 then '1' else '0' end as big_key, null::varchar as price_key from part""")
def value_index_bytes(spark, sf):
    text = validate.index_text
    return read(spark, sf, "part").select("p_partkey", text(F.col("p_size"), "int").alias("size_key"), text(F.col("p_name"), "string").alias("name_key"), text(F.col("p_size") > 20, "bool").alias("big_key"), text(F.col("p_retailprice"), "float").alias("price_key"))


@query("select page_id, regexp_full_match(url, '[A-Za-z0-9_-]{1,100}') as url_ok, length(u) <= 100 as id_ok from (select *, 'page_' || page_id as u from pages)")
def validate_graph_id(spark, sf):
    return read(spark, sf, "pages").select("page_id", validate.valid_graph_id(F.col("url")).alias("url_ok"), validate.valid_graph_id(F.concat(F.lit("page_"), F.col("page_id"))).alias("id_ok"))


# --- scans


@query("select 'n:' || n_nationkey as node_id, n_name as name from nation")
def scan_nodes(spark, sf):
    return graph(spark, sf).scan_nodes("Nation")


@query("select 'p:' || p_partkey as node_id, p_name as name, p_brand as brand, p_size::bigint as size from part where p_name = 'small ring'")
def scan_nodes_by_property_string(spark, sf):
    return graph(spark, sf).nodes_where("Part", "name", "small ring")


@query("select 'p:' || p_partkey as node_id, p_name as name, p_brand as brand, p_size::bigint as size from part where p_size = 7")
def scan_nodes_by_property_int(spark, sf):
    return graph(spark, sf).list_nodes("Part", "size", "7")


@query("select 's:' || s_suppkey as node_id, s_name as name, s_acctbal as acctbal, s_acctbal >= 0 as solvent from supplier where s_acctbal < 0")
def scan_nodes_by_property_bool(spark, sf):
    return graph(spark, sf).list_nodes("Supplier", "solvent", "false")


@query("select 'c:' || c_custkey as node_id, c_name as name, c_mktsegment as segment, c_acctbal as acctbal, 'standard' as tier from customer where false")
def list_nodes_unindexed_empty(spark, sf):
    return graph(spark, sf).list_nodes("Customer", "name", "Customer#1")


@query("select 'c:' || c_custkey as node_id, c_name as name from customer where c_custkey = 17")
def get_node(spark, sf):
    return graph(spark, sf).get_nodes("Customer", ["c:17"]).select("node_id", "name")


@query("select distinct 'c:' || o_custkey as from_id, 'o:' || o_orderkey as to_id from orders where o_orderkey = 42")
def get_edge(spark, sf):
    g = graph(spark, sf)
    row = read(spark, sf, "orders").where("o_orderkey = 42").select(key("c", "o_custkey")).head()
    return g.get_edge("PLACED", row[0] if row else "", "o:42")


@query("""select 'PLACED' as edge_type, 'c:' || o_custkey as from_id, 'o:' || o_orderkey as to_id from orders where o_custkey = 17
union all select 'LIVES_IN', 'c:' || c_custkey, 'n:' || c_nationkey from customer where c_custkey = 17""")
def outgoing_edges(spark, sf):
    return graph(spark, sf).outgoing("c:17")


@query("select 'PLACED' as edge_type, 'c:' || o_custkey as from_id, 'o:' || o_orderkey as to_id from orders where o_custkey = 17")
def outgoing_edges_typed(spark, sf):
    return graph(spark, sf).outgoing("c:17", "PLACED")


@query("""select 'LIVES_IN' as edge_type, 'c:' || c_custkey as from_id, 'n:' || c_nationkey as to_id from customer where c_nationkey = 3
union all select 'BASED_IN', 's:' || s_suppkey, 'n:' || s_nationkey from supplier where s_nationkey = 3""")
def incoming_edges(spark, sf):
    return graph(spark, sf).incoming("n:3")


@query("""select 'Region' as node_type, count(*) as n from region union all select 'Nation', count(*) from nation union all select 'Customer', count(*) from customer
union all select 'Supplier', count(*) from supplier union all select 'Part', count(*) from part union all select 'Order', count(*) from orders union all select 'Item', count(*) from embeddings""")
def count_nodes(spark, sf):
    return graph(spark, sf).count_nodes()


@query("""select 'PLACED' as edge_type, 'c:' || o_custkey as from_id, 'o:' || o_orderkey as to_id from orders where o_custkey % 10 = 0
union all select 'LIVES_IN', 'c:' || c_custkey, 'n:' || c_nationkey from customer where c_custkey % 10 = 0""")
def dangling_edges(spark, sf):
    """After customers' rows are taken away without their edges."""
    g = graph(spark, sf)
    nodes = g.nodes | {"Customer": lambda: g.nodes["Customer"].where(F.substring("node_id", 3, 18).cast("long") % 10 != 0)}
    return type(g)(g.schema, nodes, g.edges, {}).dangling_edges()


@query("""select 'c:' || c_custkey as from_id, 'n:' || c_nationkey as via, 'r:' || n_regionkey as to_id from customer join nation on c_nationkey = n_nationkey""")
def two_hop(spark, sf):
    return graph(spark, sf).two_hop("LIVES_IN", "NATION_IN")


# --- changes


@query("""select 'c:' || c_custkey as node_id, case when c_custkey % 4 = 0 then 'new ' || c_name else c_name end as name, case when c_custkey % 4 = 0 then null else c_mktsegment end as segment from customer
union all select 'c:new', 'someone', null""")
def create_upsert(spark, sf):
    """Whole rows take the old ones' place; of several rows with an id the last counts."""
    rows = read(spark, sf, "customer").where("c_custkey % 4 = 0").select(key("c", "c_custkey").alias("node_id"), F.col("c_name").alias("name"))
    rows = rows.withColumn("seq", F.lit(1)).union(rows.select("node_id", F.concat(F.lit("new "), "name"), F.lit(2))).union(spark.createDataFrame([("c:new", "someone", 1)], "node_id string, name string, seq int"))
    return graph(spark, sf).upsert_nodes("Customer", rows).nodes["Customer"].select("node_id", "name", "segment")


@query("select 'c:' || c_custkey as node_id, case when c_custkey % 4 = 0 then 'again' else c_name end as name from customer")
def replace_node(spark, sf):
    rows = read(spark, sf, "customer").where("c_custkey % 4 = 0").select(key("c", "c_custkey").alias("node_id"), F.lit("again").alias("name"))
    stray = rows.withColumn("node_id", F.concat(F.lit("none-"), "node_id"))
    return graph(spark, sf).replace_nodes("Customer", rows.union(stray)).nodes["Customer"].select("node_id", "name")


@query("""select 'o:' || l_orderkey as from_id, 'p:' || l_partkey as to_id, case when l_orderkey % 3 = 0 then 1.0::double else sum(l_quantity) end as quantity, case when l_orderkey % 3 = 0 and l_partkey % 2 = 0 then null else max(l_discount) end as discount
from lineitem group by l_orderkey, l_partkey""")
def merge_edge(spark, sf):
    """What is present overlays, an explicit null too; absent keys stay."""
    g = graph(spark, sf)
    even = F.substring("to_id", 3, 18).cast("long") % 2 == 0
    rows = g.edges["CONTAINS"].where(F.substring("from_id", 3, 18).cast("long") % 3 == 0)
    rows = rows.select("from_id", "to_id", F.lit(1.0).alias("quantity"), F.lit(None).cast("double").alias("discount"), F.when(even, F.array(F.lit("quantity"), F.lit("discount"))).otherwise(F.array(F.lit("quantity"))).alias("_present"))
    return g.merge_edges("CONTAINS", rows).edges["CONTAINS"]


@query("select 'c:' || o_custkey as from_id, 'o:' || o_orderkey as to_id from orders where o_orderkey % 5 <> 0")
def delete_edge(spark, sf):
    g = graph(spark, sf)
    gone = g.edges["PLACED"].where(F.substring("to_id", 3, 18).cast("long") % 5 == 0)
    return g.delete_edges("PLACED", gone).edges["PLACED"]


def _without_building(spark, sf):
    g = graph(spark, sf)
    return g.delete_nodes("Customer", g.nodes["Customer"].where("segment = 'BUILDING'"))


@query("select 'c:' || c_custkey as node_id from customer where c_mktsegment <> 'BUILDING'")
def delete_node_cascade_nodes(spark, sf):
    return _without_building(spark, sf).nodes["Customer"].select("node_id")


@query("""select 'PLACED' as edge_type, count(*) as n from orders join customer on o_custkey = c_custkey where c_mktsegment <> 'BUILDING'
union all select 'LIVES_IN', count(*) from customer where c_mktsegment <> 'BUILDING' union all select 'NATION_IN', count(*) from nation
union all select 'BASED_IN', count(*) from supplier union all select 'SUPPLIES', count(*) from (select distinct l_suppkey, l_partkey from lineitem) union all select 'CONTAINS', count(*) from (select distinct l_orderkey, l_partkey from lineitem)""")
def delete_node_cascade_edges(spark, sf):
    return _without_building(spark, sf).all_edges().groupBy("edge_type").agg(F.count("*").alias("n"))


@query("select 'i:' || vec_id as node_id from embeddings where label <> 3")
def delete_node_cascade_embeddings(spark, sf):
    g = graph(spark, sf)
    return g.delete_nodes("Item", g.nodes["Item"].where("label = 3")).embeddings["Item"].select("node_id")


@query("""select 'n:' || n_nationkey as node_id, n_name as name from nation where n_nationkey not in (1, 2) union all select 'n:x', 'NOWHERE'""")
def batch_commit(spark, sf):
    new = spark.createDataFrame([("n:x", "NOWHERE"), ("n:2", "TWO")], "node_id string, name string")
    gone = spark.createDataFrame([("n:1",), ("n:2",)], "node_id string")
    done, _ = graph(spark, sf).batch().add("upsert_nodes", "Nation", new).add("delete_nodes", "Nation", gone).commit()
    return done.nodes["Nation"]


@query("select 'n:' || n_nationkey as node_id, n_name as name from nation")
def batch_discard(spark, sf):
    gone = spark.createDataFrame([("n:1",)], "node_id string")
    return graph(spark, sf).batch().add("delete_nodes", "Nation", gone).discard().nodes["Nation"]


@query("select 'g1' as graph_id, 0::bigint as n union all select 'g10', count(*) from nation")
def clear_graph(spark, sf):
    """Of two stored graphs with like names the one that is meant is emptied; both stay."""
    nation = graph(spark, sf).nodes["Nation"]
    r = store.Registry(spark, f"{scratch(spark)}/graphs-{uuid.uuid4().hex}")
    for name in ("g1", "g10"):
        g = r.create(name, SCHEMA)
        r.save(name, type(g)(SCHEMA, {"Nation": nation}))
    r.clear("g1")
    out = [r.get(k).nodes.get("Nation", nation.limit(0)).agg(F.lit(k).alias("graph_id"), F.count("*").alias("n")) for k in r.list_ids()]
    return out[0].unionByName(out[1])


@query("""select 'c:' || c_custkey as node_id, c_name as name, case when c_custkey % 3 = 0 then 'standard' when c_custkey % 3 = 1 then null else 'gold' end as tier, case when c_custkey % 3 = 1 then true else null end as tier_is_null, null::varchar as property, null::varchar as message from customer where c_custkey % 5 <> 0
union all select 'c:' || c_custkey, null, null, null, 'name', 'required property is missing' from customer where c_custkey % 5 = 0""")
def create_node_defaults(spark, sf):
    """New nodes with defaults; those that break the schema are refused."""
    k = F.col("c_custkey")
    tier = F.when(k % 3 == 0, "").when(k % 3 == 1, '"tier":null').otherwise('"tier":"gold"')
    name = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit('"name":"'), "c_name", F.lit('"')))
    raw = read(spark, sf, "customer").select(key("c", "c_custkey").alias("node_id"), F.concat(F.lit("{"), name, F.when((name != "") & (tier != ""), ",").otherwise(""), tier, F.lit("}")).alias("properties"))
    done = type(graph(spark, sf))(SCHEMA).create_nodes("Customer", raw)
    null = F.when(F.col("tier").isNull() & F.array_contains("_present", "tier"), True)
    none = F.lit(None).cast("string")
    good = done.graph.nodes["Customer"].select("node_id", "name", "tier", null.alias("tier_is_null"), none.alias("property"), none.alias("message"))
    return good.unionByName(done.refused.select("node_id", none.alias("name"), none.alias("tier"), F.lit(None).cast("boolean").alias("tier_is_null"), "property", "message"))


@query("""select 'n:' || n_nationkey as node_id, case when n_nationkey % 2 = 0 then 'again' else n_name end as name from nation where n_nationkey <> 4 union all select 'n:4', n_name from nation where n_nationkey = 4""")
def replace_node_validated(spark, sf):
    """Properties of known nodes are replaced; a row that breaks the schema and rows of unknown ids change nothing."""
    k = F.col("n_nationkey")
    raw = read(spark, sf, "nation").where("n_nationkey % 2 = 0").select(key("n", "n_nationkey").alias("node_id"), F.when(k == 4, '{"name":null}').otherwise('{"name":"again"}').alias("properties"))
    stray = raw.withColumn("node_id", F.concat(F.lit("none-"), "node_id"))
    return graph(spark, sf).replace_node_properties("Nation", raw.unionByName(stray)).graph.nodes["Nation"].select("node_id", "name")


@query("""with p as (select l_orderkey o, l_partkey p, sum(l_quantity) q from lineitem group by 1, 2)
select 'CONTAINS' as edge_type, 'o:' || o as from_id, 'p:' || p as to_id, q as quantity, null::varchar as message from p where q <= 50 and o % 5 <> 0
union all select 'CONTAINS', 'o:' || o, 'p:' || p, null, 'Invalid edge: CONTAINS cannot connect Supplier to Part' from p where o % 5 = 0
union all select 'CONTAINS', 'o:' || o, 'p:' || p, null, 'value ' || case when q = floor(q) then q::bigint::varchar else q::varchar end || ' out of range [1, 50]' from p where q > 50 and o % 5 <> 0""")
def create_edge_validated(spark, sf):
    """New edges whose ends and properties fit the schema; the others are refused."""
    wrong = F.substring("from_id", 3, 18).cast("long") % 5 == 0
    raw = graph(spark, sf).edges["CONTAINS"].select(F.lit("CONTAINS").alias("edge_type"), F.when(wrong, "Supplier").otherwise("Order").alias("from_type"), "from_id", F.lit("Part").alias("to_type"), "to_id", F.to_json(F.struct("quantity")).alias("properties"))
    done = type(graph(spark, sf))(SCHEMA).create_edges(raw)
    good = done.graph.edges["CONTAINS"].select(F.lit("CONTAINS").alias("edge_type"), "from_id", "to_id", "quantity", F.lit(None).cast("string").alias("message"))
    return good.unionByName(done.refused.select("edge_type", "from_id", "to_id", F.lit(None).cast("double").alias("quantity"), "message"))


@query("select 'c:' || c_custkey as node_id, true as existed from customer where c_mktsegment = 'BUILDING' union all select 'c:none', false")
def delete_node_existed(spark, sf):
    """What a delete answers: whether each id was there."""
    g = graph(spark, sf)
    ids = g.nodes["Customer"].where("segment = 'BUILDING'").select("node_id").union(spark.createDataFrame([("c:none",)], "node_id string"))
    return g.nodes_existed("Customer", ids)


@query("select 'i:' || vec_id as node_id, cast(len(embedding) as integer) as dim, round(embedding[1]::double, 6) as first from embeddings where vec_id in (3, 7)")
def get_embedding(spark, sf):
    got = graph(spark, sf).get_embedding("Item", ["i:3", "i:7", "i:none"])
    return got.select("node_id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query("select vec_id, vec_id % 4 <> 0 as found from embeddings union all select -1, false")
def index_contains(spark, sf):
    """Of an approximate index after a quarter of its vectors is removed."""
    v = read(spark, sf, "embeddings")
    index = VectorIndex.build(v).remove(v.where("vec_id % 4 = 0").select("vec_id"))
    return index.contains(v.select(F.col("vec_id").cast("long").alias("vec_id")).union(spark.createDataFrame([(-1,)], "vec_id long")))


@query("select count(*) as vectors, 64 as dim, true as whole from embeddings")
def index_stats(spark, sf):
    """Every vector is indexed, after an insert that brings a half of them again."""
    v = read(spark, sf, "embeddings")
    stats_ = VectorIndex.build(v).insert(v.where("vec_id % 2 = 0")).stats()
    return stats_.select("vectors", "dim", (F.col("probes").between(1, F.col("cells")) & (F.col("largest") <= F.col("vectors"))).alias("whole"))


@query("select true as nine_tenths")
def index_recall(spark, sf):
    """Measured against the exact neighbours of every vector whose id is divisible by 100."""
    v = read(spark, sf, "embeddings")
    got = VectorIndex.build(v).recall(10, v.where("vec_id % 100 = 0"))
    return spark.createDataFrame([(got >= 0.9,)], "nine_tenths boolean")


@query("select o_custkey as c_custkey, arg_max(o_orderstatus, o_orderkey) as last_status from orders group by 1")
def latest_wins(spark, sf):
    from .operators.graph import latest

    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("last_status"), F.col("o_orderkey").alias("seq"))
    return latest(rows, ["c_custkey"])


# --- names

_JARO = r"""v as (select q, c, 'jw' as kind, lower(q) as a, lower(c) as b from pairs
union all select q, c, 'ts', lower(array_to_string(list_sort(list_filter(regexp_split_to_array(q, '\s+'), lambda t: t <> '')), ' ')), lower(array_to_string(list_sort(list_filter(regexp_split_to_array(c, '\s+'), lambda t: t <> '')), ' ')) from pairs),
w as (select *, len(a) as l1, len(b) as l2, greatest(greatest(len(a), len(b)) // 2 - 1, 0) as wd from v),
m as (select *, list_reduce(list_transform(range(1, l1 + 1), lambda i: {'i': i, 'm': []::bigint[]}), lambda acc, x: {'i': x.i, 'm': list_append(acc.m, coalesce(list_min(list_filter(range(greatest(x.i - wd, 1), least(x.i + wd, l2) + 1), lambda j: b[j] = a[x.i] and not list_contains(acc.m, j))), 0))}, {'i': 0::bigint, 'm': []::bigint[]}).m as mm from w),
k as (select *, list_filter(mm, lambda j: j > 0) as mj, list_filter(range(1, l1 + 1), lambda i: mm[i] > 0) as mi,
coalesce(list_min(list_filter([1, 2, 3, 4], lambda i: i > l1 or i > l2 or a[i] <> b[i])), 5) - 1 as p from m),
j as (select *, case when a = b then 1::double when len(mj) = 0 then 0::double else (len(mj) / l1 + len(mj) / l2 + (len(mj) - len(list_filter(range(1, len(mj) + 1), lambda x: a[mi[x]] <> b[list_sort(mj)[x]])) / 2::double) / len(mj)) / 3::double end as ja from k),
s as (select q, c, kind, cast(floor((ja + p * 0.1::double * (1 - ja)) * 100 + 0.5) as bigint) as score from j)
"""
_NAMES = "with names as (select distinct p_name as n from part), pairs as (select a.n as q, b.n as c from names a, names b where a.n < b.n), " + _JARO


def _name_pairs(spark, sf):
    names = read(spark, sf, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("q")).join(F.broadcast(names.select(F.col("p_name").alias("c"))), F.col("q") < F.col("c"))


@query(_NAMES + "select q, c, score from s where kind = 'jw'")
def jaro_winkler(spark, sf):
    return _name_pairs(spark, sf).withColumn("score", fuzzy.jaro_winkler(F.col("q"), F.col("c")))


@query(_NAMES + "select q, c, score from s where kind = 'ts'")
def token_sort_ratio(spark, sf):
    return _name_pairs(spark, sf).withColumn("score", fuzzy.token_sort_ratio(F.col("q"), F.col("c")))


def _resolver_input(spark, sf):
    """Every part's name without its first two characters, as a worn label shows it, against all names; vectors are those
    of the least keys."""
    parts, v = read(spark, sf, "part"), read(spark, sf, "embeddings").select("vec_id", "embedding")
    by = lambda c: parts.groupBy(c.alias("name")).agg(F.min("p_partkey").alias("pos")).join(v, F.col("pos") == F.col("vec_id"), "left")
    queries = by(F.substring("p_name", 3, 1 << 30)).select(F.col("name").alias("query_id"), F.col("name").alias("query"), F.col("embedding").alias("query_embedding"))
    return queries, by(F.col("p_name")).select(F.concat(F.lit("p:"), "pos").alias("id"), "name", "pos", "embedding")


_RESOLVE = "with names as (select p_name as n, min(p_partkey) as pos from part group by 1), asked as (select substr(p_name, 3) as q, min(p_partkey) as at from part group by 1), pairs as (select q, n as c from asked, names), " + _JARO + ", f as (select q, c, pos, max(score) as score from s join names on n = c group by 1, 2, 3)\n"


@query(_RESOLVE + "select q as query_id, 'p:' || pos as id, score, cast(row_number() over (partition by q order by score desc, pos) as integer) as place from f")
def resolve_candidates(spark, sf):
    from pyspark.sql import Window

    queries, existing = _resolver_input(spark, sf)
    out = resolve.candidates(queries, existing)
    return out.select("query_id", "id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")).alias("place"))


@query(_RESOLVE + ", b as (select q, max(score) as best, arg_max(pos, score * 1000000000 - pos) as pos from f group by 1) select q as query_id, case when best >= 90 then 'auto_merge' else 'create_new' end as decision, case when best >= 90 then 'p:' || pos end as id, best as best_score from b")
def resolve_decisions(spark, sf):
    queries, existing = _resolver_input(spark, sf)
    return resolve.resolve(queries.drop("query_embedding"), existing.drop("embedding")).select("query_id", "decision", "id", "best_score")


@query(_RESOLVE + """, z as (select f.*, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 9) as cos from f join asked on asked.q = f.q join embeddings x on x.vec_id = asked.at join embeddings y on y.vec_id = f.pos where score >= 60),
b as (select q, max(score) as best, arg_max(pos, score * 1000000000 - pos) as pos from f group by 1), n as (select q, max(cos) as cos, arg_max(pos, cos * 1000000000000 + pos / 1000000000.0::double) as pos from z group by 1)
select b.q as query_id, case when best >= 95 then 'auto_merge' when best >= 60 and cos >= 0.1::double then 'vector_merge' else 'create_new' end as decision, case when best >= 95 then 'p:' || b.pos when best >= 60 and cos >= 0.1::double then 'p:' || n.pos end as id,
case when best >= 95 then best::double when best >= 60 and cos >= 0.1::double then round(cos, 6) end as score, best as best_score from b left join n on n.q = b.q""")
def resolve_vector_tier(spark, sf):
    return resolve.resolve(*_resolver_input(spark, sf), resolve.Thresholds(60, 0.1, 95))


# --- statistics


@query("""select o_orderpriority, case when count(*) < 2 or abs(count(*) * sum(x * x) - sum(x) * sum(x)) < 1e-12 then null else round((count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)), 6) end as slope
from (select o_orderpriority, o_custkey::double as x, o_totalprice as y from orders) group by 1""")
def regression_slope(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(stats.regression_slope(F.col("o_custkey"), F.col("o_totalprice")), 6).alias("slope"))


@query("""select event_type, case when count(*) < 3 or var_pop(user_id) = 0 or var_pop(value) = 0 then null else round(covar_pop(user_id::double, value) / (stddev_pop(user_id::double) * stddev_pop(value)), 6) end as r from events group by 1""")
def pearson(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(stats.pearson(F.col("user_id"), F.col("value")), 6).alias("r"))


@query("select event_type, count(*) as requests, round(sum(value), 4) as total, count(distinct user_id) as callers from events group by 1")
def request_counters(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("callers"))


# --- schemas


@query("select * from (values ('LIVES_IN', 'place', false), ('NATION_IN', 'place', true), ('PLACED', 'trade', true)) t(edge_type, category, extractable)")
def inference_edge_types(spark, sf):
    rows = [(k, SCHEMA.edge_types[k].inference_category, SCHEMA.edge_types[k].pass_1_extractable) for k in SCHEMA.inference_edge_types()]
    return spark.createDataFrame(rows, "edge_type string, category string, extractable boolean")


@query("""select * from (values ('changed node property type: Part.size Int -> Float'), ('edge `from` endpoint narrowed: ANYTHING'), ('node property became required without a default: Order.channel'), ('removed edge type: SUPPLIES'), ('removed node property: Customer.acctbal')) t(violation)""")
def schema_evolution_errors(spark, sf):
    old = Schema.of(SCHEMA.json())
    old.ensure_edge_type("ANYTHING")
    new = old.json()
    del new["edge_types"]["SUPPLIES"], new["node_types"]["Customer"]["properties"]["acctbal"]
    new["node_types"]["Part"]["properties"]["size"]["type"] = "float"
    new["node_types"]["Order"]["properties"]["channel"] = {"type": "string", "required": True}
    new["edge_types"]["ANYTHING"]["from"] = ["Part", "Order"]
    return spark.createDataFrame([(m,) for m in old.incompatibilities(Schema.of(new))], "violation string")


@query("select * from (values ('Customer', 'segment'), ('Item', 'label'), ('Nation', 'name'), ('Part', 'brand'), ('Part', 'name'), ('Part', 'size'), ('Region', 'name'), ('Supplier', 'solvent')) t(node_type, property)")
def indexed_properties(spark, sf):
    return spark.createDataFrame([(n, p) for n in sorted(SCHEMA.node_types) for p in SCHEMA.indexed_properties(n)], "node_type string, property string")
