"""The test tables as a property graph.  Ids carry their type's letter, for an edge's ends are ids alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..plans.schema import Schema

SCHEMA = Schema.from_yaml("""
schema:
  name: orders_graph
  version: 1
  node_types:
    Region:   {properties: {name: {type: string, required: true, indexed: true}}}
    Nation:   {properties: {name: {type: string, required: true, indexed: true}}}
    Customer:
      properties:
        name:    {type: string, required: true}
        segment: {type: enum, values: [AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY], indexed: true}
        acctbal: {type: float}
        tier:    {type: string, default: standard}
    Supplier: {properties: {name: {type: string, required: true}, acctbal: {type: float}, solvent: {type: bool, indexed: true}}}
    Part:
      properties:
        name:  {type: string, required: true, indexed: true}
        brand: {type: string, indexed: true}
        size:  {type: int, indexed: true, range: [1, 40]}
      embedding_field: name
      resolution: {strategy: fuzzy_then_vector}
    Order:    {properties: {status: {type: string}, total: {type: float}, placed_at: {type: datetime}}}
    Item:     {properties: {label: {type: int, indexed: true}}}
  edge_types:
    NATION_IN: {from: Nation, to: Region, inference_category: place, pass_1_extractable: true}
    LIVES_IN:  {from: Customer, to: Nation, inference_category: place}
    BASED_IN:  {from: Supplier, to: Nation}
    PLACED:    {from: Customer, to: Order, inference_category: trade, pass_1_extractable: true}
    CONTAINS:  {from: Order, to: Part, properties: {quantity: {type: float, required: true, range: [1, 50]}, discount: {type: float, range: [0.0, 0.09]}}}
    SUPPLIES:  {from: Supplier, to: Part}
""")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(letter: str, column: str):
    return F.concat(F.lit(f"{letter}:"), F.col(column).cast("string"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Lazily: only the tables and columns that a query asks for are read."""
    t = lambda name: read(spark, sf_dir, name)
    nodes = {
        "Region": lambda: t("region").select(key("r", "r_regionkey").alias("node_id"), F.col("r_name").alias("name")),
        "Nation": lambda: t("nation").select(key("n", "n_nationkey").alias("node_id"), F.col("n_name").alias("name")),
        "Customer": lambda: t("customer").select(key("c", "c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"), F.lit("standard").alias("tier")),
        "Supplier": lambda: t("supplier").select(key("s", "s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), (F.col("s_acctbal") >= 0).alias("solvent")),
        "Part": lambda: t("part").select(key("p", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size")),
        "Order": lambda: t("orders").select(key("o", "o_orderkey").alias("node_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed_at")),
        "Item": lambda: t("embeddings").select(key("i", "vec_id").alias("node_id"), F.col("label").cast("long").alias("label")),
    }
    edges = {
        "NATION_IN": lambda: t("nation").select(key("n", "n_nationkey").alias("from_id"), key("r", "n_regionkey").alias("to_id")),
        "LIVES_IN": lambda: t("customer").select(key("c", "c_custkey").alias("from_id"), key("n", "c_nationkey").alias("to_id")),
        "BASED_IN": lambda: t("supplier").select(key("s", "s_suppkey").alias("from_id"), key("n", "s_nationkey").alias("to_id")),
        "PLACED": lambda: t("orders").select(key("c", "o_custkey").alias("from_id"), key("o", "o_orderkey").alias("to_id")),
        "CONTAINS": lambda: t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount")).select(key("o", "l_orderkey").alias("from_id"), key("p", "l_partkey").alias("to_id"), "quantity", "discount"),
        "SUPPLIES": lambda: t("lineitem").select(key("s", "l_suppkey").alias("from_id"), key("p", "l_partkey").alias("to_id")).distinct(),
    }
    return Graph(SCHEMA, nodes, edges, {"Item": lambda: t("embeddings").select(key("i", "vec_id").alias("node_id"), "embedding")})
