"""Node changes from a stream: each micro-batch becomes the next state, late changes of an id lose to newer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Graph, latest
from ..sources.store import Registry


def apply_changes(graph: Graph, node_type: str, batch: DataFrame) -> Graph:
    """batch: node_id, seq and the type's columns.  Of changes of one id the one with the largest seq counts, over
    batches as well: seq is stored.  Other tables of the graph stay the same tables."""
    stored = graph.nodes.get(node_type)
    new = latest(batch.withColumn("_seq", batch["seq"]), ["node_id"]).withColumnRenamed("_seq", "seq")
    if stored is None:
        table = new
    else:
        old = stored.select("node_id", stored["seq"].alias("_old"))
        new = new.join(old, "node_id", "left").where("_old is null or _old <= seq").drop("_old")
        table = stored.join(new.select("node_id"), "node_id", "left_anti").unionByName(new, allowMissingColumns=True).select(*stored.columns)
    return type(graph)(graph.schema, graph.nodes | {node_type: table}, graph.edges, graph.embeddings)


def upsert_stream(changes: DataFrame, registry: Registry, graph_id: str, node_type: str, checkpoint: str) -> StreamingQuery:
    """changes: a stream of rows for apply_changes.  A batch writes the table of its node type and no other; one that is
    run twice does no harm."""

    def apply(batch: DataFrame, _: int) -> None:
        registry.save(graph_id, apply_changes(registry.get(graph_id), node_type, batch))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
