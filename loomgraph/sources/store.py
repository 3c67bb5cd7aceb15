"""Graphs on disk: Parquet tables, states that name them, and a registry of graphs.

State n of a graph is the file state-<n>: its schema and the folder of each of its tables.  It is written under another
name and renamed to a name that nobody has used, so a state is there whole or not at all, and the state with the largest
number is the current one: there is no moment without one.  A save writes the tables that have changed and names the old
folders of the others; folders that none of the last KEEP states names are removed.  One writer for each graph at a time."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

from ..operators.graph import Graph
from ..plans.schema import GraphError, Schema

KINDS = ("nodes", "edges", "embeddings")
#: States that stay for readers that have begun.
KEEP = 2


class Files:
    """Small files and listings through Hadoop's file systems, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file, there whole or not at all; never over an old one."""
        fs, p = self._at(path)
        _, temp = self._at(f"{path}.{uuid.uuid4().hex}.new")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(temp, p):
            fs.delete(temp, False)
            raise GraphError("conflict", f"{path} was written by another writer")

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Registry:
    """Named graphs under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")
        self.graphs: dict[str, Graph] = {}

    @staticmethod
    def check_id(graph_id: str) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,100}", graph_id or ""):
            raise GraphError("bad_request", f"bad graph id {graph_id!r}")

    def create(self, graph_id: str, schema: Schema) -> Graph:
        self.check_id(graph_id)
        schema.validate()
        if graph_id in self.graphs or self._states(graph_id):
            raise GraphError("conflict", f"graph {graph_id} exists")
        return self._commit(graph_id, schema, {})

    def get(self, graph_id: str) -> Graph:
        if graph_id not in self.graphs:
            raise GraphError("not_found", f"graph {graph_id} not found")
        return self.graphs[graph_id]

    def list_ids(self) -> list[str]:
        return sorted(self.graphs)

    def _states(self, graph_id: str) -> list[int]:
        return sorted(int(m[1]) for x in self.files.list(graph_id) if (m := re.fullmatch(r"state-([0-9]+)", x)))

    def _commit(self, graph_id: str, schema: Schema, tables: dict) -> Graph:
        """tables: folders by kind and name."""
        states = self._states(graph_id)
        n = states[-1] + 1 if states else 1
        self.files.write(f"{graph_id}/state-{n}", json.dumps({"schema": schema.json(), "tables": tables}, sort_keys=True))
        self.graphs[graph_id] = self._load(graph_id)
        self._clean(graph_id)
        return self.graphs[graph_id]

    def _clean(self, graph_id: str) -> None:
        states = self._states(graph_id)
        for n in states[:-KEEP]:
            self.files.delete(f"{graph_id}/state-{n}")
        named = {f for n in states[-KEEP:] for kind in json.loads(self.files.read(f"{graph_id}/state-{n}"))["tables"].values() for f in kind.values()}
        for folder in self.files.list(f"{graph_id}/tables"):
            if folder not in named:
                self.files.delete(f"{graph_id}/tables/{folder}")

    def save(self, graph_id: str, graph: Graph) -> Graph:
        """Writes the tables that aren't those of the current state, then the next state, and returns the graph as read
        from it."""
        now, tables = self.get(graph_id), {}
        folders = self._tables(graph_id)
        for kind in KINDS:
            have = getattr(now, kind)
            for name in getattr(graph, kind):
                if name in folders.get(kind, {}) and getattr(graph, kind).same(have, name):
                    folder = folders[kind][name]
                else:
                    folder = f"{kind}-{name}-{uuid.uuid4().hex}"
                    getattr(graph, kind)[name].write.parquet(f"{self.root}/{graph_id}/tables/{folder}")
                tables.setdefault(kind, {})[name] = folder
        return self._commit(graph_id, graph.schema, tables)

    def _tables(self, graph_id: str) -> dict:
        states = self._states(graph_id)
        return json.loads(self.files.read(f"{graph_id}/state-{states[-1]}"))["tables"] if states else {}

    def _load(self, graph_id: str) -> Graph:
        now = json.loads(self.files.read(f"{graph_id}/state-{self._states(graph_id)[-1]}"))
        at = f"{self.root}/{graph_id}/tables"
        for folder in sorted(f for kind in now["tables"].values() for f in kind.values()):
            if not self.files.exists(f"{graph_id}/tables/{folder}"):
                raise GraphError("storage", f"graph {graph_id}: the table {folder} is gone")
        graph = Graph(Schema.of(now["schema"]), *({n: (lambda f=f: self.spark.read.parquet(f"{at}/{f}")) for n, f in now["tables"].get(kind, {}).items()} for kind in KINDS))
        return graph.widened()

    def replace_schema(self, graph_id: str, schema: Schema) -> Graph:
        """A schema that breaks stored data is refused and nothing changes; no table is written."""
        self.get(graph_id).with_schema(schema)
        return self._commit(graph_id, schema, self._tables(graph_id))

    def clear(self, graph_id: str) -> Graph:
        """Drops this graph's data, not its schema."""
        return self._commit(graph_id, self.get(graph_id).schema, {})

    def delete(self, graph_id: str) -> None:
        self.get(graph_id)
        self.files.delete(graph_id)
        del self.graphs[graph_id]

    def rehydrate(self) -> list[str]:
        """Loads graphs that are on disk and not here; returns their ids.  A broken one is an error."""
        new = []
        for name in self.files.list(""):
            if name not in self.graphs and self._states(name):
                self.check_id(name)
                try:
                    loaded = self._load(name)
                except GraphError:
                    raise
                except Exception as e:  # torn, unreadable or of another form: never a graph that looks empty
                    raise GraphError("storage", f"graph {name} can't be loaded: {e}") from e
                self.graphs[name] = loaded
                new.append(name)
        return sorted(new)
