"""Every query against its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from loomgraph import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def rows(df):
    fix = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(fix(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, db, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), db.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_without_llm():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_filter_reaches_the_scan(spark, small):
    plan = queries.QUERIES["scan_nodes_by_property_int"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size), " in plan.replace("PushedFilters: [IsNotNull(p_size),", "PushedFilters: [IsNotNull(p_size), ") or "p_size" in plan.split("PushedFilters")[1]


def test_search_is_a_heap(spark, small):
    assert "TakeOrderedAndProject" in queries.QUERIES["similar_topk"](spark, small)._jdf.queryExecution().toString()


def changed(small, folder, **tables):
    """The test tables with some of them changed."""
    for t in TABLES:
        if t in tables:
            tables[t].to_parquet(f"{folder}/{t}.parquet", index=False)
        else:
            (folder / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    return str(folder)


def test_dangling_edges_of_every_type(spark, small, tmp_path):
    lines = pd.read_parquet(f"{small}/lineitem.parquet")
    suppliers = pd.read_parquet(f"{small}/supplier.parquet")
    for i, (column, orphan) in enumerate((("l_orderkey", 90_000_001), ("l_partkey", 90_000_002), ("l_suppkey", 90_000_003))):
        lines.loc[i, column] = orphan
    suppliers.loc[0, "s_nationkey"] = 777
    got = {(r.edge_type, e) for r in queries.QUERIES["dangling_edges"](spark, changed(small, tmp_path, lineitem=lines, supplier=suppliers)).collect() for e in (r.from_id, r.to_id)}
    assert {("CONTAINS", "o:90000001"), ("CONTAINS", "p:90000002"), ("SUPPLIES", "p:90000002"), ("SUPPLIES", "s:90000003"), ("BASED_IN", "n:777")} <= got


def test_names_have_the_vectors_of_their_own_keys(spark, small, tmp_path):
    """All names are asked and all exist, whatever their keys."""
    parts, vectors = pd.read_parquet(f"{small}/part.parquet").head(2), pd.read_parquet(f"{small}/embeddings.parquet").head(3)
    parts["p_name"], parts["p_partkey"] = ["even", "odd"], parts["p_partkey"].dtype.type(1) * [702, 703]
    vectors["vec_id"] = vectors["vec_id"].dtype.type(1) * [202, 702, 703]
    asked, existing = queries._resolver_input(spark, changed(small, tmp_path, part=parts, embeddings=vectors))
    assert {r.query: list(r.query_embedding) for r in asked.collect()} == {"en": list(vectors["embedding"][1]), "d": list(vectors["embedding"][2])}
    assert {r.name: list(r.embedding) for r in existing.collect()} == {"even": list(vectors["embedding"][1]), "odd": list(vectors["embedding"][2])}
