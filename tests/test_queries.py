"""Every registered query against its DuckDB form, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from evidencelake.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"threads": 2})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, datetime.datetime)):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())


def shifted(tmp_path, by):
    """Embeddings, and those again with ids from ``by`` on, with the documents."""
    con = duckdb.connect()
    read = f"SELECT vec_id + x.i AS vec_id, embedding, label FROM '{D}/embeddings.parquet', (VALUES (0), ({by})) x(i)"
    con.execute(f"COPY ({read}) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"COPY (SELECT * FROM '{D}/documents.parquet') TO '{tmp_path}/documents.parquet'")
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["dq_graph"])
def test_section_numbers_that_two_documents_share(spark, tmp_path, name):
    con = shifted(tmp_path, 40_000)
    found = con.execute(catalog.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    expected = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == expected


def test_each_query_but_a_few_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"embed_batch", "vector_topk_ann"}
