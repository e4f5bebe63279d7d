"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from corpusmill import plans  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the data folder isn't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = rows_of(got.select(*columns).collect())
    if name not in plans.ORACLES:
        assert rows
        return
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows == rows_of(want.select(*columns).fetchall())


def test_the_library_stands_without_the_corpus_operators():
    entry = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("entry_alone", entry)
    hidden = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("corpusmill.llm") or k == "corpus_pipeline"}
    sys.modules["corpusmill.llm"] = sys.modules["corpus_pipeline"] = None
    try:
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        assert set(module.queries()) == set(plans.QUERIES) and set(module.oracle_sql()) == set(plans.ORACLES)
    finally:
        del sys.modules["corpusmill.llm"], sys.modules["corpus_pipeline"]
        sys.modules.update(hidden)
