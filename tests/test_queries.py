"""Every registered query against its SQL on the smallest tables; the contract of the entry file."""

import duckdb
import pytest

from sluier.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def shown(value):
    if value is None or value != value:
        return "~"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n in registry.oracle_sql()])
def test_query_equals_sql(spark, oracle, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted("|".join(map(shown, row)) for row in df.select(*columns).collect())
    rows = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted("|".join(shown(row[i]) for i in order) for row in rows.fetchall())
    assert got == want


def test_all_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sluier.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("sluier.llm"):
                raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "w1_deidentify" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    sys.modules.pop("__spark_entry__")
