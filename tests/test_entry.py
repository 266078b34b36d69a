import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names_and_oracles_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_text_operators_are_optional():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "purchases" in df.columns


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_queries_over_whole_tables_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda rows: sorted(str(tuple(f"{x:.6f}" if isinstance(x, float) else x for x in r)) for r in rows)
    assert text(df.select(*names).collect()) == text(want.fetchall())
