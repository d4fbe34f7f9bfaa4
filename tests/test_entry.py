import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_never_imports_the_subpackage():
    for f in (ROOT / "markloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "markloom").parts:
            assert "markloom.llm" not in f.read_text(), f


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['markloom.llm'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert q and not any(k.startswith('p2_') for k in q) and 'p1_found' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_sql_has_a_query():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_runs(spark, sf):
    from markloom.plans import queries

    assert queries.scan_by_keys(spark, sf).columns == list(queries.SCAN_COLUMNS)
