"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[0] == "o_orderkey" and df.count() > 0


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage(tmp_path):
    """Nothing else needs it: what is left imports and keeps its queries."""
    (tmp_path / "__spark_entry__.py").write_bytes((ROOT / "__spark_entry__.py").read_bytes())
    package = tmp_path / "tessera"
    for p in (ROOT / "tessera").rglob("*.py"):
        own = p.relative_to(ROOT / "tessera")
        if own.parts[0] != "llm":
            (package / own).parent.mkdir(parents=True, exist_ok=True)
            (package / own).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'range_number_le' in q and 'pipeline' not in q; print(len(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) > 30
