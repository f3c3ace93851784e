import importlib.util
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["source", "label", "n"] and df.count() > 0


def test_imports_without_the_optional_parts():
    """What is left works where the subpackage is gone."""
    code = """
import importlib.util, sys
find = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name in ("scholion.llm", "corpus_pipeline") else find(name, *a)
import __spark_entry__ as e
assert "entities_by_source" in e.queries() and not any(n.startswith("op") for n in e.queries())
assert not any(m.startswith("scholion.llm") for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=HERE)


def test_nothing_else_imports_the_subpackage():
    for path in (HERE / "scholion").rglob("*.py"):
        if "llm" not in path.parts:
            assert "scholion.llm" not in path.read_text()
    assert importlib.util.find_spec("scholion") is not None
