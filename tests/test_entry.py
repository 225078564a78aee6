import importlib
import subprocess
import sys

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_names_can_be_read_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 40)"], capture_output=True, text=True)
    assert done.stdout.strip() == "True", done.stderr


def test_the_core_needs_no_subpackage():
    import ast
    import pathlib

    for path in pathlib.Path("driftwell").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("driftwell.llm") for n in names), path
