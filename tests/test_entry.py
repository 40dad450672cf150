import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_parts(tmp_path):
    """The entry module and the catalogue work where the training-data subpackage and its pipeline are absent."""
    import shutil

    shutil.copytree(ROOT / "lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q1' in q and 'pipeline' not in q, q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_nothing_else_imports_the_optional_parts():
    for p in (ROOT / "lodestar").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module}"] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p
