"""The driver's contract, and that the corpus operators can be missing."""

import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"mxm_plus_times", "bfs_levels", "pagerank", "closure_min_plus"} <= set(sql)


def test_without_corpus_operators(tmp_path):
    code = "import sys\nclass No:\n    def find_spec(self, name, *a):\n        if name.startswith(('semiweave.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 100 and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_missing_module_inside_them_is_an_error():
    if not (ROOT / "semiweave" / "llm").exists():
        return
    code = "import sys\nclass No:\n    def find_spec(self, name, *a):\n        if name == 'xxhash': raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode != 0


def test_nothing_else_imports_them():
    for path in ROOT.glob("semiweave/**/*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path
