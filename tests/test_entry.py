"""The entry module without the subpackage llm, whatever is left of its folder."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def keys_of(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    return list(map(int, out.stdout.split()))


def test_the_rest_stands_without_llm(tmp_path):
    from textlab.plans import catalog
    core = len(catalog.queries())
    copy = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "textlab"), copy / "textlab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    assert keys_of(copy) == [core, 0, core]
    os.makedirs(copy / "textlab" / "llm" / "__pycache__")  # what a deleted folder may leave behind
    assert keys_of(copy) == [core, 0, core]
