"""The entry works without the optional subpackage and the pipeline file."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_parts(tmp_path):
    keep = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests", "*.json", "*.md")
    shutil.copytree(REPO, tmp_path / "repo", ignore=keep)
    code = ("import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); "
            "assert 'lead_rows' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op1')]; print(len(q), len(s))")
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""},
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
