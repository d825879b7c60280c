"""The entry module with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    unexpressed = {"char_edit_ratio", "char_edit_stats"}
    own = {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"}
    assert own - set(entry.oracle_sql()) == unexpressed


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    away = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=away)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, check=True)
    n, corpus, n_sql = out.stdout.split()
    assert (int(n), corpus) == (len([q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]), "False")
    assert int(n_sql) == int(n) - 2


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(ROOT, "redline")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "redline.llm" not in f.read(), name
