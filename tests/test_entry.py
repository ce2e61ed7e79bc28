"""The driver entry: with the training-data operators where they are installed, whole without them."""

import ast
import os
import shutil
import subprocess
import sys

from docengine.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def listed(folder, **env):
    run = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, env=os.environ | env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return [ast.literal_eval(line) for line in run.stdout.strip().splitlines()]


def copied(tmp_path, *left_out):
    for name in ("docengine", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *left_out))
        elif os.path.exists(source) and name not in left_out:
            shutil.copy(source, tmp_path / name)
    return tmp_path


def test_without_the_folders_of_the_training_data_operators(tmp_path):
    registry.load_all()
    queries, sql = listed(copied(tmp_path, "llm", "corpus_pipeline.py"))
    assert queries == sorted(registry.QUERIES) and sql == sorted(registry.ORACLES)


def test_with_the_pipeline_but_without_the_operators(tmp_path):
    registry.load_all()
    queries, _ = listed(copied(tmp_path, "llm"))
    assert queries == sorted(registry.QUERIES)


def test_nothing_else_imports_the_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "docengine")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert "docengine.llm" not in file.read()
