"""The entry module beside a package whose optional part is missing, or left as an empty folder."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "the pipeline alone"])
def test_other_queries_stay_without_the_training_part(workdir, left):
    shutil.copytree(os.path.join(ROOT, "fleetstops"), os.path.join(workdir, "fleetstops"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (left == "the pipeline alone"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), workdir)
    if left == "an empty folder":
        os.makedirs(os.path.join(workdir, "fleetstops", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(set(q) - set(e.oracle_sql())), any(n.startswith('op') for n in q))"
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=workdir, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 75 and out[1:] == ["0", "False"]
