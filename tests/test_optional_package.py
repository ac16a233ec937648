"""The entry point without the optional training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

PROBE = """
import __spark_entry__ as E
from keyfold.plans.catalogue import ORACLES, QUERIES
assert E.queries().keys() == QUERIES.keys(), E.queries().keys() ^ QUERIES.keys()
assert E.oracle_sql().keys() == ORACLES.keys()
"""


@pytest.mark.parametrize("pipeline_file", [True, False])
def test_entry_without_the_llm_folders(tmp_path, pipeline_file):
    gone = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline_file else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=gone)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
