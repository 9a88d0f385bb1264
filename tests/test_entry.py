"""The entry module without the optional subpackage, in each way in which it may be absent."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["docledger/llm", "tests/llm", "corpus_pipeline.py"], ["docledger/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_entry_without_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        at = copy / name
        shutil.rmtree(at, ignore_errors=True) if not at.is_file() else at.unlink()
    code = (
        "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q);"
        "print(len(q), sum(n.startswith('op') and n[2:3].isdigit() for n in q), 'pipeline' in q)"
    )
    # with another copy of the repository on the path, and without
    for path in ({}, {"PYTHONPATH": str(ROOT)}):
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | path
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
        check(out, gone)


def check(out, gone):
    assert int(out[0]) > 80 and out[2] == "False"
    assert (out[1] == "0") == ("docledger/llm" in gone)
