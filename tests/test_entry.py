"""The registered queries without the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["corpus_pipeline", "colloquy.llm", "zstandard", "xxhash"])
def test_without_the_optional_part(missing):
    """A library, the folder or the pipeline that is not there takes only its own queries away."""
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as contract
from catalog import ORACLE, QUERIES
assert set(contract.queries()) == set(QUERIES) and contract.oracle_sql() == ORACLE
print(len(QUERIES))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 78
