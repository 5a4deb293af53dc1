"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

REPO = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.count() == 20


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_optional_parts(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "tessera.llm" or name.startswith("tessera.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "pipeline" not in e.queries() and not any(n.startswith("op") for n in e.queries())
assert len(e.queries()) > 50
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_without_a_module_that_optional_parts_need():
    code = """
import sys, warnings
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "xxhash":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
assert any("xxhash" in str(w.message) for w in said)
assert "pipeline" not in e.queries() and len(e.queries()) > 50
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
