import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_subpackage():
    """The other queries stand without it, and only its absence is forgiven."""
    code = """
import sys
sys.modules["tidemark.llm"] = None
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 200 and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
