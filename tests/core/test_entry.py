"""The entry points without the training-data operators, or without a library they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BLOCK = """
import sys

class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry

names = set(entry.queries())
assert len(names) >= 140 and set(entry.oracle_sql()) <= names, len(names)
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""


@pytest.mark.parametrize("name", ["xxhash", "ahocorasick", "tessera.llm"])
def test_core_queries_stay_without_the_operators(name):
    done = subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
