"""Without the training-data subpackage everything else imports and works."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("larkspur.llm"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
from larkspur import queries
assert set(entry.queries()) == set(queries.queries()) and set(entry.oracle_sql()) == set(queries.oracle_sql())
import larkspur.engine, larkspur.__main__
assert not any(x.startswith("larkspur.llm") for x in sys.modules)
"""


def test_import():
    subprocess.run([sys.executable, "-c", SCRIPT], check=True, cwd=Path(__file__).resolve().parents[1])
