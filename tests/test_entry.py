from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quirelake.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "bm25_topk" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_training_data_package():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_the_training_data_package():
    for path in (ROOT / "quirelake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quirelake.llm" not in path.read_text(), path


def test_flagship(spark, data):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "passage_id", "score", "rank", "retrieval_method"]
    assert out.count() > 0
