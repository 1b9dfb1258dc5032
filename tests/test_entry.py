import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("burstlake.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert len(q) > 50 and not [k for k in q if k.startswith("op") or k == "pipeline"], sorted(q)
assert set(e.oracle_sql()) <= set(q)
"""


def test_entry_without_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for p in (ROOT / "burstlake").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "burstlake.llm" not in p.read_text(), p


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["slice_id", "t", "snr", "width", "prob", "confidence", "is_burst"]
