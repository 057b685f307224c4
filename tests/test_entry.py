import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_training_data_operators(tmp_path):
    (tmp_path / "corpusloom").mkdir()
    for part in (ROOT / "corpusloom").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "corpusloom" / part.name).symlink_to(part)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; assert e.llm is None and 'bm25_topk' in e.queries() and 'op1_quality_rules' not in e.queries()"
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
