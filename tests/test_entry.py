"""The driver's contract, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "doc_id" and df.count() == 200


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_documents' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "gridwarden").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
