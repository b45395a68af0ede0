import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 35


def test_library_does_not_import_the_training_data_part():
    code = "import sys, quillspark.plans.registry, quillspark.plans.registry_tables, quillspark.plans.export, quillspark.streaming.incremental, quillspark.sources.tables; sys.exit(any(m.startswith('quillspark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_entry_without_the_training_data_part(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'likert_chi2' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r").returncode == 0


def test_flagship(spark):
    import __spark_entry__ as e

    if Path("/root/testdata/sf0.001").is_dir():
        assert e.entry(spark).count() > 0
