import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["url", "mismatch", "tag", "n_components"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_parts(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'compare_pages' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={"PYTHONPATH": str(tmp_path / "r"), "PATH": "/usr/bin:/bin", "HOME": "/root"}, check=True)


def test_the_operators_stay_without_the_pipeline(tmp_path):
    if not (REPO / "passerelle" / "llm").is_dir():
        return
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'op9_packing' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={"PYTHONPATH": str(tmp_path / "r"), "PATH": "/usr/bin:/bin", "HOME": "/root"}, check=True)
