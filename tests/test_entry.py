import os
import shutil
import subprocess
import sys

import __spark_entry__ as driver

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 3


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_works_without_the_training_data_folders(tmp_path):
    for name in ("__spark_entry__.py", "pairwell"):
        src = os.path.join(REPO, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "pairwell" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as d; q = d.queries(); d.oracle_sql(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_nothing_else_imports_the_training_data_package():
    for folder, _, names in os.walk(os.path.join(REPO, "pairwell")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "pairwell.llm" not in f.read(), name
