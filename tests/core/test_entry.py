"""The driver's contract, with and without the package of training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

REPO = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry(spark, sf_dir):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderpriority", "avg_price"]
    assert df.count() == 5


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_training_operators(tmp_path):
    shutil.copytree(os.path.join(REPO, "tablewright"), tmp_path / "tablewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_sum' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_library_does_not_name_the_package():
    for folder, _, names in os.walk(os.path.join(REPO, "tablewright")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                assert "tablewright.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()
