"""Workers that don't have the repository on their path get the package from the shared folder."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_without_the_package(tmp_path):
    code = """
        import sys
        sys.path.insert(0, ROOT)  # of the driver alone
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", HERE).getOrCreate()
        from waylattice.operators import paths
        from waylattice.operators.storage import ship
        ship(spark)
        edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0)], "u long, v long, length double")
        found = paths.pair_distances(spark.createDataFrame([(0, 2)], "source long, target long"), edges).first()
        assert tuple(found) == (0, 2, 5.0), found
        print("workers have it")
    """
    code = textwrap.dedent(code).replace("ROOT", repr(ROOT)).replace("HERE", repr(str(tmp_path / "shared")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "workers have it" in done.stdout, done.stderr[-2000:]
