"""The package reaches workers that were started elsewhere."""

import os
import subprocess
import sys

from conftest import ROOT, SF

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", sys.argv[3]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
q = __spark_entry__.queries()
print("rows", q["chunk_segments_500"](spark, sys.argv[2]).count(), q["parse_summary_whole"](spark, sys.argv[2]).count())
print("files", len(spark.sparkContext.listFiles))
"""


def test_started_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(RUN)
    done = subprocess.run([sys.executable, "run.py", ROOT, SF, str(tmp_path / "local")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows " in done.stdout and "files 1" in done.stdout, done.stderr[-2000:]
    assert all(int(n) > 0 for n in done.stdout.split("rows ")[1].split("\n")[0].split())
