import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
JOB = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from temporalis.functions.formula import Atom, Globally
from temporalis.functions.robustness import features
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
panel = s.createDataFrame([(i, "a", "TRAIN", [[float(i), 2.0]]) for i in range(5)], "series_id long, label string, split string, vars array<array<double>>")
rows = features(panel, [Globally(Atom(0, 1.0), 0, 1)], 2, vectorised=True).collect()
print("VALUES", sorted(r.feats[0] for r in rows))
"""


def test_workers_get_the_package_without_pythonpath(tmp_path):
    """The driver alone has the repository on its path, as where a job starts from another folder."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert "VALUES [-1.0, 0.0, 1.0, 1.0, 1.0]" in done.stdout, done.stderr[-2000:]
