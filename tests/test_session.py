"""The package reaches workers that can't import it on their own."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from panelspark.session import local_session, ship
from panelspark.plans.catalog import QUERIES
spark = ship(local_session(2, "elsewhere"))
print("rows", QUERIES["adf_tests"].spark(spark, "/root/testdata/sf0.001").count())
"""


def test_udf_query_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in got.stdout, got.stderr[-2000:]
    assert int(got.stdout.rpartition("rows ")[2]) > 0
