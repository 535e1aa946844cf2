"""Sessions without spark.checkpoint.dir."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
from sentinelle.session import local_session, settled
from sentinelle.llm.registry import queries
spark = local_session("2", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("rows", queries()["op3_line_spread"](spark, "/root/testdata/sf0.001").count(), settled(spark.range(3)).count())
"""


def test_a_plain_session_has_a_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(name, None)
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 200 3" in done.stdout, done.stderr[-2000:]
