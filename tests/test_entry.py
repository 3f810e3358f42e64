"""The driver's way in: any session, any working folder, nothing installed on the workers."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
driver = importlib.util.module_from_spec(spec)
spec.loader.exec_module(driver)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert driver.entry(spark).count() > 0
for name in ("reply_repair", "message_parts", "message_emails", "normalise_keys", "stream_latest_status", "numbered_lineitems"):
    assert driver.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_plain_session_from_another_folder(tmp_path):
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, entry], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in done.stdout, done.stderr[-3000:]
