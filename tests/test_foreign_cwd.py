"""Operators whose Python code runs inside tasks must work when the package is not importable by the
workers (a driver started elsewhere, executors without an installed copy)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pairloom.session import local_session
from pairloom.sources.tsv_records import parse_multiline_tsv
from pairloom.functions.text import clean_text
from pyspark.sql import functions as F
spark = local_session("2")
rec = "\\t".join(["s", "u", "T", "none", "C", "a &amp; b\\nline", "1", "ts", "null"])
df = spark.createDataFrame([("f", i, x) for i, x in enumerate(rec.split("\\n"))], "file string, line_no long, line string")
out = parse_multiline_tsv(df, block_lines=1).select(clean_text(F.col("content")).alias("c")).collect()
assert out[0].c == "a & b line", out
print("OK")
"""


def test_runs_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=600)
    assert "OK" in r.stdout, r.stderr[-3000:]
