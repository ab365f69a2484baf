"""Near-duplicates move few texts: a text that is in no candidate pair, or that stays, is not shuffled."""

import json
import os
import subprocess
import sys

import pytest

from pairloom.llm import near_join

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import random, sys
sys.path.insert(0, {REPO!r})
from pairloom.session import local_session
from pairloom.llm.near_join import one_of_each
out = sys.argv[1]
spark = local_session("4", **{{"spark.driver.memory": "2g", "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + out,
                              "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}})
rng = random.Random(3)
texts = [" ".join(f"{{rng.getrandbits(64):x}}" for _ in range(1200)) for _ in range(300)]
rows = [(i, t) for i, t in enumerate(texts + texts[:10] + [t + " end" for t in texts[10:20]])]
spark.createDataFrame(rows, "doc_id long, text string").write.parquet(out + "/docs.parquet")
one_of_each(spark.read.parquet(out + "/docs.parquet")).write.parquet(out + "/kept.parquet")
print("KEPT", spark.read.parquet(out + "/kept.parquet").select("doc_id").distinct().count(), sum(len(t) for _, t in rows))
spark.stop()
"""


def test_texts_that_stay_are_not_shuffled(tmp_path):
    r = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert "KEPT 300 " in r.stdout, r.stdout + r.stderr[-3000:]
    size = int(r.stdout.split("KEPT 300 ")[1].split()[0])
    log = next(p for p in tmp_path.iterdir() if p.is_file())
    moved = 0
    for line in log.read_text().splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            moved += e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    assert moved < size / 2  # one shuffle of all texts alone is nearly their size


@pytest.mark.parametrize("bits", [1 << 24, 2])
def test_rows_that_share_a_bit_are_decided_by_the_join(spark, monkeypatch, bits):
    monkeypatch.setattr(near_join, "KEY_BITS", bits, raising=False)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " end"), (3, long), (3, long), (4, "a text of its own, alone"), (4, "a text of its own, alone"), (None, "no id at all"),
            (None, "no id at all"), (0, "no id but zero, and other words"), (5, None), (6, ""), (7, "   "), (None, long), (8, "the last of these texts is alone")]
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, __page int")
    kept = near_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((str(r.doc_id), r.text) for r in kept.collect()), key=str) == sorted(
        [("None", long), ("4", rows[4][1]), ("None", "no id at all"), ("0", rows[8][1]), ("5", None), ("8", rows[13][1])], key=str)
