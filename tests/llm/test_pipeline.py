"""The corpus pipeline: every stage against plain Python or the operator's own rows, on a small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import BASE, shingle_set

import corpus_pipeline as cp

ROW = "doc_id long, text string, lang string, source string, n_chars long, `__id` string, `__hash` int, id string, `__lines` string"
JUNK, TOXIC, COPY = range(300, 320), range(320, 360), range(360, 366)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    path = str(tmp_path_factory.mktemp("tables"))
    texts = {i: " ".join(rng.choice(BASE, size=60)) for i in range(300)}
    texts |= {i: " ".join(["||||", "%%%%", "@@@@"] * 40) for i in JUNK}
    texts |= {i: " ".join([*rng.choice(BASE, size=30), f"zorg{rng.choice(['en', 'ist', 'ung'])}", *rng.choice(BASE, size=20)]) for i in TOXIC}
    texts |= {i: texts[i - 360] + " dog" for i in COPY}
    texts |= {366: None, 367: "", 368: texts[20] + "\nthis line stands in many texts", 369: texts[21] + "\nthis line stands in many texts", 370: texts[22] + " stone\nthis line stands in many texts"}
    rows = [(i, t, "en" if i % 50 else None, "s", len(t or ""), "x", 1, "y", "z") for i, t in texts.items()] + [(None, texts[30] + " heavy jugs", "en", "s", 1, "x", 1, "y", "z")]
    spark.createDataFrame(rows, ROW).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i not in JUNK), int(i in TOXIC)) for i in texts if i < 360] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in seen.collect()}
        out = stage(spark, seen, folder).cache()
        after = {r.doc_id: r for r in out.collect()}
        assert out.columns == columns and set(after) <= set(before) and len(after) == out.count(), name
        gone = set(before) - set(after)
        if name == "quality":
            assert set(JUNK) <= gone and len(gone) <= 30
        elif name == "toxicity":
            assert set(TOXIC) & set(before) <= gone and len(gone - set(TOXIC)) <= 3
        elif name == "line_dedup":
            shared = [i for i in (368, 369, 370) if i in after]
            assert not gone and sum("this line stands" in after[i].text for i in shared) == (1 if len(shared) >= 3 else len(shared))
            assert all(after[i].n_chars == len(after[i].text) for i in shared)
        else:
            sets = {i: shingle_set(r.text) for i, r in before.items()}
            for i in gone:  # each has a kept or dropped neighbour, and the smaller id of a pair stays
                assert any(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)
            left = [s for i, s in sets.items() if i in after and s]
            assert not any(len(a & b) >= 0.8 * len(a | b) for n, a in enumerate(left) for b in left[:n])
        if name != "line_dedup":
            assert all(after[i] == before[i] for i in after)
        seen = out
    packed = cp.STAGES[-1][1](spark, seen, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in packed) == sorted((i is None, i) for i in after)
    assert sorted(map(str, cp.run(spark, folder).collect())) == sorted(map(str, packed))


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    few = spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id") < 5)
    for _, stage in cp.STAGES[:2]:
        assert stage(spark, few, str(tmp_path)).count() == 5
