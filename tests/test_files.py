"""Files on shared storage: CSV trees in one plan, versions by URI, the bucketed vector store."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from pairloom.operators import vectors as VO
from pairloom.sources import files as FS


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def write(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text(content)


def test_csv_union_of_differing_headers(spark, tmp_path):
    write(tmp_path / "a" / "m1", "s.csv", "task,score\nA,1\ntask,score\n")  # a row like the header stays
    write(tmp_path / "a" / "m2", "s.csv", 'score,"the, task",extra\n2,"B, b",x\n3,C\n')
    write(tmp_path / "m3", "s.csv", "score,,score\n4,5,6\n")
    write(tmp_path / "m4", "s.csv", "")
    write(tmp_path / "m5", "s.csv", "task\n")
    write(tmp_path / "m5", "other.csv", "task\nno\n")
    u = FS.csv_union_with_path(spark, str(tmp_path), "s.csv")
    assert u.columns[0] == "model_path" and set(u.columns) == {"model_path", "task", "score", "the, task", "extra", "score0", "_c1", "score2"}
    got = sorted(tuple(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in u.collect())
    want = [{"model_path": "m1", "task": "A", "score": "1"}, {"model_path": "m1", "task": "task", "score": "score"},
            {"model_path": "m2", "score": "2", "the, task": "B, b", "extra": "x"}, {"model_path": "m2", "score": "3", "the, task": "C"},
            {"model_path": "m3", "score0": "4", "_c1": "5", "score2": "6"}]
    assert got == sorted(tuple(sorted(w.items())) for w in want)
    with pytest.raises(FileNotFoundError):
        FS.csv_union_with_path(spark, str(tmp_path), "none.csv")


def test_csv_union_of_many_files_is_one_scan(spark, tmp_path):
    for i in range(2000):
        write(tmp_path / f"m{i}", "s.csv", f"task,s{i % 3}\nt{i},{i}\n")
    u = FS.csv_union_with_path(spark, str(tmp_path), "s.csv")
    plan = plan_text(u)
    assert plan.count("Scan csv") == 2 and "Union" not in plan  # once in the tree, once in the details
    got = {r.model_path: (r.task, r.s0, r.s1, r.s2) for r in u.collect()}
    assert len(got) == 2000 and all(got[f"m{i}"] == (f"t{i}", *(str(i) if i % 3 == k else None for k in range(3))) for i in range(2000))


def test_resolve_version(spark, tmp_path):
    for v in ("1000", "5000", "x9000", "5000/99999"):
        write(tmp_path / "data" / v, "part.jsonl", "{}\n")
    for root in (f"{tmp_path}/data", f"file://{tmp_path}/data/", f"file:{tmp_path}/data"):
        base = root.rstrip("/")
        assert FS.resolve_version(spark, root, 1000) == (f"{base}/1000", None)
        assert FS.resolve_version(spark, root, 2000) == (f"{base}/5000", 2000)
        assert spark.read.text(FS.resolve_version(spark, root, 2000)[0]).count() >= 1
        for missing in (9000, 5001):
            with pytest.raises(ValueError):
                FS.resolve_version(spark, root, missing)
    with pytest.raises(ValueError):
        FS.resolve_version(spark, f"{tmp_path}/none", 1)


def test_vector_store_is_not_shuffled(spark, tmp_path):
    emb = spark.range(500).select(F.col("id").alias("emb_idx"), F.array(F.col("id").cast("double")).alias("embedding"))
    store = FS.write_vector_store(emb, "store_of_a_test", str(tmp_path / "store"), buckets=16)
    rows = [(1, 3, 499, [7, 7, 600, 2]), (None, 5, None, []), (2, 900, 4, None)]
    df = spark.createDataFrame(rows, "id long, anc_emb_idx long, pos_emb_idx long, neg_emb_idx array<long>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = VO.lookup_vectors(df, store, key=("id",))
        plan = plan_text(out)
        got = {r.id: (r.anc_emb_idx_vec, r.pos_emb_idx_vec, r.neg_vecs) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE store_of_a_test")
    assert got == {1: ([3.0], [499.0], [[7.0], [7.0], [2.0]]), None: ([5.0], None, []), 2: (None, [4.0], [])}
    tree = plan.split("\n\n")[0].splitlines()
    at = [i for i, line in enumerate(tree) if "store_of_a_test" in line]
    assert len(at) == 1  # one scan for all index columns
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    above, d = [], depth(tree[at[0]])
    for line in reversed(tree[:at[0]]):
        if depth(line) < d:
            above.append(line)
            d = depth(line)
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:join])  # only the asking rows move
