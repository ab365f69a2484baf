"""Radix selection, range positions and the full mix on small tables with NULL keys and one hot group."""

import pytest
from pyspark.sql import functions as F

from pairloom.functions.hashing import h
from pairloom.operators import indexing as I
from pairloom.operators import mix as MX
from pairloom.operators import stats as ST


@pytest.fixture(scope="module")
def rows(spark):
    # subset "hot" holds two thirds, one subset has no name, keys repeat now and then
    d = spark.range(6000).select((F.col("id") - F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("k"),
                                 F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("subset"))
    return d.withColumn("hash", h(3, F.col("k")) % F.lit(1 << 20) * 4096)  # many equal hashes


@pytest.mark.parametrize("edge", [1, 40, 100_000])
def test_first_rows_of_each_group(spark, rows, edge):
    limits = spark.createDataFrame([("hot", 1500), (None, 77), ("s1", 0), ("s2", 10 ** 9), ("absent", 5)], "subset string, n long")
    marked = I.mark_first(rows, limits, F.col("hash"), ["k"], ["subset"], edge_rows=edge)
    assert marked.count() == 6000 and marked.columns == [*rows.columns, "first"]
    by = {}
    for r in rows.collect():
        by.setdefault(r.subset, []).append((r.hash, r.k))
    want = {s: sorted(by[s])[:n] for s, n in (("hot", 1500), (None, 77), ("s2", 10 ** 9))}
    got = {}
    for r in marked.where("first").collect():
        got.setdefault(r.subset, []).append((r.hash, r.k))
    assert {s: sorted(x) for s, x in got.items()} == want
    one = I.select_first(rows, spark.createDataFrame([(2000,)], "n long"), F.col("hash"), ["k", "subset"], edge_rows=edge).collect()
    assert sorted((r.hash, r.k) for r in one) == sorted(x for s in by.values() for x in s)[:2000]


def test_a_large_limit_ranks_only_rows_at_the_border(spark):
    d = spark.range(400_000, numPartitions=8).select("id", F.lit("hot").alias("subset"))
    limits = spark.createDataFrame([("hot", 300_000)], "subset string, n long")
    got = I.select_first(d, limits, h(1, F.col("id")), ["id"], ["subset"], edge_rows=1000)
    # rows come out in many tasks, not in the one of their group
    tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 300_000 and max(r["count"] for r in tasks) < 100_000


def test_positions_of_a_hot_group_come_from_many_partitions(spark):
    d = spark.range(50_000, numPartitions=8).select("id", F.lit("hot").alias("g"), F.concat(F.col("id") * 7919 % 50_000).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = I.range_row_index(d, [("v", True), ("id", True)], out="p", group=["g"])
        plan = got._jdf.queryExecution().toString()
        rows = got.select("v", "p", F.spark_partition_id().alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert "__rrislice" not in plan and [r.v for r in sorted(rows, key=lambda r: r.p)] == sorted(r.v for r in rows)
    assert sorted(r.p for r in rows) == list(range(50_000))


def test_null_subsets_stay(spark, rows):
    t = rows.select("subset", "k", F.lit("a").alias("anc"), F.lit("p").alias("pos"))
    n = t.where("subset IS NULL").count()
    plan = MX.allocation_plan(t, 6000)
    assert MX.build_mix(t, plan, 1, ["subset", "k"]).where("subset IS NULL").count() == n
    assert {r.subset: r.len for r in ST.dataset_summary(t, order_key="k").collect()}[None] == n
    for excluded in (["hot"], spark.createDataFrame([("hot",)], "x string")):
        assert MX.exclude_subsets(t, excluded).count() == 2000


def test_full_mix_of_folders(spark, tmp_path):
    root = f"file://{tmp_path}/gte"
    spark.createDataFrame([("q1", "p1", ["n1"], "x")], "anc string, pos string, neg array<string>, label string").write.parquet(f"{root}/one set")
    spark.createDataFrame([("q2", "d2"), ("q3", None)], "query string, document string").write.parquet(f"{root}/two")
    folders = MX.subset_folders(spark, root)
    planned = spark.createDataFrame([(i, f"a{i}", "p", s) for i, s in enumerate(["x"] * 6 + ["y"] * 3 + [None] * 3)], "id long, anc string, pos string, subset string")
    new = spark.createDataFrame([(i, f"r{i}", "p", "l") for i in range(9)], "id long, anc string, pos string, label string")
    sources = [MX.MixSource(planned), MX.MixSource(new, "replacement", "y"), MX.MixSource(folders, "whole")]
    mix = MX.build_full_mix(sources, 12, 42, ["id"]).collect()
    counts = {}
    for r in mix:
        counts[(r.role, r.subset)] = counts.get((r.role, r.subset), 0) + 1
    # 6 + 9 + 3 rows are there for 12 places
    assert counts == {("planned", "x"): 4, ("replacement", "y"): 6, ("planned", None): 2, ("whole", "one set"): 1, ("whole", "two"): 2}
    assert {r.label for r in mix if r.role == "replacement"} == {"l"} and {r.label for r in mix if r.role != "replacement"} == {""}
    assert sorted((r.anc, r.pos, tuple(r.neg)) for r in mix if r.role == "whole") == [("q1", "p1", ("n1",)), ("q2", "d2", ()), ("q3", "", ())]
    with pytest.raises(ValueError):
        MX.build_full_mix([MX.MixSource(new, "replacement")], 1, 1, ["id"])


def test_dynamic_plan_keeps_rows_without_a_task(spark):
    from pyspark.sql import functions as F

    from pairloom.operators import batches as B

    df = spark.range(400).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("subset"),
                                 F.array_repeat(F.lit("n"), (F.col("id") % 3).cast("int")).alias("neg"))
    plan = B.batch_plan_dynamic(df, ["id"], 4, 1, 6, drop_last=False, block_rows=50)
    assert plan.count() == 400 and plan.where("subset IS NULL").count() == 100
    counts = {c: [r.n for r in df.withColumn(c, v).select(B.negative_count(df.withColumn(c, v)).alias("n")).orderBy("id").collect()][:3]
              for c, v in (("neg_emb_idx", F.array(F.lit(1))), ("neg_num", F.lit(5)), ("neg_len", F.lit(None).cast("int")))}
    assert counts == {"neg_emb_idx": [1] * 3, "neg_num": [5] * 3, "neg_len": [0] * 3}
    assert [r.n for r in df.select(B.negative_count(df).alias("n")).limit(3).collect()] == [0, 1, 2]
