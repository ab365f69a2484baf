"""Triplets keep each text once: rows move addresses, whatever the texts' length; the store's texts come back as they were."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import text_store as TS
from pairloom.operators import triplets as TR

OPERATORS = {
    "triplets_by_label": lambda df: TR.triplets_by_label(df, "doc_id", "text", "label", num_negs=7, seed=1),
    "triplets_row_uniform": lambda df: TR.triplets_row_uniform(df, "doc_id", "text", "label", 7, 1),
    "triplets_title_body": lambda df: TR.triplets_given_pos(df.withColumn("title", F.concat(F.lit("about "), "text")), "doc_id", "title", "text", "label", 7, 1),
}


def word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))


def shuffled(plan) -> list[str]:
    """Types of what the plan's shuffles move, but for keys and buffers of aggregates."""
    found, stack = [], [plan]
    while stack:
        p = stack.pop()
        if p.nodeName() == "Exchange":
            found += [f.dataType().simpleString() for f in (p.schema().apply(i) for i in range(p.schema().length())) if f.name() not in ("label", "doc_id", "buf")]
        stack += [p.children().apply(i) for i in range(p.children().length())]
    return found


@pytest.mark.parametrize("name", OPERATORS)
def test_no_text_is_shuffled(spark, name):
    r = random.Random(5)
    rows = [(i, " ".join(word(r) for _ in range(40)), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    out = OPERATORS[name](df)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kinds = shuffled(out.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert kinds and not [k for k in kinds if "binary" in k or "string" in k], kinds
    got = out.collect()
    texts = {t for _, t, _ in rows}
    assert len(got) == 60 and all({x.pos, *x.neg} <= texts and len(x.neg) == 7 for x in got)


TEXTS = ["", None, "x", "word " * 3000, "Ünï \U0001f600", " ".join(word(random.Random(1)) for _ in range(500))]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("folder", [True, False])
def test_texts_come_back(spark, monkeypatch, small, folder):
    if small:  # a read and a batch for each row, no neighbours
        for name in ("READ_BYTES", "SHOW_BYTES", "GAP_BYTES"):
            monkeypatch.setattr(TS, name, 1)
        monkeypatch.setattr(TS, "RUN_BITS", 0)
    if not folder:  # a checkpoint folder that PyArrow does not open
        def closed(uri):
            raise OSError(uri)
        monkeypatch.setattr(TS, "open_folder", closed)
    store = TS.TextStore(spark)
    assert (store.folder is not None) == folder
    df = spark.createDataFrame([(i, t, f"title {i}") for i, t in enumerate(TEXTS)], "i long, t string, u string").repartition(3)
    kept = store.put(df, ["t", "u"]).checkpoint(eager=True)
    lists = [(0, [5, 3, 3, 1]), (1, []), (2, None), (3, [0, 1, 2, 3, 4, 5]), (4, [4])]
    at = spark.createDataFrame(lists, "g long, l array<long>").select("g", F.posexplode_outer("l").alias("p", "i"))
    at = at.join(kept, "i", "left").groupBy("g").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("p", "t")))).alias("x"))
    at = at.select("g", F.when(F.col("g") != 2, F.transform("x", lambda x: x["t"])).alias("ts"))
    rows = kept.join(at, F.col("i") == F.col("g"), "left").drop("g").coalesce(1)
    got = {r.i: (r.t, r.u, r.ts) for r in store.get(rows, ["t", "u", "ts"]).collect()}
    want = dict(lists)
    assert got == {i: (t, f"title {i}", None if want.get(i) is None else [TEXTS[k] for k in want[i]]) for i, t in enumerate(TEXTS)}
