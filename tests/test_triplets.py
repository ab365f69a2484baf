"""Label triplets: NULL and repeated keys, short pools and hot texts against the SQL replay and by property; no join of texts but one."""

import collections

import duckdb
import pandas as pd
import pytest
from oracle_check import compare
from pyspark.sql import functions as F

from pairloom.operators import triplets as TR
from pairloom.plans import q_triplets as Q
from pairloom.plans.fixtures import Tables

NAMES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def text(i: int) -> str:
    return "a sentence about number " + " ".join(NAMES[int(c)] for c in str(i))


def documents(case: str) -> list[tuple]:
    rows = []
    if case == "keys":  # 20 keys twice, one NULL key, NULL labels
        rows = [(None if i == 0 else i % 40, text(i), [None, "a", "b"][i % 3]) for i in range(61)]
    elif case == "short":  # labels with fewer texts than draws, and all others together hardly enough
        rows = [(i, text(i), "big" if i < 30 else f"l{i % 4}") for i in range(36)]
    elif case == "few":  # fewer usable texts than draws
        rows = [(i, text(i), "ab"[i % 2]) for i in range(9)]
    elif case == "alike":  # one text holds most of all labels
        rows = [(i, text(0 if i % 4 else i), "abc"[i % 3]) for i in range(60)]
    elif case == "one_label":
        rows = [(i, text(i), "a") for i in range(5)]
    elif case == "many":
        rows = [(i, text(i % 50), f"l{i % 37:02}") for i in range(300)]
    return rows


CASES = ["keys", "short", "few", "alike", "one_label", "many", "empty"]


def frames(spark, case):
    rows = [(k, t, lab, "s") for k, t, lab in documents(case)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    con.register("pdf", pdf)
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM pdf")
    return rows, df, con


@pytest.mark.parametrize("case", CASES)
def test_triplets_by_label_cases(spark, case):
    rows, df, con = frames(spark, case)
    out = TR.triplets_by_label(df, "doc_id", "text", "lang", num_negs=7, seed=42, carry=("source",)).cache()
    got = out.collect()
    assert collections.Counter((r.doc_id, r.anc, r.label) for r in got) == collections.Counter((k, t, lab) for k, t, lab, _ in rows)
    pool = collections.Counter((t, lab) for _, t, lab, _ in rows)
    for r in got:
        assert (r.pos, r.label) in pool
        usable = collections.Counter()
        for (t, lab), n in pool.items():
            if lab != r.label and t not in (r.anc, r.pos):
                usable[t] += n
        assert len(r.neg) == min(7, sum(usable.values()))
        assert not collections.Counter(r.neg) - usable  # distinct positions: no text more often than the pools hold it
    sql = f"WITH {Q.label_triplets_sql(Q.DOC_SRC)} SELECT key AS doc_id, anc, pos, neg, label, subset AS source FROM trip"
    ok, msg = compare(out, con, sql)
    assert ok, msg


@pytest.mark.parametrize("case", ["keys", "alike", "few"])
def test_triplets_given_pos_cases(spark, case):
    rows, df, con = frames(spark, case)
    df = df.withColumn("title", F.concat(F.lit("the title of "), "text"))
    out = TR.triplets_given_pos(df, "doc_id", "title", "text", "lang", 7, 42)
    src = "src AS (SELECT doc_id AS key, 'the title of ' || text AS anc, text AS pos, lang AS label, '' AS subset FROM documents)"
    ok, msg = compare(out, con, f"WITH {Q.given_pos_sql(src)} SELECT key AS doc_id, anc, pos, neg, label FROM trip")
    assert ok, msg
    assert out.count() == len(rows)


@pytest.mark.parametrize("case", CASES)
def test_triplets_row_uniform_cases(spark, case):
    rows, df, con = frames(spark, case)
    out = TR.triplets_row_uniform(df, "doc_id", "text", "lang", 7, 42)
    assert out.count() == len(rows)
    ok, msg = compare(out, con, Q.row_uniform_sql())
    assert ok, msg


def test_negatives_are_uniform_over_labels_and_texts(spark):
    rows = [(i, text(i), "a" if i < 200 else "b" if i < 220 else "c") for i in range(420)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    label_of = {t: lab for _, t, lab in rows}
    out = TR.triplets_by_label(df, "doc_id", "text", "label", num_negs=4, seed=5).collect()
    by = collections.Counter(label_of[t] for r in out if r.label == "a" for t in r.neg)
    assert sum(by.values()) == 800 and abs(by["b"] - 400) < 80  # labels are drawn alike, however many texts they have
    of_b = collections.Counter(t for r in out if r.label == "a" for t in r.neg if label_of[t] == "b")
    assert len(of_b) == 20 and max(of_b.values()) < 3 * min(of_b.values())
    first = collections.Counter(label_of[r.neg[0]] for r in out if r.label == "a")
    assert abs(first["b"] - 100) < 35  # the order of a list says nothing of the label


def test_texts_are_not_persisted_and_moved_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    out = TR.triplets_by_label(t.documents, "doc_id", "text", "lang", num_negs=7, seed=11)
    out.count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 6 and "Window" not in plan.split("LogicalRDD")[0]
