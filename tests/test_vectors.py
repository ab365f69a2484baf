"""Block grid, default encoder and order hinge against plain versions."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest

from pairloom.operators import losses as L
from pairloom.operators import vectors as VO


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_block_grid_equals_brute_force(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) * rng.uniform(0.1, 3, size=(60, 1))
    x[10:25] = x[9]  # many equal scores, in several blocks
    ids = [f"c{i:02d}" for i in range(60)]
    corpus = spark.createDataFrame([(c, v.tolist()) for c, v in zip(ids, x)] + [("none", None)], "cid string, vec array<double>")
    queries = spark.createDataFrame([(f"q{i}", x[i].tolist(), "hot" if i < 9 else f"g{i}") for i in range(12)], "qid string, vec array<double>, grp string")
    hidden = {("hot", c) for c in ids[:30]} | {("g9", "c40"), ("g9", "absent")}
    excluded = spark.createDataFrame(sorted(hidden) * 2, "grp string, cid string")
    got = {}
    for r in VO.topk_inner_product(queries, corpus, 8, metric, excluded, query_block=5, corpus_block=7).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.cid, round(r.score, 9))
    for i in range(12):
        grp = "hot" if i < 9 else f"g{i}"
        score = x @ x[i] if metric == "ip" else np.sqrt(np.maximum((x[i] ** 2).sum() + (x ** 2).sum(1) - 2 * (x @ x[i]), 0))
        rows = sorted((round(-s if metric == "ip" else s, 9), c) for c, s in zip(ids, score) if (grp, c) not in hidden)[:8]
        assert [(c, round(abs(s), 6)) for s, c in rows] == [(c, round(abs(s), 6)) for c, s in (got[f"q{i}"][k + 1] for k in range(8))]


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_several_groups_a_side_equal_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4)) * rng.uniform(0.1, 3, size=(90, 1))
    x[20:40] = x[1]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "qid long, vec array<double>")
    c = v.withColumnRenamed("qid", "cid")
    hidden = {(str(i % 6), i) for i in range(90)}
    out = VO.topk_inner_product(v.selectExpr("*", "string(qid % 6) AS grp"), c, 4, metric, spark.createDataFrame(sorted(hidden), "grp string, cid long"),
                                query_block=4, corpus_block=5, group_rows=16)
    assert out._jdf.queryExecution().toString().count("FlatMapCoGroups") > 0
    got = {}
    for r in out.collect():
        got.setdefault(r.qid, {})[r["rank"]] = round(abs(r.score), 6)
    cost = -(x @ x.T) if metric == "ip" else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * (x @ x.T), 0))
    for i in range(90):
        want = sorted(cost[i, j] for j in range(90) if (str(i % 6), j) not in hidden)[:4]
        assert np.allclose([got[i][k] for k in range(1, 5)], np.abs(want), atol=1e-5)


def test_a_vector_moves_once_for_each_group_of_the_other_side(spark):
    """Not once for each block: 300 blocks of one row and one group of 300 rows move the same."""
    v = spark.range(1, 301).selectExpr("id AS qid", "array(double(id), 1D) AS vec")
    moved = VO.topk_inner_product(v, v.withColumnRenamed("qid", "cid"), 2, query_block=300, corpus_block=1)
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 299" not in plan and plan.count("FlatMapCoGroups") == 1
    assert {(r.qid, r.cid) for r in moved.where("rank = 1").collect()} == {(i, 300) for i in range(1, 301)}


def test_two_nn_searches_once(spark, monkeypatch):
    cut = []
    monkeypatch.setattr(VO, "cut_lineage", lambda df: cut.append(df.columns) or df.localCheckpoint())
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(rng.normal(size=(80, 3)))], "vid long, vec array<double>")
    row = VO.two_nn_dimension(v).first()
    assert row.n == 72 and 1 < row.dimension < 6 and ["qid", "mu"] in cut


def test_empty_sides_and_no_negatives_left(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "qid long, vec array<double>")
    c = v.withColumnRenamed("qid", "cid")
    assert VO.topk_inner_product(v.limit(0), c, 2).count() == 0 and VO.topk_inner_product(v, c.limit(0), 2).count() == 0
    pos = spark.createDataFrame([("t", 1), ("t", 2)], "qtext string, cid long")
    q = spark.createDataFrame([(1, "t", [1.0]), (2, None, [1.0])], "qid long, qtext string, vec array<double>")
    assert {r.qid for r in VO.mine_hard_negatives(q, c, pos, 2).collect()} == {2}


def _encoded(text: str | None, dim: int = 64, n: int = 3) -> np.ndarray:
    s, out = f" {text or ''} ", np.zeros(64)
    for j in range(max(1, len(s) - n + 1)):
        d = int(hashlib.md5(s[j:j + n].encode()).hexdigest()[:8], 16)
        out[d % dim] += 1 if (d >> 16) & 1 else -1
    size = np.linalg.norm(out)
    return out / size if size else out


def test_default_encoder_is_the_plain_one_and_stays_in_the_jvm(spark):
    texts = [None, "", "a", "ab", "Ünï 日本語 \U0001f600\U0001f601 end", "word " * 3000, "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "emb_idx long, text string")
    out = VO.encode_texts(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.emb_idx: r.embedding for r in out.collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], _encoded(t), atol=1e-6), i
    assert VO.encode_texts(df, done=df.where("emb_idx < 5")).count() == 2


def test_order_hinge_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(8)
    for b in (1, 2, 3, 9, 14):
        s, t = rng.normal(size=(b, 4)), np.round(rng.normal(size=(b, 3)))  # ties on the teacher's side
        up = np.triu_indices(b, k=1)
        x, y = (s @ s.T)[up], (t @ t.T)[up]
        pairs = list(itertools.combinations(range(len(x)), 2))
        want = sum(max(0.0, 0.3 + (x[i] - x[j] if y[j] >= y[i] else x[j] - x[i])) for i, j in pairs) / max(1, len(pairs))
        assert abs(L.order_hinge(s, t, 0.3) - want) < 1e-9
    big = rng.normal(size=(512, 8))
    assert L.order_hinge(big, big, 0.0) == pytest.approx(0.0, abs=1e-9)
