"""Batch-level distillation / contrastive loss metrics (L1–L10) as table operators.

Input: one row per anchor with ``batch_id``, ``row_in_batch``, student ``s``, teacher ``t`` (already cut to
the student's dimension) and candidate arrays ``cs`` / ``ct`` (positive first, then negatives; C per row).
Output: one row per batch. The per-batch similarity matrices are B×(B·C) NumPy products inside
``groupBy(batch_id).applyInPandas``: a group is exactly one training batch, so its size is bounded by the
batch size (checked), never by the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.vectors import sq_dist, truncate_dim

MAX_BATCH_ROWS = 1 << 16
CSE_TEMP = 0.05
JS_WEIGHTS = (10.0, 200.0, 20.0)  # fixed values: cosine, similarity, triplet weights
JS_MARGIN = 0.015
TAID_DEFAULTS = dict(t_start=0.4, t_end=1.0, alpha=5e-4, beta=0.99)


def batch_vectors(df: DataFrame, student_dim: int, use_pos: bool = True, use_neg: bool = True) -> DataFrame:
    """L10 inputs: (batch_id, row_in_batch, s, t, cs[], ct[], C) from the loss-input rows.

    Candidates are laid out positive first, then the first K negatives, K being the least number of negatives of
    a row in the batch. ``neg_teacher`` / ``neg_student`` hold one vector or an array of vectors; NULL is none.
    """
    d = df.withColumn("t", truncate_dim(F.col("teacher"), student_dim)).withColumn("s", F.col("student"))
    if not use_pos:
        return d.select("batch_id", "row_in_batch", "s", "t", F.array().cast("array<array<double>>").alias("cs"),
                        F.array().cast("array<array<double>>").alias("ct"), F.lit(0).alias("C"))
    d = d.withColumn("_ns", _vector_list(d, "neg_student")).withColumn("_nt", _vector_list(d, "neg_teacher"))
    own = F.least(F.size("_ns"), F.size("_nt"))
    d = d.withColumn("_k", F.min(own).over(Window.partitionBy("batch_id")) if use_neg else F.lit(0))
    pt = truncate_dim(F.col("pos_teacher"), student_dim)
    cs = F.concat(F.array("pos_student"), F.slice("_ns", F.lit(1), F.col("_k")))
    ct = F.concat(F.array(pt), F.transform(F.slice("_nt", F.lit(1), F.col("_k")), lambda v: truncate_dim(v, student_dim)))
    return d.select("batch_id", "row_in_batch", "s", "t", cs.alias("cs"), ct.alias("ct"), (F.col("_k") + 1).alias("C"))


def _vector_list(df: DataFrame, name: str) -> Column:
    """A column of one vector or of an array of vectors as an array of vectors; NULL is empty."""
    kind = df.schema[name].dataType
    several = kind.elementType.typeName() == "array"
    one = F.col(name) if several else F.array(name)
    empty = F.array().cast(kind if several else ArrayType(kind))
    return F.when(F.col(name).isNull(), empty).otherwise(one)


def candidate_layout(bv: DataFrame) -> DataFrame:
    """One row per candidate with its flat index ``row·C + c`` and whether it is the row's target."""
    x = bv.select("batch_id", "row_in_batch", F.col("C").alias("_ncand"), F.posexplode("cs").alias("_slot", "_v"))
    return x.select("batch_id", "row_in_batch", F.col("_slot").cast("int").alias("c"),
                    (F.col("row_in_batch") * F.col("_ncand") + F.col("_slot")).cast("bigint").alias("cand_index"),
                    (F.col("_slot") == 0).alias("is_target"))


# ---------------- NumPy kernels (one batch) ----------------

def _norm(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    m = z.max(axis=1, keepdims=True)
    return z - (m + np.log(np.exp(z - m).sum(axis=1, keepdims=True)))


def _ce(z: np.ndarray, target: np.ndarray) -> float:
    ls = _log_softmax(z)
    return float(-ls[np.arange(len(target)), target].mean())


def _mats(pdf: pd.DataFrame):
    pdf = pdf.sort_values("row_in_batch")
    if len(pdf) > MAX_BATCH_ROWS:
        raise ValueError("batch larger than MAX_BATCH_ROWS")
    s = np.stack(pdf["s"].to_numpy()).astype(np.float64)
    t = np.stack(pdf["t"].to_numpy()).astype(np.float64)
    C = int(pdf["C"].iloc[0])
    if C > 0:
        cs = np.concatenate([np.stack(list(x)) for x in pdf["cs"]]).astype(np.float64)
        ct = np.concatenate([np.stack(list(x)) for x in pdf["ct"]]).astype(np.float64)
    else:
        cs = ct = None
    return s, t, cs, ct, C


def kld(s, t, cs, ct, C, temp: float, taid_t: float | None = None) -> float:
    """L2: KL(teacher ‖ student) of row softmaxes of cosine/temp matrices, ÷ B, × max(1, temp²)."""
    sn, tn = _norm(s), _norm(t)
    if C > 0:
        zs, zt = sn @ _norm(cs).T / temp, tn @ _norm(ct).T / temp
    else:
        zs, zt = sn @ sn.T / temp, tn @ tn.T / temp
    if taid_t is not None:
        zt = (1 - taid_t) * zs + taid_t * zt
    lt, ls = _log_softmax(zt), _log_softmax(zs)
    return float((np.exp(lt) * (lt - ls)).sum() / len(s) * max(1.0, temp * temp))


def ckd(s, t, cs, ct, C, temp: float = CSE_TEMP, taid_t: float | None = None, queue: np.ndarray | None = None) -> float:
    """L3/L4: cross-entropy of normalised student anchors against teacher keys (+ queue), target i·C."""
    sn = _norm(s)
    keys = _norm(ct) if C > 0 else _norm(t)
    if taid_t is not None:
        if C > 1:
            raise ValueError("TAID-CKD with negatives is not supported (rows of keys ≠ anchors)")
        keys = _norm((1 - taid_t) * sn + taid_t * keys)
    if queue is not None and len(queue):
        keys = np.concatenate([keys, _norm(queue)])
    z = sn @ keys.T / temp
    return _ce(z, np.arange(len(s)) * max(1, C))


def infonce(s, cs, C, temp: float = CSE_TEMP) -> float:
    """Student anchors vs student candidates, target i·C."""
    z = _norm(s) @ _norm(cs).T / temp
    return _ce(z, np.arange(len(s)) * max(1, C))


def order_hinge(student: np.ndarray, teacher: np.ndarray, margin: float, cells: int = 1 << 22) -> float:
    """Mean hinge over all pairs of row pairs: the student's similarities should stand in the teacher's order.

    In the teacher's order (ties by place) every pair's loss is max(0, margin + earlier - later) over student similarities. Like a merge
    sort, each level takes the pairs whose earlier member is in a left half and whose later one is in the right half next to it:
    counts and sums of the left members above ``later - margin`` come from ranks, so P row pairs cost O(P log² P)
    and memory O(P); right members are taken ``cells`` at a time.
    """
    upper = np.triu_indices(len(student), k=1)
    s, t = (student @ student.T)[upper], (teacher @ teacher.T)[upper]
    n, total = len(s), 0.0
    if n < 2:
        return 0.0
    s = s[np.argsort(t, kind="stable")]
    by_size = np.argsort(s, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[by_size] = np.arange(n)
    below = np.searchsorted(s[by_size], s - margin, side="right")  # members that lose nothing against this one
    place, half = np.arange(n), 1
    while half < n:
        pair, right = place // (2 * half), (place // half) % 2 == 1
        left = np.flatnonzero(~right)
        left = left[np.argsort(pair[left] * n + rank[left])]
        keys, sums = pair[left] * n + rank[left], np.concatenate([[0.0], np.cumsum(s[left])])
        later = np.flatnonzero(right)
        for at in range(0, len(later), cells):
            r = later[at:at + cells]
            low, high = np.searchsorted(keys, pair[r] * n + below[r]), np.searchsorted(keys, (pair[r] + 1) * n)
            total += float(((high - low) * (margin - s[r]) + sums[high] - sums[low]).sum())
        half *= 2
    return total / (n * (n - 1) / 2)


def jasper_stella(s, t_side, taid_t: float | None = None) -> tuple[float, float, float, float]:
    """10·(1−cos) + 200·MSE(similarity matrices) + 20·pairwise-order hinge (margin 0.015)."""
    sn, tn = _norm(s), _norm(t_side)
    if taid_t is not None:
        tn = (1 - taid_t) * sn + taid_t * tn
    cos = float(np.mean(1 - (sn * tn).sum(1) / np.maximum(np.linalg.norm(sn, axis=1) * np.linalg.norm(tn, axis=1), 1e-8)))
    sim = float(np.mean((sn @ sn.T - tn @ tn.T) ** 2))
    tri = order_hinge(sn, tn, JS_MARGIN)
    wc, ws, wt = JS_WEIGHTS
    return wc * cos + ws * sim + wt * tri, wc * cos, ws * sim, wt * tri


# ---------------- Spark operators ----------------

def loss_mse(bv: DataFrame, taid_t: float | None = None) -> DataFrame:
    """L1 (and L8 on MSE): mean squared difference of raw student and teacher vectors per batch."""
    dim = F.size("s")
    sq = sq_dist(F.col("s"), F.col("t"))
    g = bv.groupBy("batch_id").agg((F.sum(sq) / F.sum(dim)).alias("loss"))
    if taid_t is not None:  # target (1−t)·s + t·teacher ⇒ loss scales by t²
        g = g.withColumn("loss", F.col("loss") * F.lit(taid_t * taid_t))
    return g.select("batch_id", F.round("loss", 6).alias("loss"))


def _per_batch(bv: DataFrame, fn, schema: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([fn(pdf)])

    return bv.groupBy("batch_id").applyInPandas(run, schema)


def loss_kld(bv: DataFrame, temp: float = 1.0, taid_t: float | None = None) -> DataFrame:
    def f(pdf):
        s, t, cs, ct, C = _mats(pdf)
        return {"batch_id": int(pdf["batch_id"].iloc[0]), "loss": round(kld(s, t, cs, ct, C, temp, taid_t), 6)}

    return _per_batch(bv, f, "batch_id long, loss double")


def loss_ckd(bv: DataFrame, temp: float = CSE_TEMP, taid_t: float | None = None) -> DataFrame:
    def f(pdf):
        s, t, cs, ct, C = _mats(pdf)
        return {"batch_id": int(pdf["batch_id"].iloc[0]), "loss": round(ckd(s, t, cs, ct, C, temp, taid_t), 6)}

    return _per_batch(bv, f, "batch_id long, loss double")


def loss_infonce(bv: DataFrame, temp: float = CSE_TEMP) -> DataFrame:
    def f(pdf):
        s, t, cs, ct, C = _mats(pdf)
        return {"batch_id": int(pdf["batch_id"].iloc[0]), "loss": round(infonce(s, cs, C, temp), 6)}

    return _per_batch(bv, f, "batch_id long, loss double")


def loss_js(bv: DataFrame, use_pos: bool = True, taid_t: float | None = None) -> DataFrame:
    """L5; with positives on, the teacher side is the positive teacher vector (C must be 1)."""

    def f(pdf):
        s, t, cs, ct, C = _mats(pdf)
        if C > 1:
            raise ValueError(f"Jasper/Stella loss does not support negatives: C={C}")
        side = ct if (use_pos and C == 1) else t
        tot, c, sm, tr = jasper_stella(s, side, taid_t)
        return {"batch_id": int(pdf["batch_id"].iloc[0]), "loss": round(tot, 6), "cosine_loss": round(c, 6),
                "similarity_loss": round(sm, 6), "triplet_loss": round(tr, 6)}

    return _per_batch(bv, f, "batch_id long, loss double, cosine_loss double, similarity_loss double, triplet_loss double")


def loss_combined(distil: DataFrame, bv: DataFrame, weight: float, cse_temp: float = CSE_TEMP) -> DataFrame:
    """``w·distil + (1−w)·InfoNCE`` per batch (one row per batch on both sides)."""
    cse = loss_infonce(bv, cse_temp).withColumnRenamed("loss", "cse_loss")
    j = distil.select("batch_id", F.col("loss").alias("distill_loss")).join(cse, "batch_id")
    return j.select("batch_id", F.round(F.col("distill_loss") * weight + F.col("cse_loss") * (1 - weight), 6).alias("loss"),
                    "distill_loss", "cse_loss")


def loss_ckd_queue(bv: DataFrame, queue_len: int, batch_rows: int, temp: float = CSE_TEMP,
                   train_col: str | None = None) -> DataFrame:
    """L4: CKD where batch b also scores against the teacher keys of earlier batches, newest first, the
    queue holding at most ``queue_len`` rows (the oldest batch keeps its first rows). With ``train_col``,
    only training batches push keys into the queue (validation batches read it but do not update it).

    Bounded history join: a batch's keys travel to the next ``ceil(queue_len / batch_rows)`` batch ids only
    (``batch_rows`` = the smallest batch, so the window always covers a full queue). The window counts
    batch ids, so with ``train_col`` a validation run between training batches must be covered by a
    smaller ``batch_rows``.
    """
    depth = -(-queue_len // batch_rows)
    keys = bv.select("batch_id", "row_in_batch", "t", "ct", "C")
    if train_col is not None:
        keys = keys.join(bv.select("batch_id", train_col).distinct(), "batch_id")
    pushed = keys.filter(F.col(train_col)) if train_col is not None else keys
    hist = pushed.select(F.explode(F.sequence(F.col("batch_id") + 1, F.col("batch_id") + depth)).alias("for_batch"),
                         F.col("batch_id").alias("src_batch"), "row_in_batch", "t", "ct", "C")
    own = keys.select(F.col("batch_id").alias("for_batch"), F.col("batch_id").alias("src_batch"), "row_in_batch", "t", "ct", "C")
    own = own.withColumn("_own", F.lit(True))
    hist = hist.withColumn("_own", F.lit(False))
    own = own.join(bv.select(F.col("batch_id").alias("for_batch"), F.col("row_in_batch"), "s"), ["for_batch", "row_in_batch"])
    allrows = own.unionByName(hist.withColumn("s", F.lit(None).cast("array<double>")))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["for_batch"].iloc[0])
        cur = pdf[pdf["_own"]].sort_values("row_in_batch")
        if cur.empty:
            return pd.DataFrame({"batch_id": [], "loss": [], "queue_rows": []})
        s = np.stack(cur["s"].to_numpy())
        C = int(cur["C"].iloc[0])
        ct = np.concatenate([np.stack(list(x)) for x in cur["ct"]]) if C > 0 else None
        t = np.stack(cur["t"].to_numpy())
        q_parts, total = [], 0
        past = pdf[~pdf["_own"]]
        for sb in sorted(past["src_batch"].unique(), reverse=True):
            if total >= queue_len:
                break
            part = past[past["src_batch"] == sb].sort_values("row_in_batch")
            kk = np.concatenate([np.stack(list(x)) for x in part["ct"]]) if C > 0 else np.stack(part["t"].to_numpy())
            kk = kk[: queue_len - total]
            q_parts.append(kk)
            total += len(kk)
        queue = np.concatenate(q_parts) if q_parts else np.zeros((0, s.shape[1]))
        loss = ckd(s, t, None if C == 0 else np.zeros((0,)), ct, C, temp, None, queue)
        return pd.DataFrame({"batch_id": [b], "loss": [round(loss, 6)], "queue_rows": [int(len(queue))]})

    return allrows.groupBy("for_batch").applyInPandas(f, "batch_id long, loss double, queue_rows long")


_BIG = 1e300


def _compose(f: tuple[float, float, float, float], g: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """g ∘ f for maps x ↦ min(H, max(L, p·x + q)) with p ≥ 0 and L ≤ H."""
    p1, q1, L1, H1 = f
    p2, q2, L2, H2 = g
    A, B = p2 * L1 + q2, p2 * H1 + q2
    if B < L2:
        return (0.0, L2, L2, L2)
    if A > H2:
        return (0.0, H2, H2, H2)
    return (p2 * p1, p2 * q1 + q2, max(A, L2), min(B, H2))


def _step_map(momentum: float, linear: float, t_end: float, alpha: float, disable_adaptive: bool) -> tuple[float, float, float, float]:
    """One step's update of t as (p, q, L, H) of x ↦ min(H, max(L, p·x + q)); ``linear`` is the step's linear schedule."""
    if disable_adaptive:
        return 0.0, linear, linear, linear
    if linear > t_end:
        return 0.0, t_end, t_end, t_end
    gain = alpha / (1 + np.exp(-momentum))
    return 1 - gain, gain, linear, t_end


def taid_schedule(log: DataFrame, run: str = "run", step: str = "step", loss: str = "loss", total_steps: int | None = None,
                  t_start: float = 0.4, t_end: float = 1.0, alpha: float = 5e-4, beta: float = 0.99,
                  disable_adaptive: bool = False, block_rows: int = 100_000) -> DataFrame:
    """TAID's t (and momentum) after each logged step of a run; the first step only stores the loss.

    Steps are 0-based and dense per run (progress = step / steps of the run, or ``total_steps``). The fold
    is made parallel by blocks of ``block_rows`` steps, so no run is held by one task:

    1. momentum is linear (m ← β·m + (1−β)·r): each block reports (βⁿ, its own contribution), the driver
       chains the blocks' entry momenta;
    2. with momentum known, each step's update t ↦ min(t_end, max(lin, a + (1−a)·t)) is a clamped affine map
       with non-negative slope; a block composes its steps into one such map and the driver chains the
       blocks' entry values of t;
    3. every block replays its steps from its entry state. The driver sees a few numbers per block.
    """
    if not (0.0 <= t_start < 1.0 and 0.0 < t_end <= 1.0 and 0.0 <= alpha <= 1.0):
        raise ValueError("TAID parameters out of range")
    d = log.select(F.col(run).alias("_run"), F.col(step).cast("bigint").alias("_step"), F.col(loss).cast("double").alias("_loss"))
    sizes = d.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    prev = d.select("_run", (F.col("_step") + 1).alias("_step"), F.col("_loss").alias("_prev"))
    d = d.join(prev, ["_run", "_step"], "left").join(sizes, "_run")
    # blocks grow with the log so the driver receives at most ~500k block summaries per pass
    n_total, n_runs = sizes.agg(F.sum("_n"), F.count(F.lit(1))).first()
    block_rows = max(block_rows, -(-(n_total or 0) // max(1, 500_000 - (n_runs or 0))))
    d = d.withColumn("_block", F.floor(F.col("_step") / block_rows).cast("bigint")).persist()
    tot = total_steps
    rtype = log.schema[run].dataType.simpleString()

    def rel_of(pdf):
        p, lv = pdf["_prev"].to_numpy(), pdf["_loss"].to_numpy()
        return (p - lv) / (p + 1e-15)

    def pass1(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_step")
        rows = pdf[pdf["_prev"].notna()]
        pw, loc = 1.0, 0.0
        for r in rel_of(rows):
            loc = beta * loc + (1 - beta) * r
            pw *= beta
        return pd.DataFrame({"_run": [pdf["_run"].iloc[0]], "_block": [int(pdf["_block"].iloc[0])], "pw": [pw], "loc": [loc]})

    m_sum = d.groupBy("_run", "_block").applyInPandas(pass1, f"_run {rtype}, _block long, pw double, loc double").collect()
    m_in: dict = {}
    for rr in sorted({(r["_run"],) for r in m_sum}):
        m = 0.0
        for r in sorted((x for x in m_sum if x["_run"] == rr[0]), key=lambda x: x["_block"]):
            m_in[(rr[0], r["_block"])] = m
            m = r["pw"] * m + r["loc"]
    spark = log.sparkSession
    m_df = spark.createDataFrame([(k[0], k[1], v) for k, v in m_in.items()], f"_run {rtype}, _block long, _m_in double")
    d2 = d.join(F.broadcast(m_df), ["_run", "_block"])

    def pass2(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_step")
        n = tot or int(pdf["_n"].iloc[0])
        m = float(pdf["_m_in"].iloc[0])
        f = (1.0, 0.0, -_BIG, _BIG)  # identity (finite bounds: NaN would cross Arrow as NULL)
        for st, pv, lv in zip(pdf["_step"].to_numpy(), pdf["_prev"].to_numpy(), pdf["_loss"].to_numpy(), strict=True):
            if np.isnan(pv):
                continue
            m = beta * m + (1 - beta) * ((pv - lv) / (pv + 1e-15))
            lin = t_start + (t_end - t_start) * (st / n)
            g = _step_map(m, lin, t_end, alpha, disable_adaptive)
            f = _compose(f, g)
        return pd.DataFrame({"_run": [pdf["_run"].iloc[0]], "_block": [int(pdf["_block"].iloc[0])],
                             "p": [f[0]], "q": [f[1]], "lo": [f[2]], "hi": [f[3]]})

    t_maps = d2.groupBy("_run", "_block").applyInPandas(
        pass2, f"_run {rtype}, _block long, p double, q double, lo double, hi double").collect()
    t_in: dict = {}
    for rr in sorted({(r["_run"],) for r in t_maps}):
        t = t_start
        for r in sorted((x for x in t_maps if x["_run"] == rr[0]), key=lambda x: x["_block"]):
            t_in[(rr[0], r["_block"])] = t
            t = min(r["hi"], max(r["lo"], r["p"] * t + r["q"]))
    t_df = spark.createDataFrame([(k[0], k[1], v) for k, v in t_in.items()], f"_run {rtype}, _block long, _t_in double")
    d3 = d2.join(F.broadcast(t_df), ["_run", "_block"])

    def pass3(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_step")
        n = tot or int(pdf["_n"].iloc[0])
        m, t, out = float(pdf["_m_in"].iloc[0]), float(pdf["_t_in"].iloc[0]), []
        for st, rel in zip(pdf["_step"].to_numpy(), rel_of(pdf), strict=True):
            if not np.isnan(rel):  # a run's first step only stores its loss
                m = beta * m + (1 - beta) * rel
                p, q, low, high = _step_map(m, t_start + (t_end - t_start) * (st / n), t_end, alpha, disable_adaptive)
                t = min(high, max(low, p * t + q))
            out.append((round(t, 6), round(m, 6)))
        return pd.DataFrame(out, columns=["t", "momentum"]).assign(_run=pdf["_run"].to_numpy(), _step=pdf["_step"].to_numpy())[["_run", "_step", "t", "momentum"]]

    out = d3.groupBy("_run", "_block").applyInPandas(pass3, f"_run {rtype}, _step long, t double, momentum double")
    return out.select(F.col("_run").alias(run), F.col("_step").alias(step), "t", "momentum")
