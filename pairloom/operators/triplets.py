"""Triplet construction by label pools (M1–M5).

Label-pool sampling without holding any pool in memory and without drawing again:

* Every valid text gets one global position, ordered by (label, SHA-256 of the text, key), so a label is one run of
  positions and so is each text inside a label. A row is known by its position: keys may repeat or be NULL.
* What an anchor must not draw (its label, the texts equal to its anchor or positive) is a short list of runs. A pick is a number
  below the count of the other positions, moved past the runs that lie before it. So no candidate is ever rejected.
* Negatives: ``num_negs`` uniform draws of another label; a label drawn m times gives m of its usable positions by Floyd's subset
  sampling, which is distinct by construction. A draw whose label has none left is taken from all other usable positions,
  so a list is short only when the usable texts end. The order is by hash.
* Picks are 60-bit hashes. Texts are written once to a :class:`TextStore`; their handles are joined once, by position, and the last
  step reads the nine texts of each row. A shuffle of texts would keep nine copies of the table on disk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import h, h60
from ..functions.text import clean_and_check, py_strip
from ..session import cut_lineage
from .indexing import null_safe_join, range_row_index
from .text_store import TextStore, tasks_for
from .text_store import packed as _packed
from .text_store import unpacked as _unpacked  # noqa: F401

MAX_LITERAL_LABELS = 10_000  # label tables up to this many rows are broadcast


@dataclass
class LabelPools:
    texts: DataFrame  # the rows with their position ``_gi``, handles in place of their texts
    rows: DataFrame  # _gi, _lno, _off, _n (of the row's label), _runs: the runs of the row's text in all labels
    labels: DataFrame  # _lno, _off, _n; a NULL label is a label
    n_labels: int
    total: int
    store: TextStore
    size: int  # bytes of the pools' texts


def build_label_pools(valid: DataFrame, key: str, text: str, label: str, others: tuple[str, ...] = ()) -> LabelPools:
    """Positions of ``valid`` rows, their label runs and the runs of each row's text. ``others``: more text columns to store."""
    store = TextStore(valid.sparkSession)
    kept = store.put(valid.withColumn("_th", F.sha2(text, 256)), [text, *others])
    texts = range_row_index(kept, [(label, True), ("_th", True), (key, True)], out="_gi")
    narrow = texts.select("_gi", label, "_th", store.size(text).alias("_size"))
    sizes = narrow.groupBy(label).agg(F.min("_gi").alias("_off"), F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size"))
    # one row per label; up to MAX_LITERAL_LABELS of them are broadcast
    labels = cut_lineage(sizes.withColumn("_lno", (F.row_number().over(Window.orderBy("_off")) - 1).cast("bigint")))
    n_labels, total, size = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    labels = labels.drop("_size")
    small = F.broadcast(labels) if n_labels <= MAX_LITERAL_LABELS else labels
    numbered = null_safe_join(narrow.drop("_size"), small, [label]).drop(label)
    runs = numbered.groupBy("_th", "_lno").agg(F.min("_gi").alias("start"), F.count(F.lit(1)).alias("cnt"))
    runs = runs.groupBy("_th").agg(F.collect_list(F.struct("_lno", "start", "cnt")).alias("_runs"))  # at most one a label
    rows = cut_lineage(numbered.join(runs, "_th").drop("_th"))
    return LabelPools(texts.drop("_th"), rows, small.select("_lno", "_off", "_n"), n_labels, total, store, size)


def _skip(position: Column, runs: Column | str) -> Column:
    """``position`` counted outside of ``runs`` (disjoint, ascending structs with start and cnt) as a position among all."""
    return F.aggregate(runs, position, lambda p, r: F.when(p >= r["start"], p + r["cnt"]).otherwise(p))


def _subset(size: Column, m: Column, draw) -> Column:
    """``m`` distinct numbers below ``size`` by Floyd's method; ``draw(c)`` is the hash of step ``c`` = 1..m."""
    none = F.array().cast("array<bigint>")
    steps = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(m, F.lit(1)).cast("bigint")), lambda c: F.struct(
        (size - m + c - 1).alias("j"), F.pmod(draw(c), F.greatest(size - m + c, F.lit(1))).alias("t")))
    chosen = F.aggregate(steps, none, lambda s, x: F.concat(s, F.array(F.when(F.array_contains(s, x["t"]), x["j"]).otherwise(x["t"]))))
    return F.when(m > 0, chosen).otherwise(none)


def draw_positive(rows: DataFrame, pools: LabelPools, seed: int, tries: int = 20) -> DataFrame:
    """``rows`` + ``_p``, the positive's position, and ``_excl``, the runs of both texts.

    The positive is uniform over the label's positions with another text. As after ``tries`` tries in vain, the anchor is its own positive
    with the chance that ``tries`` uniform draws all have its text, and when no other text is there.
    """
    own = F.filter("_runs", lambda r: r["_lno"] == F.col("_lno"))[0]
    a = rows.withColumn("_own", own)
    free = F.col("_n") - F.col("_own.cnt")
    vain = h(seed, F.col("_gi"), "own") < F.pow(F.col("_own.cnt") / F.col("_n"), F.lit(tries)) * F.lit(float(1 << 32))
    other = _skip(F.col("_off") + F.pmod(h60(seed, F.col("_gi"), "pos"), F.greatest(free, F.lit(1))), F.array("_own"))
    a = a.withColumn("_p", F.when((free == 0) | vain, F.col("_gi")).otherwise(other)).drop("_own")
    drawn = pools.rows.select(F.col("_gi").alias("_p"), F.col("_runs").alias("_pruns"))
    both = F.array_sort(F.array_distinct(F.concat("_runs", "_pruns")))
    return a.join(drawn, "_p").withColumn("_excl", both).drop("_pruns", "_runs")


def draw_negatives(rows: DataFrame, pools: LabelPools, seed: int, num_negs: int) -> DataFrame:
    """``rows(_gi, _lno, _off, _n, _excl)`` → ``_gi, _negs``: positions of the negatives, in their order.

    ``_excl`` are the runs of the texts that the row excludes, ascending. Rows without any negative do not come back.
    """
    if pools.n_labels < 2 or num_negs <= 0:
        return rows.select("_gi", F.array().cast("array<bigint>").alias("_negs"))
    gi = F.col("_gi")

    def other_label(d: Column) -> Column:
        return F.pmod(h60(seed, gi, d, "lab"), F.lit(pools.n_labels - 1))

    labs = F.transform(F.sequence(F.lit(0), F.lit(num_negs - 1)), other_label)
    a = rows.select("_gi", F.struct("_lno", "_off", "_n").alias("_own"), "_excl", labs.alias("_labs"))
    a = a.withColumn("_labs", F.transform("_labs", lambda o: o + F.when(o >= F.col("_own._lno"), 1).otherwise(0)))
    per = a.withColumn("_lno", F.explode(F.array_distinct("_labs")))
    per = per.withColumn("_m", F.size(F.filter("_labs", lambda x: x == F.col("_lno"))).cast("bigint")).drop("_labs")
    per = per.join(pools.labels, "_lno").withColumn("_in", F.filter("_excl", lambda r: r["_lno"] == F.col("_lno")))
    usable = F.col("_n") - F.aggregate("_in", F.lit(0).cast("bigint"), lambda s, r: s + r["cnt"])
    per = per.withColumn("_u", usable).withColumn("_take", F.least("_m", "_u"))
    drawn = _subset(F.col("_u"), F.col("_take"), lambda c: h60(seed, gi, F.col("_lno"), c, "idx"))
    picks = F.transform(drawn, lambda x: _skip(F.col("_off") + x, F.col("_in")))
    per = per.select("_gi", "_own", "_excl", picks.alias("_picks"), (F.col("_m") - F.col("_take")).alias("_over"))
    got = per.groupBy("_gi").agg(F.first("_own").alias("_own"), F.first("_excl").alias("_excl"),
                                 F.array_sort(F.flatten(F.collect_list("_picks"))).alias("_picks"), F.sum("_over").alias("_over"))
    # labels without enough texts: the missing ones come from all positions that are left
    block = lambda start, cnt: F.struct(start.alias("start"), cnt.cast("bigint").alias("cnt"))
    outer = F.transform(F.filter("_excl", lambda r: r["_lno"] != F.col("_own._lno")), lambda r: block(r["start"], r["cnt"]))
    blocks = F.concat(F.array(block(F.col("_own._off"), F.col("_own._n"))), outer, F.transform("_picks", lambda p: block(p, F.lit(1))))
    got = got.withColumn("_blocks", F.when(F.col("_over") > 0, F.array_sort(blocks)))
    left = F.lit(pools.total) - F.aggregate("_blocks", F.lit(0).cast("bigint"), lambda s, r: s + r["cnt"])
    got = got.withColumn("_left", left)
    more = _subset(F.col("_left"), F.least("_over", "_left"), lambda c: h60(seed, gi, c, "fill"))
    more = F.when(F.col("_over") > 0, F.transform(more, lambda x: _skip(x, F.col("_blocks")))).otherwise(F.array().cast("array<bigint>"))
    ordered = F.array_sort(F.transform(F.concat("_picks", more), lambda g: F.struct(h60(seed, gi, g, "ord").alias("o"), g.alias("g"))))
    return got.select("_gi", F.transform(ordered, lambda x: x["g"]).alias("_negs"))


def _texts_at(lists: DataFrame, texts: DataFrame, positions: str, text: str, out: str, tasks: int | None = None) -> DataFrame:
    """``_gi`` and the handles of the texts at the listed positions, in their order, dealt over ``tasks``.

    A handle moves once for each list that holds it, so a column of texts is packed (zlib) before; ``TextStore.get`` ends the result."""
    handle = _packed(F.col(text)) if texts.schema[text].dataType == StringType() else F.col(text)
    one = lists.select("_gi", F.posexplode(positions).alias("_at", "_g"))
    one = one.join(texts.select(F.col("_gi").alias("_g"), handle.alias("_t")), "_g").drop("_g")
    one = one.repartition(tasks, "_gi") if tasks else one
    some = one.groupBy("_gi").agg(F.array_sort(F.collect_list(F.struct("_at", "_t"))).alias("_s"))
    return some.select("_gi", F.transform("_s", lambda s: s["_t"]).alias(out))


def clean_valid(df: DataFrame, text: str, out: str = "text", **kw) -> DataFrame:
    """Strip → clean_text → keep valid rows (cleaning evaluated once per row)."""
    keep = F.filter(F.array(clean_and_check(py_strip(F.col(text)), **kw)), lambda s: s["ok"])
    # a generator keeps the check and the cleaned text in one evaluation (a Filter would be
    # pushed below the projection and clean every row twice)
    c = df.select("*", F.explode(keep).alias("_cv"))
    return c.withColumn(out, F.col("_cv.text")).drop("_cv")


def triplets_by_label(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "label",
    num_negs: int = 7,
    seed: int = 42,
    pos_tries: int = 20,
    limit: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """M1: (key, text, label) → (key, anc, pos, neg[], label, *carry).

    Pools hold every valid text; ``limit`` (first anchors by key) cuts anchors only. Every valid row is an anchor, whether its
    key is NULL or occurs more than once; rows alike in label, text and key are numbered in an arbitrary order.
    """
    carry = tuple(carry)
    base = df.select(F.col(key), F.col(text).alias("_raw"), F.col(label).cast("string").alias("label"), *carry)
    pools = build_label_pools(clean_valid(base, "_raw").select(key, "text", "label", *carry), key, "text", "label")
    anchors, rows = pools.texts, pools.rows
    if limit is not None:
        anchors = anchors.orderBy(key, "_gi").limit(limit)
        rows = rows.join(anchors.select("_gi"), "_gi", "left_semi")
    with_pos = cut_lineage(draw_positive(rows, pools, seed, pos_tries))
    negs = draw_negatives(with_pos, pools, seed, num_negs)
    lists = with_pos.select("_gi", "_p").join(negs, "_gi", "left")
    lists = lists.select("_gi", F.concat(F.array("_p"), F.coalesce("_negs", F.array().cast("array<bigint>"))).alias("_list"))
    share = 1 if limit is None else min(limit, pools.total) / max(pools.total, 1)
    tasks = tasks_for(pools.size * share * (num_negs + 2))
    found = _texts_at(lists, pools.texts, "_list", "text", "_texts", tasks)
    rows = pools.store.get(anchors.repartition(tasks, "_gi").join(found, "_gi").drop("_gi"), ["text", "_texts"])
    return rows.select(
        F.col(key), F.col("text").alias("anc"), F.col("_texts")[0].alias("pos"),
        F.slice("_texts", F.lit(2), F.greatest(F.size("_texts") - 1, F.lit(0))).alias("neg"), "label", *carry)


def triplets_given_pos(
    df: DataFrame,
    key: str,
    anc: str,
    pos: str,
    label: str,
    num_negs: int = 7,
    seed: int = 42,
    carry: tuple[str, ...] = (),
    clean: bool = True,
) -> DataFrame:
    """M2/M3: anchor and positive are given (both cleaned and valid); negatives are other labels' positives
    (texts ≠ the row's positive). ``anc``/``pos`` are column names of already composed texts. Every valid row is an anchor,
    whether its key is NULL or occurs more than once."""
    from ..functions.text import clean_text, is_valid_text

    a = clean_text(F.col(anc)) if clean else F.col(anc)
    p = clean_text(F.col(pos)) if clean else F.col(pos)
    both = F.struct(a.alias("anc"), p.alias("pos"))
    keep = F.filter(F.array(both), lambda s: is_valid_text(s["anc"]) & is_valid_text(s["pos"]))
    valid = df.select(F.col(key), F.col(label).cast("string").alias("label"), *carry, F.explode(keep).alias("_ap"))
    valid = valid.select(key, "label", *carry, F.col("_ap.anc").alias("anc"), F.col("_ap.pos").alias("pos"))
    pools = build_label_pools(valid, key, "pos", "label", ("anc",))
    negs = draw_negatives(pools.rows.withColumn("_excl", F.array_sort("_runs")), pools, seed, num_negs)
    tasks = tasks_for(pools.size * (num_negs + 2))
    found = _texts_at(negs, pools.texts, "_negs", "pos", "_neg", tasks)
    rows = pools.texts.repartition(tasks, "_gi").join(found, "_gi", "left").drop("_gi")
    return pools.store.get(rows, ["anc", "pos", "_neg"]).select(
        key, "anc", "pos", F.coalesce("_neg", F.array().cast("array<string>")).alias("neg"), "label", *carry)


def triplets_row_uniform(df: DataFrame, key: str, text: str, label: str, num_negs: int = 7, seed: int = 42,
                         first_round: int | None = None) -> DataFrame:
    """M4: (text, label) rows, no cleaning. pos = uniform other row of the same label (the row itself when
    alone); negatives = uniform draws over *all rows*, rejected when the row is the anchor, has the
    anchor's label or repeats an accepted row; drawing stops after ``num_negs`` acceptances or
    ``20·num_negs`` rejections, and a short list is padded with the text of the previous row by key (of the last row for the first).

    Rows are numbered by (label, key), so a label is one run of positions and a draw is judged by its position alone: the whole
    process is one fold in a row, and texts are joined once. Draws after the first ``first_round`` are made only for rows still undecided.
    Rows are known by position; keys may repeat or be NULL.
    """
    K = num_negs
    base = df.select(F.col(key).alias("_key"), py_strip(F.coalesce(F.col(text), F.lit(""))).alias("text"),
                     F.col(label).cast("string").alias("label"))
    store = TextStore(df.sparkSession)
    base = range_row_index(store.put(base, ["text"]), [("label", True), ("_key", True)], out="_gi")
    sizes = cut_lineage(base.groupBy("label").agg(F.min("_gi").alias("_off"), F.count(F.lit(1)).alias("_n"), F.sum(store.size("text")).alias("_size")))
    n_labels, n, size_all = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    sizes = sizes.drop("_size")
    rows = null_safe_join(base.select("_gi", "_key", "label"), F.broadcast(sizes) if n_labels <= MAX_LITERAL_LABELS else sizes, ["label"])
    gi, off, size = F.col("_gi"), F.col("_off"), F.col("_n")
    other = off + F.pmod(h60(seed, gi, "pos"), F.greatest(size - 1, F.lit(1)))
    pos = F.when(size == 1, gi).otherwise(other + (other >= gi).cast("bigint"))

    def step(s: Column, j: Column) -> Column:
        done = (F.size(s["acc"]) >= K) | (s["rej"] >= 20 * K)
        ok = ((j < off) | (j >= off + size)) & ~F.array_contains(s["acc"], j)
        return F.struct(F.when(done | ~ok, s["acc"]).otherwise(F.concat(s["acc"], F.array(j))).alias("acc"),
                        F.when(done | ok, s["rej"]).otherwise(s["rej"] + 1).alias("rej"))

    def fold(state: Column, start: int, stop: int) -> Column:
        draws = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda d: F.pmod(h60(seed, gi, d, "neg"), F.lit(max(n, 1))))
        return F.aggregate(draws, state, step)

    start = F.struct(F.array().cast("array<bigint>").alias("acc"), F.lit(0).alias("rej"))
    some = first_round or 2 * K
    rows = rows.withColumn("_s", fold(start, 0, some))
    undecided = (F.size("_s.acc") < K) & (F.col("_s.rej") < 20 * K)
    rows = rows.withColumn("_s", F.when(undecided, fold(F.col("_s"), some, 21 * K)).otherwise(F.col("_s")) if some < 21 * K else F.col("_s"))
    lists = cut_lineage(rows.select("_gi", "_key", F.concat(F.array(pos), "_s.acc").alias("_list")))
    missing = F.lit(K + 1) - F.size("_list")
    if not lists.where(missing > 0).isEmpty():
        by_key = range_row_index(lists.select("_gi", "_key"), [("_key", True), ("_gi", True)], out="_k")
        before = by_key.select(F.col("_gi").alias("_prev"), F.pmod(F.col("_k") + 1, F.lit(n)).alias("_k"))
        prev = by_key.join(before, "_k").select("_gi", "_prev")
        lists = lists.join(prev, "_gi").withColumn("_list", F.concat("_list", F.array_repeat("_prev", F.greatest(missing, F.lit(0)))))
    tasks = tasks_for(size_all * (K + 2))
    found = _texts_at(lists, base, "_list", "text", "_texts", tasks)
    rows = store.get(base.repartition(tasks, "_gi").join(found, "_gi").drop("_gi"), ["text", "_texts"])
    return rows.select(F.col("_key").alias(key), F.col("text").alias("anc"), F.col("_texts")[0].alias("pos"),
                                          F.slice("_texts", 2, K).alias("neg"), "label")


def first_triplet(df: DataFrame, query: str = "query", pos: str = "pos", neg: str = "neg") -> DataFrame:
    """M5: (anchor, first positive, first negative), each stripped."""
    return df.select(py_strip(F.col(query)).alias("anc"), py_strip(F.try_element_at(pos, F.lit(1))).alias("pos"),
                     py_strip(F.try_element_at(neg, F.lit(1))).alias("neg"))
