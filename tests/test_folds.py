"""The tree of block maps, and the two folds that use it, against plain Python."""

from __future__ import annotations

import random

from pairloom.operators import batches as B
from pairloom.operators.folds import chain_blocks
from pairloom.sources.tsv_records import parse_multiline_tsv


def test_chain_blocks_against_a_loop(spark):
    rng = random.Random(5)
    maps, want = [], {}
    for group, blocks in ((None, 1), ("a", 7), ("b", 64), ("c", 33)):
        entry, first = 0, 0
        for b in range(blocks):
            m = [(rng.choice([0, 1, 2, -1 if rng.random() < 0.1 else 0]), rng.randrange(5)) for _ in range(3)]
            maps.append((group, b, m))
            if entry >= 0:
                want[group, b] = (entry, first)
                entry, first = m[entry][0], first + m[entry][1]
    df = spark.createDataFrame(maps, "g string, block long, map array<struct<exit: int, n: bigint>>")
    for fan_in in (2, 3, 32):
        got = {(r["g"], r["block"]): (r["entry"], r["first"]) for r in chain_blocks(df, ["g"], fan_in=fan_in).collect()}
        assert got == want
    assert chain_blocks(df.limit(0), ["g"]).count() == 0


def test_dynamic_plan_and_tsv_never_collect_maps():
    for f in (B.batch_plan_dynamic, parse_multiline_tsv):
        assert "collect" not in f.__code__.co_names and "toPandas" not in f.__code__.co_names


def _records(lines: list[str]) -> list[str]:
    out, parts, tabs = [], [], 0
    for line in lines:
        parts.append(line)
        tabs += line.count("\t")
        if tabs >= 8:
            out.append("\n".join(parts))
            parts, tabs = [], 0
    return out


def test_tsv_against_a_loop(spark):
    rng = random.Random(11)
    rows = []
    for file in (None, "x", "y"):
        for i in range(200):
            rows.append((file, i, "\t".join(rng.choice(["", "a", "bé", "7"]) for _ in range(rng.choice([1, 1, 2, 4, 9, 12])))))
    df = spark.createDataFrame(rows, "file string, line_no long, line string")
    got = {(r["file"], r["record"]): r["source"] for r in parse_multiline_tsv(df, block_lines=7).collect()}
    want = {}
    for file in (None, "x", "y"):
        for n, rec in enumerate(_records([line for f, _, line in rows if f == file])):
            want[file, n] = rec.split("\t")[0]
    assert got == want


def test_dynamic_plan_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "s", "t"]), rng.randrange(4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, subset string, neg_len int")
    flat = B.batch_plan_dynamic(df, ["id"], 1, 1, None, drop_last=False, block_rows=1000)  # one row a batch: its number is the position
    order = {}
    for r in flat.select("id", "subset", "batch_no").collect():
        order.setdefault(r["subset"], {})[r["batch_no"]] = r["id"]
    negs = {i: n for i, _, n in rows}
    want = {}
    for task, at in order.items():
        ids, p, no = [at[k] for k in sorted(at)], 0, 0
        while p < len(ids):
            pairs = 1 + min(negs[i] for i in ids[p:p + 8])
            size = (max(1, min(4, 6 // pairs)) if pairs > 1 else 4) * 2
            if p + size > len(ids):
                break
            want.update({i: (task, no, k) for k, i in enumerate(ids[p:p + size])})
            p, no = p + size, no + 1
    got = B.batch_plan_dynamic(df, ["id"], 4, 2, 6, block_rows=9).collect()
    assert {r["id"]: (r["task"], r["batch_no"], r["row_in_batch"]) for r in got} == want
