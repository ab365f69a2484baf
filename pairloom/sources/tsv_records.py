"""9-column TSV whose content column holds physical newlines.

A record is complete once 8 tabs have been seen since the previous record. The line → record
assignment is a left fold over lines with an 8-state automaton (tabs pending 0..7), made parallel:

1. every line gets its position (file, line index) — lines are numbered per file with the slice-
   based dense index, so no single task sees a whole file;
2. lines are cut into blocks of ``block_lines``; each block (one ``applyInPandas`` group, bounded)
   computes, for each entry state 0..7, its exit state and how many records end inside it;
3. ``chain_blocks`` composes the blocks' maps on the cluster to every block's entry state and first
   record number;
4. each block gives its lines' record numbers from the known entry state. Only (file, position, tabs)
   moved so far; the text joins the numbers once, and records are regrouped (lines in order), split
   into 9 fields and cleaned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators.folds import chain_blocks
from ..operators.indexing import null_safe_join, range_row_index
from ..session import cut_lineage

N_TABS = 8
FIELDS = ["source", "url", "title", "none", "category", "content", "label_id", "ts", "null"]


def _line_maps(tabs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per line and entry state: the state after the line, and whether a record ends with it."""
    reached = np.arange(N_TABS) + np.minimum(tabs, N_TABS)[:, None]
    ends = reached >= N_TABS
    return np.where(ends, 0, reached), ends.astype(np.int64)


def _then(first: tuple, second: tuple) -> tuple:
    """Maps of the pairs (first, second), run in this order."""
    at, n = first
    return np.take_along_axis(second[0], at, 1), n + np.take_along_axis(second[1], at, 1)


def _block_total(tabs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exit state and records ended, for each entry state, by composing neighbours until one map is left."""
    at, n = _line_maps(tabs)
    while len(at) > 1:
        half = len(at) // 2 * 2
        pairs = _then((at[:half:2], n[:half:2]), (at[1:half:2], n[1:half:2]))
        at, n = (np.concatenate([pair, rest[half:]]) for pair, rest in zip(pairs, (at, n)))
    return at[0], n[0]


def _records_before(tabs: np.ndarray, entry: int) -> np.ndarray:
    """Per line, the records of the block that ended before it: prefix maps by doubling their reach."""
    at, n = _line_maps(tabs)
    reach = 1
    while reach < len(at):
        far = _then((at[:-reach], n[:-reach]), (at[reach:], n[reach:]))
        at, n = (np.concatenate([near[:reach], f]) for near, f in zip((at, n), far))
        reach *= 2
    return np.concatenate([[0], n[:-1, entry]])


def parse_multiline_tsv(lines: DataFrame, file: str = "file", order: str = "line_no", line: str = "line",
                        block_lines: int = 100_000) -> DataFrame:
    """(file, line order, line text without newline) → records (source, url, title, category, content, label, ts).

    A NULL file is a file, a NULL line an empty one. A trailing part of a record (fewer than 8 tabs at the end of a file) is not a record.
    """
    d = lines.select(F.col(file).cast("string").alias("file"), F.col(order).alias("_o"), F.coalesce(F.col(line), F.lit("")).alias("line"))
    d = range_row_index(d, [("_o", True)], out="pos", group=["file"])
    tabs = (F.length("line") - F.length(F.translate("line", "\t", ""))).cast("int")
    block = F.floor(F.col("pos") / block_lines).cast("bigint")
    narrow = cut_lineage(d.select("file", block.alias("block"), "pos", tabs.alias("tabs")))

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        exits, ended = _block_total(pdf.sort_values("pos")["tabs"].to_numpy())
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "block": [int(pdf["block"].iloc[0])], "exits": [exits.tolist()], "ended": [ended.tolist()]})

    maps = narrow.groupBy("file", "block").applyInPandas(transfer, "file string, block long, exits array<int>, ended array<long>")
    steps = F.zip_with("exits", "ended", lambda e, n: F.struct(e.alias("exit"), n.alias("n")))
    starts = chain_blocks(maps.select("file", "block", steps.alias("map")), ["file"])

    def tag(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        before = _records_before(pdf["tabs"].to_numpy(), int(pdf["entry"].iloc[0]))
        return pd.DataFrame({"file": pdf["file"], "pos": pdf["pos"], "record": before + int(pdf["first"].iloc[0]), "tabs": pdf["tabs"]})

    numbered = null_safe_join(narrow, starts, ["file", "block"]).groupBy("file", "block").applyInPandas(
        tag, "file string, pos long, record long, tabs int")
    tagged = null_safe_join(d.select("file", "pos", "line"), numbered, ["file", "pos"])
    recs = tagged.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"),
                                                F.sum("tabs").alias("_t"))
    recs = recs.filter(F.col("_t") >= N_TABS)
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    cols = F.split(text, "\t", len(FIELDS))
    recs = recs.select("file", "record", cols.alias("_c")).filter(F.size("_c") == len(FIELDS))
    c = lambda i: F.col("_c")[i]
    content = py_strip(F.replace(c(5), F.lit("\\\n"), F.lit("\n")))
    label = c(6)
    return recs.select("file", "record", c(0).alias("source"), c(1).alias("url"), py_strip(c(2)).alias("title"),
                       py_strip(c(4)).alias("category"), content.alias("content"), label.alias("label_id"),
                       py_strip(c(7)).alias("ts"), label.rlike(r"(?U)^\d+$").alias("label_is_int"))
