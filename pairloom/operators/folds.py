"""Left folds over numbered blocks, as a tree of maps on the cluster.

A fold whose state is one of a few numbers turns each block into a map from entry state to (exit state, things
counted). ``chain_blocks`` composes the maps of ``FAN_IN`` neighbouring blocks into one, level by level, and hands the
entry states back down. Every level is a grouping of a table that is ``FAN_IN`` times smaller than the one below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .indexing import null_safe_join

#: blocks composed in one step; a group holds at most this many maps
FAN_IN = 64

#: type of a block's map: the element at a state (0-based) is the exit state, -1 for an ended fold, and the count
MAP_TYPE = "array<struct<exit: int, n: bigint>>"


def chain_blocks(maps: DataFrame, group: Sequence[str], block: str = "block", map_col: str = "map", fan_in: int = FAN_IN) -> DataFrame:
    """maps(*group, block from 0 without gaps, map) → (*group, block, ``entry``, ``first``): each block's entry state and the count before it.

    Every group's fold enters block 0 in state 0. Blocks behind the end of a fold (exit -1) have no row. NULL is a group; maps of one
    group have one length. Nothing but the number of levels reaches the driver.
    """
    group = list(group)
    low = cut_lineage(maps.select(*group, F.col(block).cast("bigint").alias("__cbblock"), F.col(map_col).cast(MAP_TYPE).alias("__cbmap")))
    last = low.agg(F.max("__cbblock")).first()[0]
    if last is None:
        return low.select(*group, F.col("__cbblock").alias(block), F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("first"))
    members = F.array_sort(F.collect_list(F.struct("__cbblock", "__cbmap"))).alias("__cbm")
    up = F.floor(F.col("__cbblock") / fan_in).cast("bigint").alias("__cbup")
    levels = [low]
    while last >= fan_in:
        parent = levels[-1].groupBy(*group, up).agg(members)
        levels.append(cut_lineage(parent.select(*group, F.col("__cbup").alias("__cbblock"), _composed("__cbm").alias("__cbmap"))))
        last //= fan_in
    known = None
    for level in reversed(levels):
        parent = level.groupBy(*group, up).agg(members)
        if known is None:  # one parent a group, entered at the start
            met = parent.select(*group, "__cbm", F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("first"))
        else:
            met = null_safe_join(parent, known.withColumnRenamed("__cbblock", "__cbup"), [*group, "__cbup"])
        entries = met.select(*group, F.explode(_entries("__cbm")).alias("__cbx"))
        known = cut_lineage(entries.select(*group, F.col("__cbx.block").alias("__cbblock"), "__cbx.entry", "__cbx.first").where("entry >= 0"))
    return known.withColumnRenamed("__cbblock", block)


def _composed(members: str):
    """One map that runs the members' maps one after the other."""
    start = F.transform(F.element_at(members, 1)["__cbmap"], lambda _, i: F.struct(i.cast("int").alias("exit"), F.lit(0).cast("bigint").alias("n")))

    def through(reached, member):
        def step(x):
            hop = F.get(member["__cbmap"], x["exit"])
            return F.when(x["exit"] < 0, x).otherwise(F.struct(hop["exit"].alias("exit"), (x["n"] + hop["n"]).alias("n")))
        return F.transform(reached, step)

    return F.aggregate(members, start, through)


def _entries(members: str):
    """(block, entry, first) of every member, when the first is entered in state ``entry`` with count ``first``."""
    none = F.array().cast("array<struct<block: bigint, entry: int, first: bigint>>")
    start = F.struct(F.col("entry").alias("at"), F.col("first").alias("n"), none.alias("out"))

    def through(s, member):
        hop = F.get(member["__cbmap"], s["at"])
        here = F.struct(member["__cbblock"].alias("block"), s["at"].alias("entry"), s["n"].alias("first"))
        at = F.when(s["at"] < 0, F.lit(-1)).otherwise(hop["exit"])
        n = F.when(s["at"] < 0, s["n"]).otherwise(s["n"] + hop["n"])
        return F.struct(at.alias("at"), n.alias("n"), F.concat(s["out"], F.array(here)).alias("out"))

    return F.aggregate(members, start, through, lambda s: s["out"])
