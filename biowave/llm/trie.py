"""Prefix trie of conversations by prefix doubling.

Contents of turns get dense names, and so do, round by round, aligned blocks of two, four, eight turns and so on: a block's
name is that of the pair of names it consists of. A prefix of d turns is, by the binary digits of d, one block after
another, so rounds the other way round name prefixes: first those whose length is a multiple of the largest block, then of
half of it. Names stand for verified contents, no hash is trusted. Both ways take as many rounds as the longest conversation
has binary digits, and handle each turn about twice.

A node is then a group of prefix rows. Sums over subtrees need no walk either: each node belongs to its smallest member,
whose path below is its own, so they are sums over the members of what is left of each one's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biowave.llm.common import materialize

STRETCH = 4096  # turns of one conversation that one task sums in order


def dense_names(kinds: DataFrame, name: str) -> DataFrame:
    """The rows of kinds, which are distinct, with dense numbers from 0.

    Rows are written with the task that wrote them and their place in it; the tasks' sums before, one row a task, are added.
    """
    placed = materialize(kinds.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    named = placed.withColumn("_task", task).join(F.broadcast(starts), "_task")  # as many rows as the write had tasks
    return named.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_task", "_start", "_at")


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their place from 1 within their key, in the order given. A key with many rows is numbered in ranges."""
    ranged = rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    placed = materialize(ranged.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))))
    sizes = placed.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, [key, "_range"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def named_turns(conversations: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(turns, contents): turns has conv_id, depth from 1, content, bytes; contents has content, role, text.

    Turns are ordered by turn, a null one first, then by role and text; rows alike are turns each. Null role and text are
    empty. Rows with a null id belong to no conversation and are left out, as are other columns.
    """
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # names in the order of role and text: ties in turn can then be told by name
    kinds = rows.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    contents = materialize(dense_names(kinds, "content"))
    light = contents.withColumn("bytes", F.octet_length("text").cast("bigint"))
    met = rows.join(light, ["role", "text"]).select("conv_id", "turn", "content", "bytes")
    turns = numbered(met, "conv_id", ["turn", "content"], "depth").select("conv_id", "depth", "content", "bytes")
    return materialize(turns), contents


def _blocks(turns: DataFrame) -> list[DataFrame]:
    """For each power of two the named aligned blocks of that many turns: conv_id, place, block."""
    levels = [turns.select("conv_id", (F.col("depth") - 1).alias("place"), F.col("content").alias("block"))]
    while True:
        half = levels[-1].groupBy("conv_id", F.shiftright("place", 1).alias("place"))
        second = F.col("place").bitwiseAND(1) == 1
        pair = half.agg(F.max(F.when(~second, F.col("block"))).alias("a"), F.max(F.when(second, F.col("block"))).alias("b"))
        pair = materialize(pair.where("b IS NOT NULL"))
        if pair.isEmpty():
            return levels
        names = dense_names(pair.select("a", "b").distinct(), "block")
        levels.append(materialize(pair.join(names, ["a", "b"]).select("conv_id", "place", "block")))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, prefix): each prefix of each conversation, the empty one of depth 0 too. At one depth prefixes have
    the same name exactly if they are the same turns."""
    whole = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("prefix"))
    levels = _blocks(turns)
    for k in range(len(levels) - 1, -1, -1):
        # prefixes with k as their lowest binary digit end in a block of 2^k turns that starts at a multiple of 2^(k+1)
        last = levels[k].where(F.col("place").bitwiseAND(1) == 0).select("conv_id", F.shiftleft("place", k).alias("depth"), "block")
        grown = last.join(whole, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), "prefix", "block")
        grown = materialize(grown)
        names = dense_names(grown.select("depth", "prefix", "block").distinct(), "name")
        named = grown.join(names, ["depth", "prefix", "block"]).select("conv_id", "depth", F.col("name").alias("prefix"))
        whole = whole.unionByName(materialize(named))
    return whole


def _left_after(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (conv_id, depth, ...) with the sum of value from this depth to the conversation's end; long ones go by stretches."""
    rows = rows.withColumn("_stretch", F.floor(F.col("depth") / STRETCH))
    inside = Window.partitionBy("conv_id", "_stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "_stretch").agg(F.sum(value).alias("_sum"))
    sums = sums.select("conv_id", "_stretch", F.coalesce(F.sum("_sum").over(after), F.lit(0)).alias("_after"))
    summed = rows.withColumn("_inside", F.sum(value).over(inside)).join(sums, ["conv_id", "_stretch"])
    return summed.withColumn(name, F.col("_inside") + F.col("_after")).drop("_stretch", "_inside", "_after")


@dataclass
class Trie:
    nodes: DataFrame  #: depth, conv_id, parent_conv_id, content (null: the root), bytes, n_convs, n_children, n_leaves, saved_bytes
    members: DataFrame  #: conv_id, depth, node_conv_id: each conversation at each node that it starts with
    ends: DataFrame  #: conv_id, depth, node_conv_id: each conversation at the node that it ends in


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of conversations: turns (conv_id, depth from 1 without gaps, content, bytes) of convs (conv_id, distinct).

    A node is a depth and its smallest conversation. The textless root is a node wherever there are conversations; those without
    turns end in it. saved_bytes sums over a subtree what its nodes' texts needn't be stored again: (n_convs - 1) times bytes.
    An empty table gives no nodes.
    """
    rows = prefixes(turns, convs).join(turns.select("conv_id", "depth", "content", "bytes"), ["conv_id", "depth"], "left")
    rows = materialize(rows.withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("bigint"))))
    # written, so that both sides of the join are exchanges and the root, where all conversations are, can be split
    heads = materialize(rows.groupBy("depth", "prefix").agg(F.min("conv_id").alias("node_conv_id")))
    owned = rows.join(heads, ["depth", "prefix"]).withColumn("_own", F.col("conv_id") == F.col("node_conv_id"))
    members = materialize(owned.select("conv_id", "depth", "node_conv_id", "content", "bytes", "_own"))
    # a node's parent is where its smallest member was a turn before
    own = members.where("_own").select("conv_id", "depth", "content", "bytes")
    above = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node_conv_id").alias("parent_conv_id"))
    tops = materialize(own.join(above, ["conv_id", "depth"], "left"))
    children = tops.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    tops = materialize(tops.join(children, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))
    # a childless node is the end of its smallest member, which is a member of all nodes above: leaves are counted there
    leaves = tops.where("n_children = 0").select("conv_id").distinct().withColumn("_leaf", F.lit(1).cast("bigint"))
    costs = _left_after(members.withColumn("_again", F.when(F.col("_own"), F.lit(0).cast("bigint")).otherwise(F.col("bytes"))), "_again", "_saved")
    summed = (
        costs.join(leaves, "conv_id", "left")
        .groupBy("depth", F.col("node_conv_id").alias("conv_id"))
        .agg(F.count(F.lit(1)).alias("n_convs"), F.coalesce(F.sum("_leaf"), F.lit(0).cast("bigint")).alias("n_leaves"), F.sum("_saved").alias("saved_bytes"))
    )
    ends = members.groupBy("conv_id").agg(F.max(F.struct("depth", "node_conv_id")).alias("_end")).select("conv_id", "_end.depth", "_end.node_conv_id")
    nodes = tops.join(summed, ["depth", "conv_id"])
    return Trie(nodes, members.select("conv_id", "depth", "node_conv_id"), ends)


def ends_digest(trie: Trie) -> DataFrame:
    """(depth, conv_id, ends_sha256) of nodes where conversations end: SHA-256 of their ids in ascending order, comma-joined.

    Ranges of (node, id) become one text for each node in them; a node's texts, a row for each range, are then hashed as they
    come. A task holds the ids of a range or one text at a time, however many conversations end in a node.
    """
    def joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, ids = None, 0, []
        for part in parts:
            done = []
            for depth, node, conv in zip(part["depth"].tolist(), part["node_conv_id"].tolist(), part["conv_id"].tolist(), strict=True):
                if at != (depth, node):
                    if ids:
                        done.append((*at, first, ",".join(ids)))
                    at, first, ids = (depth, node), conv, []
                ids.append(str(conv))
            yield pd.DataFrame(done, columns=["depth", "node", "first", "ids"])
        if ids:
            yield pd.DataFrame([(*at, first, ",".join(ids))], columns=["depth", "node", "first", "ids"])

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for part in parts:
            done = []
            for depth, node, ids in zip(part["depth"].tolist(), part["node"].tolist(), part["ids"], strict=True):
                if at == (depth, node):
                    state.update(b",")
                else:
                    if state:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, node), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["depth", "conv_id", "ends_sha256"])
        if state:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["depth", "conv_id", "ends_sha256"])

    key = ["depth", "node_conv_id", "conv_id"]
    ranges = trie.ends.select(key).repartitionByRange(*key).sortWithinPartitions(*key)
    texts = ranges.mapInPandas(joined, "depth bigint, node bigint, first bigint, ids string")
    dealt = texts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return dealt.mapInPandas(hashed, "depth bigint, conv_id bigint, ends_sha256 string")
