"""Verdict trees: one root for each validator and epoch, and the check of signed roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.shared import ship, written

LEAF = ["categorical_key", "worker", "points", "resource_id", "resource_type", "verdict"]


def leaves(verdicts: DataFrame) -> DataFrame:
    """validator, epoch, leaf: the hash of a verdict's fields as JSON in the order of their names."""
    row = F.struct(F.col("categorical_key"), F.col("worker").alias("miner_hotkey"), F.round("points", 6).alias("points_awarded"), F.col("resource_id"), F.col("resource_type"), F.col("verdict").alias("validator_verdict"))
    return verdicts.select("validator", "epoch", F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("leaf"))


#: Levels of a tree that are hashed at once, from a block of two to that power of nodes.
LEVELS = 10


def ranked_leaves(verdicts: DataFrame) -> DataFrame:
    """validator, epoch, leaf, rank (from 0, in the order of leaves; equal leaves in any order).

    A range-partitioned sort, in which an epoch of any size lies in many partitions; the place of a row is its place in its
    partition, after the rows of the epoch in the partitions before.
    """
    ship(verdicts.sparkSession)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            batch["part"], batch["i"] = part, np.arange(i, i + len(batch))
            i += len(batch)
            yield batch

    rows = leaves(verdicts)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = written(rows.repartitionByRange("validator", "epoch", "leaf").sortWithinPartitions("validator", "epoch", "leaf").mapInPandas(number, f"{kinds}, part long, i long"), "leaves")
    parts = placed.groupBy("validator", "epoch", "part").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("validator", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return placed.join(parts.withColumn("before", before), ["validator", "epoch", "part"]).select("validator", "epoch", "leaf", (F.col("i") - F.col("first") + F.col("before")).alias("rank"))


def _paired(nodes: Column) -> Column:
    """The level above: hashes of pairs, an odd last node paired with itself."""
    at = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(at, lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.get(nodes, 2 * i))), 256))


def _levels(nodes: Column, alone: Column) -> Column:
    """The levels of a block of nodes, from the nodes up to its one top node: ``LEVELS`` steps, or as many as a block that is
    ``alone`` in its tree needs."""
    step = lambda acc, _: F.when(alone & (F.size(F.element_at(acc, -1)) == 1), acc).otherwise(F.concat(acc, F.array(_paired(F.element_at(acc, -1)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), step)


def tree_blocks(ranked: DataFrame) -> Iterator[DataFrame]:
    """Rounds of a tree: validator, epoch, block, alone and levels of each block of nodes, until each tree has one block.

    A block has 2^10 nodes, but for a tree's last one, whose odd nodes are paired with themselves just as the whole level's
    would be, since the nodes before it are even in number on each of its levels.
    """
    nodes = ranked.select("validator", "epoch", "rank", F.col("leaf").alias("node"))
    while True:
        block = F.shiftright("rank", LEVELS)
        grouped = nodes.groupBy("validator", "epoch", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("l"))  # at most 2^LEVELS nodes
        sizes = grouped.groupBy("validator", "epoch").agg((F.count("*") == 1).alias("alone"))
        rows = grouped.join(sizes, ["validator", "epoch"])
        round_ = written(rows.select("validator", "epoch", "block", "alone", _levels(F.transform("l", lambda x: x["node"]), F.col("alone")).alias("levels")), "tree-blocks")
        yield round_
        rest = round_.where("NOT alone")
        if rest.isEmpty():
            return
        nodes = rest.select("validator", "epoch", F.col("block").alias("rank"), F.element_at(F.element_at("levels", -1), 1).alias("node"))


def merkle_roots(verdicts: DataFrame) -> DataFrame:
    """validator, epoch, root, n. Pairs are hashed level by level in blocks, in parallel, so no task holds an epoch."""
    ranked = written(ranked_leaves(verdicts), "ranked-leaves")
    roots = None
    for blocks in tree_blocks(ranked):
        done = blocks.where("alone").select("validator", "epoch", F.element_at(F.element_at("levels", -1), 1).alias("root"))
        roots = done if roots is None else roots.union(done)
    return roots.join(ranked.groupBy("validator", "epoch").agg(F.count("*").alias("n")), ["validator", "epoch"]).select("validator", "epoch", "root", "n")


def inclusion_proofs(verdicts: DataFrame, wanted: DataFrame) -> DataFrame:
    """validator, epoch, leaf, proof: for each ``wanted`` leaf (validator, epoch, leaf) that is in its tree, the nodes that its
    way to the root is hashed with, from the leaf up: structs of node and left (whether the node comes first)."""
    ranked = written(ranked_leaves(verdicts), "ranked-leaves")
    first = ranked.groupBy("validator", "epoch", "leaf").agg(F.min("rank").alias("rank"))
    now = wanted.select("validator", "epoch", "leaf").distinct().join(first, ["validator", "epoch", "leaf"]).withColumn("proof", F.array().cast("array<struct<node:string,left:boolean>>"))
    done = None
    for blocks in tree_blocks(ranked):
        rows = now.withColumn("block", F.shiftright("rank", LEVELS)).join(blocks, ["validator", "epoch", "block"])
        inside = F.pmod("rank", F.lit(1 << LEVELS)).cast("int")

        def sibling(level: Column) -> Column:
            at = F.floor(F.col("inside") / F.pow(F.lit(2.0), level)).cast("int")
            nodes = F.get("levels", level)
            other = at.bitwiseXOR(F.lit(1))
            return F.struct(F.coalesce(F.get(nodes, other), F.get(nodes, at)).alias("node"), (other < at).alias("left"))

        steps = F.transform(F.sequence(F.lit(0), F.size("levels") - 2), sibling)
        rows = rows.withColumn("inside", inside).withColumn("proof", F.concat("proof", F.when(F.size("levels") > 1, steps).otherwise(F.array().cast("array<struct<node:string,left:boolean>>"))))
        found = rows.where("alone").select("validator", "epoch", "leaf", "proof")
        done = found if done is None else done.union(found)
        now = rows.where("NOT alone").select("validator", "epoch", "leaf", F.col("block").alias("rank"), "proof")
    return done


def proved_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.when(p["left"], F.concat(p["node"], node)).otherwise(F.concat(node, p["node"])), 256))


def merkle_check(verdicts: DataFrame, attestations: DataFrame, rate: float = 0.1) -> DataFrame:
    """validator, epoch, ok for a sample (by hash) of attestations (validator, epoch, root)."""
    chosen = attestations.where(F.pmod(F.xxhash64("validator", "epoch"), F.lit(10_000)) < int(rate * 10_000))
    return chosen.withColumnRenamed("root", "signed").join(merkle_roots(verdicts), ["validator", "epoch"], "left").select("validator", "epoch", F.coalesce(F.col("signed") == F.col("root"), F.lit(False)).alias("ok"))
