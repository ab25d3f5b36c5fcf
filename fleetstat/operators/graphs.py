"""Partition trees and role graphs, walked level by level with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.functions import SNAP
from fleetstat.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a step to the shared checkpoint folder, so that a lost executor re-reads it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def walk_tree(nodes: DataFrame) -> DataFrame:
    """Level and path of every node of a forest given as (oid, parent_oid, name).

    One join per level, until a level is empty. A node is not visited again below
    itself. Nodes no root leads to (below a missing parent or on a cycle) follow
    with a NULL level and their own name as path.
    """
    edges = nodes.where(F.col("parent_oid").isNotNull()).select(*SNAP, "oid", "parent_oid", "name")
    roots = nodes.where(F.col("parent_oid").isNull()).select(
        *SNAP, "oid", F.lit(0).alias("level"), F.array("name").alias("path"), F.array("oid").alias("above"))
    levels = [cut_lineage(roots)]
    while True:
        parents = levels[-1].select(*SNAP, F.col("oid").alias("parent_oid"), "path", "above")
        found = cut_lineage(
            edges.join(parents, [*SNAP, "parent_oid"]).where(~F.array_contains("above", F.col("oid"))).select(
                *SNAP, "oid", F.lit(len(levels)).alias("level"), F.concat("path", F.array("name")).alias("path"),
                F.concat("above", F.array("oid")).alias("above")))
        if found.isEmpty():
            break
        levels.append(found)
    walked = levels[0]
    for found in levels[1:]:
        walked = walked.unionByName(found)
    walked = walked.drop("above")
    unreached = edges.join(walked.select(*SNAP, "oid").distinct(), [*SNAP, "oid"], "left_anti").select(
        *SNAP, "oid", F.lit(None).cast("int").alias("level"), F.array("name").alias("path"))
    return walked.unionByName(unreached)


def role_closure(members: DataFrame) -> DataFrame:
    """Every (member, role) pair reachable over any number of memberships.

    Each round extends only the pairs found in the round before by everything
    known, which doubles the length of the chains covered: a chain of n needs
    about log2(n) rounds. Only new pairs are written. Rounds end when there are
    none; a cycle simply stops producing them.
    """
    key = [*SNAP, "member", "roleid"]
    newest = cut_lineage(members.select(*key).distinct())
    known = newest
    while True:
        first = newest.select(*SNAP, "member", F.col("roleid").alias("via"))
        second = known.select(*SNAP, F.col("member").alias("via"), "roleid")
        longer = first.join(second, [*SNAP, "via"]).select(*key).distinct()
        newest = cut_lineage(longer.join(known, key, "left_anti"))
        if newest.isEmpty():
            return known
        known = known.unionByName(newest)
