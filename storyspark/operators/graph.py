"""Label rounds on edge tables: roots of forests, components, smallest reachable label."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def forest_roots(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, root) for a table with at most one edge per child, by pointer jumping.

    The distance to the root halves in every round, so depth d needs log2(d) rounds. A row whose pointer has reached
    a root is settled and takes no further part, so the rows of a big cluster meet on its root's key once at most.
    """
    every = active = cut(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")))
    settled = None
    while True:
        up = every.select(F.col("c").alias("c2"), F.col("p").alias("p2"))
        moved = cut(
            active.join(up, F.col("p") == F.col("c2"), "left")
            .select("c", F.coalesce("p2", "p").alias("p"), F.col("p2").isNotNull().alias("moved"))
        )
        there, active = moved.where("not moved").drop("moved"), moved.where("moved").drop("moved")
        settled = there if settled is None else settled.unionByName(there)
        if active.isEmpty():
            return settled.select(F.col("c").alias(child), F.col("p").alias("root"))
        every = settled.unionByName(active)


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest label among a node and all it reaches.

    ``nodes(node, label, label_node)`` gives a first label, that of a reachable node;
    ``edges(src, dst)`` is directed. Every round takes the best label over the edges
    and then jumps to the label of the labelled node, so long chains close quickly.
    """
    edges = cut(edges)
    state = cut(nodes.select("node", F.struct("label", F.col("label_node").alias("at")).alias("l")))
    while True:
        over_edges = (
            edges.join(state.select(F.col("node").alias("dst"), "l"), "dst")
            .groupBy(F.col("src").alias("node")).agg(F.min("l").alias("e"))
        )
        stepped = state.join(over_edges, "node", "left").select(
            "node", F.col("l").alias("old"), F.least("l", F.coalesce("e", "l")).alias("l"))
        jump = state.select(F.col("node").alias("at_node"), F.col("l").alias("j"))
        moved = cut(
            stepped.join(jump, F.col("l.at") == F.col("at_node"), "left")
            .select("node", "old", F.least("l", F.coalesce("j", "l")).alias("l"))
        )
        state = moved.select("node", "l")
        if moved.where(F.col("l") < F.col("old")).limit(1).isEmpty():
            return state.select("node", F.col("l.label").alias("label"), F.col("l.at").alias("label_node"))


def smallest_earlier(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label_node): like :func:`smallest_reachable` for edges that lead to earlier nodes only.

    ``nodes(node, at, block, label, label_node)`` have a place ``(at, node)`` and lie in blocks of bounded size; ``edges(src, dst)``
    lead to earlier places. Inside a block one pass in order settles every node, however long the chains are. A round takes
    the best label over the edges between blocks and then passes over the blocks, so there are as many rounds as blocks
    follow each other, and none without such edges.
    """
    place = nodes.select("node", "block", "at")
    edges = cut(
        edges.join(place.select(F.col("node").alias("src"), F.col("block").alias("home"), F.col("at").alias("src_at")), "src")
        .join(place.select(F.col("node").alias("dst"), F.col("block").alias("dst_block")), "dst"))
    inside = edges.where("home = dst_block").select("home", "src", "dst", "src_at")
    across = edges.where("home <> dst_block").select("src", "dst")
    columns = ["block", "node", "at", "label", "label_node"]
    schema = "block string, node bigint, at bigint, label bigint, label_node bigint"
    # a node without an edge inside its block needs no pass
    linked = cut(inside.select(F.col("src").alias("node")).unionByName(inside.select(F.col("dst").alias("node"))).distinct())

    def passed(state: DataFrame) -> DataFrame:
        joined = state.select(*columns).join(linked, "node", "left_semi")
        done = joined.groupBy("block").cogroup(inside.groupBy("home")).applyInPandas(_pass, schema)
        return cut(done.unionByName(state.select(*columns).join(linked, "node", "left_anti")))

    state = passed(nodes)
    while not across.isEmpty():
        best = across.join(state.select(F.col("node").alias("dst"), F.struct("label", "label_node").alias("l")), "dst").groupBy(
            F.col("src").alias("node")).agg(F.min("l").alias("e"))
        own = F.struct("label", "label_node")
        better = cut(state.join(best, "node").where(F.col("e") < own).select("node", "e"))
        if better.isEmpty():
            break
        l = F.least(own, F.coalesce("e", own))
        state = passed(state.join(better, "node", "left").select("block", "node", "at", l["label"].alias("label"), l["label_node"].alias("label_node")))
    return state.select("node", "label_node")


def _pass(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Best labels inside a block, the edges taken in the order of their earlier ends' settling."""
    best = dict(zip(nodes["node"].tolist(), zip(nodes["label"].tolist(), nodes["label_node"].tolist())))
    edges = edges.sort_values(["src_at", "src"])
    for src, dst in zip(edges["src"].tolist(), edges["dst"].tolist()):
        if best[dst] < best[src]:
            best[src] = best[dst]
    labels = [best[n] for n in nodes["node"].tolist()]
    return nodes.assign(label=[a for a, _ in labels], label_node=[b for _, b in labels])[["block", "node", "at", "label", "label_node"]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table ``(src, dst)``."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both)
    nodes = both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"), F.col("node").alias("label_node"))
    return smallest_reachable(nodes, both).select("node", F.col("label").alias("component"))
