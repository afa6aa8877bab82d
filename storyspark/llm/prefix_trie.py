"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

A turn is named by a 128-bit digest of its role and text, a conversation by the sequence of its turns' names. Equal
sequences become one item with their ids' number, smallest and digest. Items are ranged over the partitions by sequence
and sorted, so conversations with a common prefix stand side by side, and the length of the prefix that two neighbours
share (LCP) is the depth at which their paths part.

A partition is worked off as a forest. Every item starts as a component of its own, at the depth of its last turn. The edges
between neighbours are taken in descending order of LCP: both components climb to just below that depth, which
finishes the nodes on the way, and are united there into a branching node. What may go on in other partitions are only the
nodes on the paths of the partition's first and last sequence. They stay open: the forest is contracted to these two paths,
each node of which holds the sums of what was closed below it (a mark). The paths of ``fan_in`` neighbouring partitions are
items of the next round, merged by the same steps, until one group is left. So a task holds one partition's sequences or
the paths of a few partitions, and a node with very many children is nowhere collected: its children are counted where they
are closed, and get their parent's name by a join with the few nodes that were open.

A node's ``ends_sha256`` is a hash over the ids of equal conversations in ascending order, which has to read them one
after the other; they are sorted by the shuffle and streamed, so the memory needed is bounded also for a conversation that a
third of all ids repeat. A conversation's turn names (16 bytes each, no texts) fit one row.

Cases: null roles and texts are empty; null turns come first, equal turn numbers go by role, then by the digest of role and
text; rows that repeat are turns of their own; rows with a null conv_id take no part; a conversation that has no turn after
rebuilding ends at the root; very long texts are only hashed and counted; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_step, materialize

NAME = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Open nodes that may be broadcast to their closed children; beyond it they are joined by a shuffle.
BROADCAST_NODES = 100_000

ITEM = "seq binary, lens array<int>, n long, low long, ends string"
MARK = pa.struct([("depth", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
                  ("saved", pa.int64()), ("ends", pa.string())])
OUT = pa.schema([
    ("group", pa.int32()), ("seq", pa.binary()), ("lens", pa.list_(pa.int32())), ("marks", pa.list_(MARK)), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent", pa.binary()), ("key", pa.binary()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
OUT_DDL = ("group int, seq binary, lens array<int>, "
           "marks array<struct<depth:int,n:long,low:long,children:long,leaves:long,saved:long,ends:string>>, "
           "conv_id long, depth long, parent_conv_id long, parent binary, key binary, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string")


def rebuild(turns: DataFrame, shared: int = 6, every: int = 100) -> DataFrame:
    """(conv_id, seq, lens): each conversation with the first turns of its hundred's first one in place of its own.

    One shuffle, on the hundred: conversations are gathered and given their hundred's first turns where they lie.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), (F.col("conv_id") - F.col("conv_id") % every).cast("bigint").alias("hundred"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("name"),
                 F.length(text).alias("len")).alias("t"))
    own = rows.repartition("hundred").groupBy("hundred", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    first = F.max(F.when(F.col("conv_id") == F.col("hundred"), F.slice("t", 1, shared - 1))).over(Window.partitionBy("hundred"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    t = F.concat(F.slice(F.coalesce(first, F.slice("t", 1, 0)), F.lit(1), h), F.slice("t", h + 1, F.size("t")))
    return own.withColumn("t", t).select(
        "conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["name"]), "")).alias("seq"), F.transform("t", lambda x: x["len"]).alias("lens"))


def items(conversations: DataFrame) -> DataFrame:
    """A row per distinct sequence: its number of conversations, their smallest id and the digest of their ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, row, n, low, digest, made = None, None, 0, 0, None, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            made.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["seq", "lens", "n", "low", "ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                if keys[a] != key:
                    if key is not None:
                        made.append((*row, n, low, digest.hexdigest()))
                    key, row = keys[a], (batch.column(2)[a].as_py(), batch.column(3)[a].as_py())
                    n, low, digest = 0, int(ids[a]), hashlib.sha256()
                digest.update(("," if n else "").encode() + ",".join(map(str, ids[a:b].tolist())).encode())
                n += b - a
            if len(made) > 5_000:
                yield emit()
        if key is not None:
            made.append((*row, n, low, digest.hexdigest()))
        if made:
            yield emit()

    rows = conversations.select(F.unhex(F.md5("seq")).alias("key"), "conv_id", "seq", "lens")
    return rows.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, ITEM)


def shared_depth(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:NAME] != b[:NAME]:
        return 0
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (differ.bit_length() + 7) // 8) // NAME


def digests(seq: bytes) -> list[bytes]:
    """A name for the node at each depth of a path."""
    h, out = hashlib.md5(), [hashlib.md5().digest()]
    for k in range(0, len(seq), NAME):
        h.update(seq[k:k + NAME])
        out.append(h.copy().digest())
    return out


def add(a: list | None, b: list | None) -> list:
    """The sum of two marks [n, low, children, leaves, saved, ends]."""
    if a is None or b is None:
        return a or b or [0, None, 0, 0, 0, None]
    low = a[1] if b[1] is None else b[1] if a[1] is None else min(a[1], b[1])
    return [a[0] + b[0], low, a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5] or b[5]]


@dataclass
class Component:
    """Neighbouring items that a node unites: ``depth`` is the node's, ``marks`` are of depths still to come."""

    depth: int
    lo: int
    hi: int
    acc: list
    marks: dict[int, list]
    waiting: list = field(default_factory=list)  # closed children whose parent, this node, has no name yet


def contract(rows: list[tuple[bytes, list[int], dict[int, list]]], top: bool, named: bool) -> tuple[list[list], list[tuple]]:
    """Nodes that are complete, as lists in the order of ``OUT`` from conv_id on, and the paths left open.

    ``rows``: (sequence, text lengths, marks by depth), sorted by sequence; ``top``: there is nothing outside these rows.
    ``named``: nodes get their path's name, since closed children of earlier rounds ask for it.
    """
    m, closed = len(rows), []
    names = {i: digests(rows[i][0]) for i in (range(m) if named else {0, m - 1})}
    left: tuple[dict[int, list], dict[int, list]] = ({}, {})
    parts = []
    for i, (seq, _, marks) in enumerate(rows):
        depth = len(seq) // NAME
        parts.append(Component(depth, i, i, marks.pop(depth), marks))

    def finish(c: Component) -> list | None:
        """Closes the component's node and returns it, or leaves it open on the first or last path."""
        k = c.depth
        if not top and (c.lo == 0 or c.hi == m - 1):
            first = c.lo == 0
            left[0 if first else 1][k] = c.acc
            name = names[0 if first else m - 1][k]
            for node in c.waiting:
                node[3] = name
            closed.extend(c.waiting)
            return None
        n, low, children, leaves, saved, ends = c.acc
        if k:
            saved += (n - 1) * rows[c.lo][1][k - 1]
        for node in c.waiting:
            node[2] = low
        closed.extend(c.waiting)
        return [low, k, None, None, names[c.lo][k] if named else None, n, children, leaves if children else 1, saved, ends or NO_ENDS]

    def climb(c: Component, depth: int) -> None:
        while c.depth > depth:
            node = finish(c)
            c.depth -= 1
            c.acc, c.waiting = c.marks.pop(c.depth, None), []
            if node is None:
                c.acc = add(c.acc, None)
            else:
                c.acc = add(c.acc, [node[5], node[0], 1, node[7], node[8], None])
                c.waiting.append(node)

    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    depths = [shared_depth(rows[i][0], rows[i + 1][0]) for i in range(m - 1)]
    for i in sorted(range(m - 1), key=lambda i: -depths[i]):
        a, b = parts[find(i)], parts[find(i + 1)]
        climb(a, depths[i])
        climb(b, depths[i])
        root[b.lo] = a.lo  # a component is found at its first item
        a.hi, a.acc = b.hi, add(a.acc, b.acc)
        for mine, other in ((a.marks, b.marks),):
            for k, mark in other.items():
                mine[k] = add(mine.get(k), mark)
        small, large = sorted((a.waiting, b.waiting), key=len)
        large.extend(small)
        a.waiting = large
        parts[b.lo] = None
    if m:
        whole = parts[find(0)]
        climb(whole, 0)
        last = finish(whole)
        if last is not None:
            closed.append(last)
    if top or not m:
        return closed, []
    return closed, [(rows[i][0], rows[i][1], left[side]) for i, side in ((0, 0), (m - 1, 1)) if side == 0 or m > 1]


def _rows(group: int, closed: list[list], open_: list[tuple]) -> Iterable[pa.RecordBatch]:
    flat = [[None, None, None, None, *node] for node in closed]
    flat += [[group, seq, lens, [{"depth": k, **dict(zip(("n", "low", "children", "leaves", "saved", "ends"), mark, strict=True))} for k, mark in marks.items()],
              *[None] * 10] for seq, lens, marks in open_]
    for k in range(0, len(flat), 5_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat[k:k + 5_000], strict=True), OUT, strict=True)], schema=OUT)


def nodes(conversations: DataFrame, part_rows: int = 50_000, fan_in: int = 64) -> DataFrame:
    """A row per node of the trie of ``conversations`` (conv_id unique, seq, lens), as the module describes.

    ``part_rows``: sequences that a partition holds, on average; ``fan_in``: partitions that a task merges.
    """
    own = materialize(items(conversations))
    parts = -(-own.count() // part_rows) or 1

    def forest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = []
        for batch in batches:
            for x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append((x[0], x[1], {len(x[1]): [x[2], x[3], 0, 0, 0, x[4]]}))
        yield from _rows(TaskContext.get().partitionId(), *contract(rows, False, False))

    def merge(last: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            groups: dict[int, list] = {}
            for batch in batches:
                for g, seq, lens, marks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    groups.setdefault(g, []).append((seq, lens, {x["depth"]: [x[k] for k in ("n", "low", "children", "leaves", "saved", "ends")] for x in marks}))
            for g in sorted(groups):
                yield from _rows(g, *contract(sorted(groups[g], key=lambda r: r[0]), last, True))
        return run

    made = materialize(own.repartitionByRange(parts, "seq").sortWithinPartitions("seq").mapInArrow(forest, OUT_DDL))
    drop_step(own)
    rounds = [made]
    while True:
        paths = made.where("seq is not null").select("group", "seq", "lens", "marks")
        groups = -(-(1 + (paths.agg(F.max("group")).first()[0] or 0)) // fan_in)
        up = paths.withColumn("group", F.expr(f"cast(group div {fan_in} as int)")).repartition(groups, "group")
        made = materialize(up.mapInArrow(merge(groups == 1), OUT_DDL))
        rounds.append(made)
        if groups == 1:
            break
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    every = every.where("seq is null").drop("group", "seq", "lens", "marks")
    # children of nodes that were open for a while
    open_ = every.where("key is not null").select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    open_ = F.broadcast(open_) if open_.count() <= BROADCAST_NODES else open_
    late = every.where("parent is not null").join(open_, "parent").withColumn("parent_conv_id", F.col("above"))
    return every.where("parent is null").drop("parent", "key").unionByName(late.drop("parent", "key", "above"))
