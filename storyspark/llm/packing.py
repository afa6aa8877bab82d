"""Best-fit packing of token pieces into sequences, by residual rounds over a tree of partitions.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut, and the short piece comes
first. Each partition packs its pieces best-fit, largest first, and emits the bins that are nearly full. The others
go on as items of their own (a bin with its members, at most ``capacity`` of them): ``fan_in`` partitions at a time
are merged and packed again, until one group is left. What a bin lacks to count as nearly full grows from round to
round. Where the bins carried would be more than ``carry`` per group, they are dealt to more groups by a hash that changes with
the round, so no task's input grows with the table and other bins meet in every round; such rounds end when one has
saved less than a fiftieth of the bins, since the rest (items over half a sequence, say) has no partners. No bin is
emitted early for being one too many.

Every round is written to the shared folder before the next reads it, so a repeated task cannot move pieces
between bins that were already counted.

Cases: a null or empty text is one piece of the end id alone; pieces of one length are packed in the order of their rows; a row is a document, so equal rows and null ids are
packed like others (``row`` tells them apart); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .encoder import crc32, default_path, encoder, slices

MEMBER = "struct<row:bigint,doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
BIN = f"node int, level int, id bigint, fill int, full boolean, members array<{MEMBER}>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document with ``n`` ids."""
    first = n % capacity or min(n, capacity)
    stops = [0, *range(first, n + 1, capacity)]
    return list(zip(stops, stops[1:], strict=False))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: each item, largest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the rooms that some bin has, ascending
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, sizes[k])
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[b].append(k)
        if left := room - sizes[k]:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def pack_items(items: list[tuple[int, list]], capacity: int, slack: int) -> Iterable[tuple[int, bool, list]]:
    """(fill, full, members) of the bins made of ``items`` (fill, members)."""
    made = []
    for b in best_fit([n for n, _ in items], capacity):
        made.append((sum(items[k][0] for k in b), [m for k in b for m in items[k][1]]))
    made.sort(key=lambda x: x[0])
    for fill, members in made:
        yield fill, fill >= capacity - slack, members


def _batch(node: int, level: int, bins: list[tuple[int, bool, list]], first: int) -> pa.RecordBatch:
    flat = [m for _, _, members in bins for m in members]
    columns = list(zip(*flat, strict=True))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ("row", "doc_id", "piece", "start", "length", "ids_crc32")
    members = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *[len(m) for _, _, m in bins]]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names))
    n = len(bins)
    return pa.RecordBatch.from_arrays(
        [pa.array([node] * n, pa.int32()), pa.array([level] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()),
         pa.array([b[0] for b in bins], pa.int32()), pa.array([b[1] for b in bins], pa.bool_()), members],
        ["node", "level", "id", "fill", "full", "members"])


def _emit(node: int, level: int, bins: Iterable[tuple[int, bool, list]]) -> Iterable[pa.RecordBatch]:
    bins = list(bins)
    for k in range(0, len(bins), 5_000):
        yield _batch(node, level, bins[k:k + 5_000], (level << 56) + (node << 32) + k)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text",
         fan_in: int = 8, carry: int = 50_000, chunk: int = 200_000) -> DataFrame:
    """A row per piece: row, doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``chunk``: pieces packed at once."""
    path = tokenizer or default_path()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        node, enc, items, made = TaskContext.get().partitionId(), encoder(path), [], 0
        end = np.array([end_id], enc.dtype).tobytes()

        def flush():
            nonlocal items, made
            for b in _emit(node, 0, pack_items(items, capacity, 4)):
                # ids go on where the partition's last chunk ended
                yield b.set_column(2, "id", pa.array(range((node << 32) + made, (node << 32) + made + b.num_rows), pa.int64()))
                made += b.num_rows
            items = []

        for batch in batches:
            row, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in slices(batch.column(2).to_pylist()):
                for k, raw in enumerate(enc.encode(texts), first):
                    all_ids = enc.ids(raw + end)
                    for p, (a, b) in enumerate(cut(len(all_ids), capacity)):
                        items.append((b - a, [(row[k], ids[k], p, a, b - a, crc32(all_ids[a:b]))]))
                if len(items) >= chunk:
                    yield from flush()
        if items:
            yield from flush()

    def merge(level: int, slack: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            items: dict[int, list] = {}
            for batch in batches:
                for x in batch.to_pylist():
                    items.setdefault(x["node"], []).append((x["id"], x["fill"], [tuple(m.values()) for m in x["members"]]))
            for node in sorted(items):
                own = sorted(items[node], key=lambda x: x[0])
                yield from _emit(node, level, pack_items([(n, m) for _, n, m in own], capacity, slack))
        return run

    done = []
    made = materialize(rows.mapInArrow(leaves, BIN))
    level, nodes, before = 0, 1 + (made.where(~F.col("full")).agg(F.max("node")).first()[0] or 0), None
    while True:
        done.append(made.where("full").select("id", "members"))
        rest = made.where(~F.col("full"))
        left = rest.count()
        if level and (nodes == 1 or (before is not None and 50 * left > 49 * before)):
            done.append(rest.select("id", "members"))
            break
        groups = -(-left // carry)
        level, nodes = level + 1, max(-(-nodes // fan_in), groups)
        dealt = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(nodes)).cast("int") if groups == nodes else F.expr(f"cast(node div {fan_in} as int)")
        before = left if groups == nodes > 1 else None
        up = rest.withColumn("node", dealt).repartition(nodes, "node")
        made = materialize(up.mapInArrow(merge(level, min(capacity // 8, 4 << level)), BIN))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    members = every.select(F.col("id").alias("sequence_id"), F.col("members").alias("m"), F.posexplode("members").alias("k", "x"))
    return members.select("x.*", "sequence_id", F.aggregate(
        F.slice("m", F.lit(1), F.col("k")), F.lit(0).cast("bigint"), lambda a, y: a + y["length"]).alias("offset"))
