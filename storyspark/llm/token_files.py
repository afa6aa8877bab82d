"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are ranged by id over the partitions and sorted within them. Each partition writes three files:
``.bin`` (the ids, 16 bits wide if the vocabulary allows, else 32), ``.off`` (64-bit unsigned starts of its
documents and its end, from 0) and ``.doc`` (64-bit document ids). Prefix sums over the files' token counts give
each partition's base; a document's start is the base plus its offset. Files carry the number of the attempt that
wrote them and count only if the manifest names them, so a lost or repeated attempt leaves no trace in it. The
reader memory-maps files on mounted file systems and reads others through their own client.

Cases: a null text is empty; null ids come first and are stored as the smallest 64-bit number; rows with equal ids
follow each other in the order of their texts; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, step_folder
from .encoder import crc32, default_path, encoder, slices

MANIFEST = "part int, name string, width int, n_docs long, n_tokens long"
NULL_ID = -(1 << 63)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and returns their manifest: (folder, part, name, width, n_docs, n_tokens, base)."""
    folder = folder or step_folder(docs.sparkSession)
    path = tokenizer or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, name = context.partitionId(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        enc, store, files = encoder(path), None, None
        end = np.array([end_id], enc.dtype).tobytes()
        n_docs = n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                store, root = _open(folder)
                store.create_dir(root, recursive=True)
                files = [store.open_output_stream(f"{root}/{name}.{kind}") for kind in ("bin", "off", "doc")]
            ids = np.array([NULL_ID if x is None else x for x in batch.column(0).to_pylist()], "<i8")
            for first, texts in slices(batch.column(1).to_pylist()):
                raw = [r + end for r in enc.encode(texts)]
                sizes = np.fromiter((len(r) // enc.dtype.itemsize for r in raw), np.int64, len(raw))
                files[0].write(b"".join(raw))
                files[1].write((n_tokens + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                files[2].write(ids[first:first + len(raw)].tobytes())
                n_docs, n_tokens = n_docs + len(raw), n_tokens + int(sizes.sum())
        if files is not None:
            files[1].write(np.array([n_tokens], "<u8").tobytes())
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "name": [name], "width": pa.array([enc.dtype.itemsize], pa.int32()),
                "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(ranged.mapInArrow(run, MANIFEST))
    # a row per file: the prefix sum runs over the file list, not over documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(F.lit(folder).alias("folder"), "*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))


def load(folder: str, name: str, kind: str, dtype: str) -> np.ndarray:
    store, root = _open(folder)
    path = f"{root}/{name}.{kind}"
    if store.type_name == "local":
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                ids = load(f["folder"], f["name"], "bin", f"<u{f['width']}")
                offsets = load(f["folder"], f["name"], "off", "<u8").astype(np.int64)
                docs = load(f["folder"], f["name"], "doc", "<i8")
                for k in range(0, len(docs), 10_000):
                    at = offsets[k:k + 10_001]
                    own = np.asarray(docs[k:k + 10_000])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, mask=own == NULL_ID), "start": f["base"] + at[:-1], "n_tokens": np.diff(at),
                        "ids_crc32": np.fromiter((crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, len(own))})

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
