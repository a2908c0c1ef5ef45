"""Token-id files: flat unsigned integers plus 64-bit document offsets, in ascending document order.

A part is three files: ``.bin`` (ids of all its documents in a row, little-endian u2 or u4), ``.idx``
(n+1 signed 64-bit offsets into it, in ids) and ``.doc`` (n signed 64-bit document ids). Documents are
dealt by ranges of their id, one part per task; a part's base, the number of ids before it, is a prefix
sum over the part sizes. Parts are read through a memory map, or by ranges in other stores.

A task that runs again writes files of a new name, and the manifest names those of the attempt that
counted, so lost executors leave no double rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, files, new_path, release_memory, save, slices, steady_heap, text_bytes
from .tokens import encoder

PART_BYTES, MOST_PARTS = 64_000_000, 100_000  # text of a part file
NULL_ID = -(2**63)  # a null document id in .doc; sorts first
MANIFEST = "part long, uri string, width int, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True, width: int = 2, folder: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into part files; the manifest (a row per part) is returned, with
    ``base``. Null texts are empty: their document is the end id alone. Rows with equal ids stay
    separate documents, next to each other."""
    folder = folder or new_path(docs.sparkSession, "token-ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        code, end = encoder(tokenizer, keeps_space, width), np.array([end_id], f"<u{width}").tobytes()
        store, root = files(folder)
        name, n_docs, n_ids, out = uuid.uuid4().hex, 0, 0, None
        for doc_ids, texts in (part for batch in batches for part in slices(batch)):
            if out is None:
                store.create_dir(root, recursive=True)
                out = [store.open_output_stream(f"{root}/{name}{x}", compression=None) for x in (".bin", ".idx", ".doc")]
            starts = np.zeros(len(texts), "<i8")
            for i, got in enumerate(code.batches(texts)):
                out[0].write(got + end)
                starts[i] = n_ids
                n_ids += len(got) // width + 1
            out[1].write(starts.tobytes())
            out[2].write(doc_ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs += len(texts)
        release_memory()
        if out is None:
            return
        out[1].write(np.array([n_ids], "<i8").tobytes())
        for f in out:
            f.close()
        row = [[TaskContext.get().partitionId()], [f"{folder}/{name}"], [width], [n_docs], [n_ids]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["part", "uri", "width", "n_docs", "n_ids"])

    total = text_bytes(docs)
    # parts of ``part_bytes`` of text; smaller ones where there are too few for the cores, down to 1 MB
    parts = blocks_for(total, min(part_bytes, max(1_000_000, total / docs.sparkSession.sparkContext.defaultParallelism)), MOST_PARTS)
    # Equal ids can still be dealt to several parts, by their text and place in the input.
    ranged = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h", "m")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "m")
    )
    manifest = save(ranged.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")
    rows, base = [], 0
    for r in sorted(manifest.collect()):  # a row per part file
        rows.append((*r, base))
        base += r["n_ids"]
    return docs.sparkSession.createDataFrame(rows, MANIFEST + ", base long")


def read_tokens(manifest: DataFrame, block: int = 4096) -> DataFrame:
    """Documents of the part files: doc_id, start (ids before it in the whole corpus), n_tokens and
    ids (binary, little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                store, path = files(part["uri"])
                n, kind = part["n_docs"], f"<u{part['width']}"
                if store.type_name == "local":
                    flat = np.memmap(path + ".bin", kind, "r")
                    idx, doc = np.memmap(path + ".idx", "<i8", "r"), np.memmap(path + ".doc", "<i8", "r")
                else:
                    idx, doc = (np.frombuffer(store.open_input_file(path + x).read(), "<i8") for x in (".idx", ".doc"))
                    source = store.open_input_file(path + ".bin")
                for lo in range(0, n, block):
                    hi = min(n, lo + block)
                    cut = idx[lo : hi + 1]
                    if store.type_name == "local":
                        ids = flat[cut[0] : cut[-1]]
                    else:
                        ids = np.frombuffer(source.read_at(int(cut[-1] - cut[0]) * part["width"], int(cut[0]) * part["width"]), kind)
                    wide, at = ids.astype("<u4"), cut - cut[0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc[lo:hi], pa.int64(), mask=doc[lo:hi] == NULL_ID),
                            pa.array(cut[:-1] + part["base"], pa.int64()),
                            pa.array(np.diff(cut), pa.int64()),
                            pa.array([wide[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
