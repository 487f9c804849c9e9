"""Shingles: hashes of runs of words, and the set of them that a text has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.blocks import sliced

SEED = 42
#: Bytes of text whose shingle sets are made at once.
SET_BYTES = 1 << 20


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every shingle of `size` words; ASCII capitals count as small, words end at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; a null text counts as empty."""
    return np.unique(np.array(shingle_hashes((text or "").encode(), size), np.uint64))


def shingle_sets(rows: DataFrame, size: int = 5) -> DataFrame:
    """(node, n, shingles) of rows (node, text): the sorted distinct shingle hashes of each text and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SET_BYTES):
            sets = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, n long, shingles array<long>")
