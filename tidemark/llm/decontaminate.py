"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size, in powers of two of their distinct shingles.  The
MinHash sketch of a set at a partition's rate is made of its smallest hashes: those below
rate * 2^64, with the rate that leaves about ``SAMPLED`` of the shingles that a document
must share with an item of the partition.  A document whose sketch meets an item's is a
candidate, whatever its length; it goes unseen only if none of the shared shingles is
sampled, a chance of at most exp(-SAMPLED) (1e-13) at the containment threshold.  Items
with few shingles are in partitions of rate 1, whose sketches are whole sets: the same
search, and exact.  Candidates are verified by exact containment: the part of the
item's distinct shingles that the document has.

The search is a map over the documents: the items' index is sent to every executor
in blocks of at most about ``BLOCK_SHINGLES`` shingles (8 bytes each for the sets and the
owners, and for the sketches), one pass over the documents for each block; the driver
holds one block at a time.

Defined results: null, empty or blank texts contain nothing; blank items match
nothing; an item of w < 5 words is one shingle of w words and is searched among the
w-word windows of documents; rows and items that repeat give repeated rows; ids may be of
any type; very long texts take time and memory in proportion; an empty table on either
side gives no rows; extra columns are ignored by ``find_contained`` and returned untouched
by ``drop_contaminated``, whatever their names.  A row with a null doc_id is searched
like any other; ``drop_contaminated`` keeps it, as it can't be named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import blocks, keep_ids, lowered, run_hashes, shingle_sets, store, trimmed, window_hashes

SHINGLE = 5
CONTAINMENT = 0.75
SAMPLED = 30
BLOCK_SHINGLES = 2_000_000


def rate(size: int) -> float:
    """Sampling rate of the partition that items with ``size`` shingles belong to."""
    return min(1.0, SAMPLED / (CONTAINMENT * (1 << max(0, size.bit_length() - 1))))


def sketch(u: np.ndarray, part: float) -> np.ndarray:
    """The smallest hashes of a sorted set: those below ``part`` of the range."""
    return u if part >= 1 else u[: np.searchsorted(u, np.uint64(int(part * 2.0**64)))]


class ItemIndex:
    """Shingles and sketches of one block of items, by shingle width."""

    def __init__(self, ids: list, sets: list[np.ndarray], widths: list[int]):
        self.ids = ids
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.widths = {}
        for w in sorted(set(widths)):
            members = [k for k, x in enumerate(widths) if x == w]
            values = np.concatenate([sets[k] for k in members])
            owners = np.concatenate([np.full(len(sets[k]), k, dtype=np.int64) for k in members])
            order = np.argsort(values, kind="stable")
            # A hash in an item's sketch is in a document's sketch at that rate if the document has it at all.
            self.widths[w] = (values[order], owners[order], np.unique(np.concatenate([sketch(sets[k], rate(len(sets[k]))) for k in members])))

    def search(self, u: np.ndarray, width: int) -> list[tuple[int, int]]:
        """(item, shared) for items of this width that ``u``, sorted, holds to the threshold."""
        values, owners, sketches = self.widths[width]
        if not _meet(u, sketches):
            return []
        # Every shingle of a candidate decides exactly.
        lo, hi = np.searchsorted(values, u, "left"), np.searchsorted(values, u, "right")
        found = np.concatenate([owners[a:b] for a, b in zip(lo[lo < hi], hi[lo < hi])])
        item, shared = np.unique(found, return_counts=True)
        enough = shared >= CONTAINMENT * self.sizes[item]
        return list(zip(item[enough].tolist(), shared[enough].tolist()))


def _meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a member in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return bool((b[at] == a).any())


def _item_blocks(items: DataFrame) -> Iterator[ItemIndex]:
    """The test items, read in ``item_id`` order on the driver a block at a time."""
    ids, sets, widths, held = [], [], [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        block = lowered(next(blocks(pa.array([row["text"]], pa.string()))))
        words = len(block.words()[0])
        if not words:
            continue
        ids.append(row["item_id"])
        sets.append(next(shingle_sets(block, SHINGLE)))
        widths.append(min(words, SHINGLE))
        held += len(sets[-1])
        if held >= BLOCK_SHINGLES:
            yield ItemIndex(ids, sets, widths)
            ids, sets, widths, held = [], [], [], 0
    if ids:
        yield ItemIndex(ids, sets, widths)


def _found(narrow: DataFrame, index: ItemIndex, schema: str, item_type: pa.DataType):
    """(rows for one block of items, its broadcast)"""
    shared = narrow.sparkSession.sparkContext.broadcast(index)

    def search(batches):
        index = shared.value
        for batch in batches:
            at, item, n = [], [], []
            for block in map(lowered, blocks(batch.column(1))):
                starts, ends = block.words()
                hashes = run_hashes(block.buf, starts, ends)
                cuts = block.bounds(starts)
                for width in index.widths:
                    windows = window_hashes(hashes, width)
                    for i in range(block.docs):
                        a, b = int(cuts[i]), int(cuts[i + 1]) - width + 1
                        for k, s in index.search(np.unique(windows[a:b]), width) if b > a else ():
                            at.append(block.first + i)
                            item.append(k)
                            n.append(s)
            if at:
                of = index.sizes[item]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([index.ids[k] for k in item], item_type), pa.array(n, pa.int64()), pa.array(of), pa.array(np.array(n) / of)],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

    return narrow.mapInArrow(trimmed(search), schema), shared


def find_contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item with containment of at least 0.75."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc, item = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {doc}, item_id {item}, n_shared long, n_item long, containment double"
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    blocks_left = _item_blocks(items)
    index, following = next(blocks_left, None), next(blocks_left, None)
    if index is None:
        return docs.sparkSession.createDataFrame([], schema)
    if following is None:
        return _found(narrow, index, schema, item_type)[0]
    out = None
    while index is not None:
        part, shared = _found(narrow, index, schema, item_type)
        part = store(part).df
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
        index, following = following, next(blocks_left, None)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a test item."""
    bad = store(find_contained(docs, items).select("doc_id").where("doc_id is not null").distinct())
    return keep_ids(docs, bad.df, "left_anti")
