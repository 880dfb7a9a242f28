"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest; rests are cut into
pieces of at most ``MAX_PIECE``.  Groups of pieces, about ``GROUP`` windows each,
are spread over k = ceil(tokens / capacity) windows: partial partitions are
merged, those of the largest difference first, each one's fullest window with
the other's emptiest.  If a window exceeds the capacity, k rises by one and the
group is spread anew.  Groups are made from consecutive documents of one input
partition, so nothing is shuffled and memory is bounded by a group and one text.

Defined results: null text is the empty text (one piece holding the end id);
null and repeated document ids are kept as they are, one set of pieces a row; an
empty table gives no rows; columns beside the two named ones are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tokens import END_ID, encoder, text_slices, vocabulary_file

CAPACITY = 4096
MAX_PIECE = 1024
GROUP = 128


def _merge(a: list, b: list, k: int) -> list:
    """Two partial partitions, each its non-empty windows (sum, items) in falling order, of k windows."""
    la, lb = len(a), len(b)
    out = [(s + b[k - 1 - i][0], (items, b[k - 1 - i][1])) if k - 1 - i < lb else (s, items)
           for i, (s, items) in enumerate(a)]
    out += b[:max(0, min(lb, k - la))]
    out.sort(key=lambda w: -w[0])
    return out


def _items(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += (x[1], x[0])
        else:
            out.append(x)
    return out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Spread items over k windows with near-equal sums; the items' numbers by window."""
    if not sizes:
        return []
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)] if k > 1 else []
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        m = _merge(a, b, k)
        low = m[-1][0] if len(m) == k else 0
        heapq.heappush(heap, (low - m[0][0], n, m))
        n += 1
    return [_items(w[1]) for w in heap[0][2]]


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; no size may exceed it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_partition(file: str, end_id: int, capacity: int, max_piece: int, group: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []   # finished pieces
        held: list[tuple] = []   # (doc_id, start, ids, doc_tokens) waiting for their group
        waiting = 0

        def put(piece: tuple, offset: int) -> None:
            doc, start, ids, total = piece
            row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
            rows.append((*row, ids) if with_ids else row)

        def close() -> None:
            nonlocal sequence, held, waiting
            for window in pack_sizes([len(p[2]) // 4 for p in held], capacity) if held else []:
                offset = 0
                for i in window:
                    put(held[i], offset)
                    offset += len(held[i][2]) // 4
                sequence += 1
            held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows
            cols = list(zip(*rows))
            rows = []
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, dtype="<i4") for b in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.record_batch(arrays, names=names)

        for batch in batches:
            docs = batch.column(0)
            for first, texts in text_slices(batch):
                for j, ids in enumerate(enc.encode(texts)):
                    ids += end
                    doc, total, at = docs[first + j].as_py(), len(ids) // 4, 0
                    while total - at >= capacity:
                        put((doc, at, ids[4 * at:4 * (at + capacity)], total), 0)
                        sequence += 1
                        at += capacity
                    rest = total - at
                    if rest:
                        cuts = -(-rest // max_piece)
                        bounds = [at + rest * c // cuts for c in range(cuts + 1)]
                        held += [(doc, a, ids[4 * a:4 * b], total) for a, b in zip(bounds[:-1], bounds[1:])]
                        waiting += rest
                    if waiting >= group * capacity:
                        close()
                    if len(rows) >= 4000:
                        yield flush()
        close()
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY,
         max_piece: int = MAX_PIECE, group: int = GROUP, with_ids: bool = False,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the columns of ``PIECES``, and ``ids`` (array<int>) if asked for."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    run = _pack_partition(vocabulary or vocabulary_file(), end_id, capacity, min(max_piece, capacity), group, with_ids)
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
