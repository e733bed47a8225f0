"""Packing documents into sequences of bounded length by Karmarkar-Karp multiway differencing.

A document's ids beyond whole windows, its remainder, shares windows with other remainders; a remainder above `piece` ids is
cut, so that windows hold enough pieces to come out near equal. A task packs its pieces in chunks of bounded number. In a
chunk every piece starts as a partial partition into k windows, one of them filled. The two partial partitions of largest
imbalance are merged again and again, the fullest window of the one with the emptiest of the other, until one is left.
k starts at what the ids need at least and rises whenever a window exceeds the capacity.

Defined results: a null text counts as empty and has its end id only; rows with the same or no identifier are packed each on
its own; empty tables give no pieces. A rerun over the same partitions gives the same sequences.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches
from .text import joined
from .tokens import encoder as shared_encoder

CAPACITY = 2048
PIECE = 512
#: Pieces of a chunk, which is packed on its own.
CHUNK_PIECES = 1500
#: Bytes of text encoded at once: the arrays of its pieces take some 25 times that.
BLOCK_BYTES = 1 << 20


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """The pieces of each of k windows, by multiway differencing."""
    n = len(sizes)
    left, right = np.full(n + n * k, -1), np.full(n + n * k, -1)  # a node is a piece, or the union of two nodes
    made = n
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        sums, nodes = np.array([sizes[i]]), np.array([i])  # in descending order; windows of sum 0 after them stay implicit
        heap.append((-int(sizes[i]), i, sums, nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        both = max(0, len(sa) + len(sb) - k)  # so many windows get something of both
        ta, tb = len(sa) - both, len(sb) - both
        joint = np.arange(made, made + both)
        left[joint], right[joint] = na[ta:], nb[tb:][::-1]
        made += both
        sums = np.concatenate([sa[:ta], sb[:tb], sa[ta:] + sb[tb:][::-1]])
        nodes = np.concatenate([na[:ta], nb[:tb], joint])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (-int(sums[0] - low), serial, sums - low if low else sums, nodes))
        serial += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += [int(left[x]), int(right[x])]
        out.append(sorted(items))
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Pieces, none above the capacity, in windows of at most the capacity: as few as differencing reaches."""
    sizes = np.asarray(sizes, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        windows = differencing(sizes, k)
        sums = np.array([sizes[w].sum() for w in windows])
        over = int(np.maximum(sums - capacity, 0).sum()) if len(sums) else 0
        if not over:
            return windows
        k += max(1, over // capacity)


def cut_document(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Lengths of the pieces of a document of n ids: whole windows, then its remainder in near-equal pieces of at most `piece`."""
    whole, rest = divmod(n, capacity)
    parts = -(-rest // piece)
    return [capacity] * whole + [rest // parts + (i < rest % parts) for i in range(parts)]


def pack_documents(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, chunk: int = CHUNK_PIECES) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    tokenizer: the path of a tokenizer file on every machine. end: the id that closes each document.
    """
    bounded_batches(docs.sparkSession)

    def work(batches):
        from pyspark import TaskContext

        encoder, base, serial = shared_encoder(tokenizer), TaskContext.get().partitionId() << 36, 0
        whole: list[tuple] = []
        waiting: list[tuple] = []

        def shared() -> list[tuple]:
            nonlocal serial
            out = []
            for window in pack(np.array([p[2] for p in waiting]), capacity):
                offset = 0
                for i in window:
                    out.append((*waiting[i], base + serial, offset))
                    offset += waiting[i][2]
                serial += 1
            waiting.clear()
            return out

        for batch in joined(batches, BLOCK_BYTES):
            ids, first = encoder.encode(batch.column("text"), end)
            data, first = ids.astype("<u4").tobytes(), first.tolist()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1], first[1:], strict=True):
                start = 0
                for n in cut_document(b - a, capacity, piece):
                    row = (doc, start, n, zlib.crc32(data[4 * (a + start) : 4 * (a + start + n)]), b - a)
                    if n == capacity:
                        whole.append((*row, base + serial, 0))
                        serial += 1
                    else:
                        waiting.append(row)
                    start += n
                if len(waiting) >= chunk:
                    whole += shared()
            yield _rows(whole)
            whole = []
        if waiting:
            yield _rows(shared())

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
