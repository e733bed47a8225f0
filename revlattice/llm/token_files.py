"""Token ids in files of fixed-width bit packing.

A file holds the ids of some documents one after another, each id in the fewest bits that hold every id of the vocabulary,
most significant bit first, in blocks of a fixed number of ids that start at whole bytes. Behind the blocks stand the
blocks' byte offsets, the documents' identifiers and starts, then a fixed footer. A reader unpacks any range of ids from
the blocks that hold it, with numpy, without reading the rest.

The documents are dealt by ranges of their identifier (repeated ones also by a hash of the text, so that one identifier
doesn't fill one range) and sorted; each range is a file, written under a name of its own by the attempt that writes it, and
the manifest names the files of the attempts that succeeded. Files go to the shared folder, through any file system that
pyarrow opens by URI.

Defined results: a null text counts as empty and has its end id only; null identifiers come first; repeated identifiers have
a place for each row; without documents there are no files. Other columns than the identifier and the text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bounded_batches, materialize, shared_dir, shuffle_partitions
from .text import joined
from .tokens import encoder as shared_encoder

#: Fixed values of the file format.
MAGIC = b"TOKBITS1"
FOOTER = struct.Struct("<QQQQQ8s")  # ids, blocks, documents, bits of an id, ids of a block, magic
BLOCK_IDS = 4096
ENCODE_BYTES = 2 << 20


def id_bits(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, most significant first, filled up to a whole byte."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a block."""
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    def __init__(self, uri: str, bits: int):
        self.system, path = fs.FileSystem.from_uri(uri)
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.bits = self.system.open_output_stream(path), bits
        self.waiting, self.offsets, self.at, self.ids = np.zeros(0, np.uint32), [], 0, 0
        self.doc_ids: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []

    def add(self, ids: np.ndarray, first: np.ndarray, doc_ids: np.ndarray, valid: np.ndarray) -> None:
        """Documents in order: document i has ids[first[i]:first[i + 1]]."""
        self.starts.append(first[:-1].astype("<i8") + self.ids)
        self.doc_ids.append(np.stack([doc_ids.astype("<i8"), valid.astype("<i8")], 1))
        self.ids += len(ids)
        self.waiting = np.concatenate([self.waiting, ids])
        whole = len(self.waiting) // BLOCK_IDS * BLOCK_IDS
        self._blocks(self.waiting[:whole])
        self.waiting = self.waiting[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        step = (BLOCK_IDS * self.bits + 7) // 8
        for i in range(0, len(ids), BLOCK_IDS):
            self.offsets.append(self.at + i // BLOCK_IDS * step)
        data = packed(ids, self.bits)  # blocks of a multiple of eight ids end at whole bytes
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.waiting):
            self._blocks(self.waiting)
        docs = np.concatenate(self.doc_ids)
        self.out.write(np.array(self.offsets, "<i8").tobytes() + docs.tobytes() + np.concatenate(self.starts).tobytes())
        self.out.write(FOOTER.pack(self.ids, len(self.offsets), len(docs), self.bits, BLOCK_IDS, MAGIC))
        self.out.close()


class Reader:
    """Random access to a file's ids and documents."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.ids, blocks, docs, self.bits, self.block_ids, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        tail = self.file.read_at(8 * blocks + 24 * docs, size - FOOTER.size - 8 * blocks - 24 * docs)
        self.blocks_end = size - FOOTER.size - len(tail)
        self.offsets = np.frombuffer(tail, "<i8", blocks)
        named = np.frombuffer(tail, "<i8", 2 * docs, 8 * blocks).reshape(-1, 2)
        self.doc_ids, self.valid = named[:, 0], named[:, 1].astype(bool)
        self.starts = np.append(np.frombuffer(tail, "<i8", docs, 8 * blocks + 16 * docs), self.ids)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids + 1
        begin = int(self.offsets[a])
        end = int(self.offsets[b]) if b < len(self.offsets) else self.blocks_end
        data = self.file.read_at(end - begin, begin)
        out = unpacked(data, min(b * self.block_ids, self.ids) - a * self.block_ids, self.bits)
        return out[start - a * self.block_ids : stop - a * self.block_ids]

    def documents(self, most_ids: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last + 1, their ids) in turn, about most_ids at a time."""
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most_ids, "right")) - 1)
            j = min(j, len(self.doc_ids))
            yield i, j, self.read(int(self.starts[i]), int(self.starts[j]))
            i = j


def write_token_files(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> list[tuple[str, int, int]]:
    """Writes all documents in ascending order of identifier; the manifest: (file, start of its first id among all ids, documents) in order.

    tokenizer: the path of a tokenizer file on every machine. end: the id that closes each document. The manifest has one
    entry per partition of the shuffle.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")

    def work(batches):
        from pyspark import TaskContext

        part, encoder, writer, docs = TaskContext.get().partitionId(), None, None, 0
        for batch in joined(batches, ENCODE_BYTES):
            if not writer:
                encoder = shared_encoder(tokenizer)
                name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.tok"
                writer = Writer(f"{folder}/{name}", id_bits(encoder.vocab_size))
            ids, first = encoder.encode(batch.column("text"), end)
            column = batch.column("doc_id")
            writer.add(ids, first, np.asarray(column.fill_null(0)), np.asarray(column.is_valid()))
            docs += batch.num_rows
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "ids": [writer.ids], "docs": [docs]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    made = materialize(dealt.mapInArrow(work, "part int, name string, ids long, docs long"), "token-manifest")
    out, start = [], 0
    for r in made.orderBy("part").collect():
        out.append((f"{folder}/{r.name}", start, r.docs))
        start += r.ids
    return out


def read_documents(spark: SparkSession, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: start counts the ids of all documents before it."""

    def work(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader = Reader(name)
                for i, j, ids in reader.documents():
                    data, at = ids.astype("<u4").tobytes(), (reader.starts[i : j + 1] - reader.starts[i]).tolist()
                    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                    columns = [pa.array(reader.doc_ids[i:j], mask=~reader.valid[i:j]), reader.starts[i:j] + base, np.diff(at), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if not isinstance(c, pa.Array) else c for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(f, s) for f, s, _ in manifest], "file string, base long")
    return files.repartition(max(1, len(manifest))).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
