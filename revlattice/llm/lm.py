"""Language-model scores of documents from an n-gram model of the corpus in Elias-Fano tries.

The model: p1(w) is the share of w among the training tokens, less a mass for unknown words as large as the share of tokens
that occur once (Good-Turing); for a context h of k - 1 tokens pk(w | h) = max(c(h, w) - D, 0) / c(h) + D * n(h) / c(h) *
p(w | h without its first token), where n(h) is the number of different words after h: absolute discounting, interpolated,
from k = 2 to the order. After a context that has not been trained on, the next shorter one. The two parts of pk that depend
on h are what a trie holds, as quantised logarithms: an entry's discounted probability and a context's backoff.

No machine holds the model. Documents are packed into blocks, whose words and n-grams, each once with its training count,
go to shards by hash, one level after the other. A word shard sums counts and answers them. A shard of a level, which has all
words after its contexts, sums counts, writes its trie to a file, maps it into memory and answers with codes; no other task
asks it, so the file goes with the answers.
Contexts with more than a fixed share of all tokens, of which there can only be a bounded number a level, are spread over
all shards by the n-gram; each level's shards name those of the next. The blocks then add up their documents' scores from
the answers.

Words are known by hashes of 64 bits; contexts by 40 bits beside the shard, and words among a context's successors by 32.

Defined results: a null text counts as empty and has its end token only; a null identifier counts as the text "" in the hold-
out rule; repeated rows are trained on and scored each; without training documents every token is unknown, with score 0.
Other columns than the identifier and the text are not read.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elias_fano
from .runtime import bounded_batches, bucket_count, materialize, shared_dir
from .text import C1, joined, mix, word_hashes

HOLD_OUT = 7
HELD = 2
DISCOUNT = 0.75
BLOCK_BYTES = 12 << 20
#: A context of more than 1 / (SPREAD * shards) of all training tokens is spread over all shards: at most SPREAD * shards of them.
SPREAD = 4
END, START = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x5A4A5A4A5A4A5A4A)
LOW40, LOW32 = np.uint64((1 << 40) - 1), np.uint64((1 << 32) - 1)
#: How blocks' planes of token bytes are packed.
PACKED = pa.Codec("zstd", compression_level=1)
#: Tokens of the longest n-grams.
ORDER = 3


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % HOLD_OUT != HELD


class Block:
    """Tokens of some documents, as places in the sorted array of the block's words."""

    def __init__(self, doc_ids, valid, first, words, tokens):
        self.doc_ids, self.valid, self.first, self.words, self.tokens = doc_ids, valid, first, words, tokens
        self.training = np.array([is_training(int(d) if v else None) for d, v in zip(doc_ids, valid, strict=True)], bool)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Block:
        h, first = word_hashes(batch.column("text"))
        h = np.insert(h, first[1:], END)
        words, tokens = np.unique(h, return_inverse=True)
        column = batch.column("doc_id")
        return cls(np.asarray(column.fill_null(0)).astype(np.int64), np.asarray(column.is_valid()), first + np.arange(len(first)), words, tokens.astype(np.uint32))

    def save(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        arrays = {"doc_ids": self.doc_ids, "valid": self.valid.astype(np.uint8), "first": self.first, "words": self.words}
        wide = self.tokens.astype("<u4").view(np.uint8).reshape(-1, 4)  # planes of bytes, the empty ones left out
        planes = [PACKED.compress(wide[:, i].tobytes(), asbytes=True) for i in range(1 + (max(1, len(self.words) - 1).bit_length() - 1) // 8)]
        with system.open_output_stream(path) as out:
            parts = [a.tobytes() for a in arrays.values()] + planes
            out.write(np.array([len(self.doc_ids), len(self.words), len(self.tokens), len(planes), *map(len, planes)], "<i8").tobytes())
            for p in parts:
                out.write(p)

    @classmethod
    def load(cls, uri: str) -> Block:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            data = f.read()
        docs, words, tokens, planes = np.frombuffer(data, "<i8", 4).tolist()
        sizes = np.frombuffer(data, "<i8", planes, 32).tolist()
        at, out = 32 + 8 * planes, []
        for n, kind in ((docs, np.int64), (docs, bool), (docs + 1, np.int64), (words, np.uint64)):
            out.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        wide = np.zeros((tokens, 4), np.uint8)
        for i, size in enumerate(sizes):
            wide[:, i] = np.frombuffer(PACKED.decompress(data[at : at + size], tokens), np.uint8)
            at += size
        return cls(*out, wide.view("<u4").ravel())

    def word_counts(self) -> np.ndarray:
        """Of each word the training tokens."""
        use = np.repeat(self.training, np.diff(self.first))
        return np.bincount(self.tokens[use], minlength=len(self.words))

    def levels(self, order: int):
        """For 2 to `order` tokens: (contexts, words, training counts, place of each token's n-gram), contexts and words as hashes."""
        n, use = len(self.words), np.repeat(self.training, np.diff(self.first))
        back, start, named = self.tokens.astype(np.int64), START, self.words
        for _ in range(2, order + 1):
            before = np.empty(len(back), np.int64)
            before[1:] = back[:-1]
            before[self.first[:-1]] = len(named)
            pair, back = np.unique(before * n + self.tokens, return_inverse=True)
            context, word = np.append(named, start)[pair // n], self.words[pair % n]
            yield context, word, np.bincount(back[use], minlength=len(pair)), back
            named, start = chained(context, word), chained(start, START)


def chained(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with a word after it, from the bits by which shards know both."""
    with np.errstate(over="ignore"):
        return mix(np.bitwise_and(context, LOW40) * C1 + mix(np.bitwise_and(word, LOW32) + C1))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _small(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each, that number in front."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _gram_shards(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): the n-grams by shard, by the low bits of the context within one."""
    spread = np.isin(context, hot)
    shard = _shard(np.where(spread, mix(context * C1 + word), context), shards)
    order = np.argsort(shard.astype(np.uint64) << np.uint64(40) | context & LOW40, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _runs(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
    return start, np.diff(np.append(start, len(context)))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, by n-grams of up to `order` tokens."""
    if order < 1:
        raise ValueError("the order must be at least 1")
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    shards, folder = bucket_count(spark), shared_dir(spark, "lm")

    def tokenise(batches):
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), []
        for serial, batch in enumerate(joined(batches, BLOCK_BYTES)):
            block = Block.of(batch)
            name = f"{folder}/block-{part}-{serial}-{uuid.uuid4().hex[:12]}"
            block.save(name)
            rows.append((part << 32 | serial, name, int(block.word_counts().sum())))
        yield _batch(rows, "block long, file string, training long")

    def send_words(batches):
        for batch in batches:
            for number, file in zip(batch.column("block").to_pylist(), batch.column("file").to_pylist(), strict=True):
                block = Block.load(file)
                shard, count = _shard(block.words, shards), block.word_counts()
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                yield _batch([(s, number, file, block.words[o].tobytes(), _small(count[o])) for s in np.flatnonzero(np.diff(cuts)).tolist() for o in [order[cuts[s] : cuts[s + 1]]]], "shard int, block long, file string, words binary, counts binary")

    answer = "block long, file string, kind int, shard int, data binary"

    def answer_words(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        sizes = [len(w) // 8 for w in got["words"]]
        words = np.frombuffer(b"".join(got["words"]), np.uint64)
        named, back = np.unique(words, return_inverse=True)
        count = np.zeros(len(named), np.int64)
        np.add.at(count, back, np.concatenate([_wide(c) for c in got["counts"]]))
        every, at, rows, shard = count[back], 0, [], got["shard"][0]
        for n, block, file in zip(sizes, got["block"], got["file"], strict=True):
            rows.append((block, file, 0, shard, _small(every[at : at + n])))
            at += n
        high = count > least_hot
        stats = np.concatenate([np.array([(count > 0).sum(), (count == 1).sum()], np.int64), count[high]])
        rows.append((-1, "", int(high.sum()), shard, stats.tobytes() + named[high].tobytes()))
        return pa.Table.from_batches([_batch(rows, answer)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(rows.mapInArrow(tokenise, "block long, file string, training long"), "lm-blocks")
    total = int(blocks.agg(F.sum("training")).first()[0] or 0)
    least_hot = total // (SPREAD * shards)
    sent = blocks.select("block", "file").repartition(shards // 2)
    words = materialize(sent.mapInArrow(send_words, "shard int, block long, file string, words binary, counts binary").groupBy("shard").applyInArrow(answer_words, answer), "lm-words")
    vocabulary, once, hot_words, hot_counts = 0, 0, [START], [0]
    for r in words.where("block = -1").collect():  # a row per shard
        n = np.frombuffer(r.data, np.int64, 2 + r.kind)
        vocabulary, once = vocabulary + int(n[0]), once + int(n[1])
        hot_counts += n[2:].tolist()
        hot_words += list(np.frombuffer(r.data, np.uint64, r.kind, 8 * (2 + r.kind)))
    start_count = blocks.select("file").mapInArrow(_training_documents, "n long").agg(F.sum("n")).first()[0] or 0
    hot_counts[0] = int(start_count)
    hot, hot_count = _sorted_hot(hot_words, hot_counts)
    sizes = "shard int, block long, file string, contexts binary, runs binary, words binary, counts binary"

    def level(k: int, hot: np.ndarray, hot_count: np.ndarray):
        """Functions that send the k-grams of blocks to shards and that answer them there."""

        def send(batches):
            for batch in batches:
                for number, file in zip(batch.column("block").to_pylist(), batch.column("file").to_pylist(), strict=True):
                    block = Block.load(file)
                    *_, (context, word, count, _) = block.levels(k)
                    by_shard, cuts = _gram_shards(context, word, hot, shards)
                    out = []
                    for s in np.flatnonzero(np.diff(cuts)).tolist():
                        o = by_shard[cuts[s] : cuts[s + 1]]
                        low = context[o] & LOW40
                        start, run = _runs(low)
                        out.append((s, number, file, elias_fano.encode(low[start]), _small(run), word[o].astype("<u4").tobytes(), _small(count[o])))
                    yield _batch(out, sizes)

        def answers(table: pa.Table) -> pa.Table:
            got = table.select(["shard", "block", "file", "contexts", "runs", "words", "counts"]).to_pydict()
            run = [_wide(r) for r in got["runs"]]
            asked = np.concatenate([elias_fano.decode(c) for c in got.pop("contexts")])
            runs = np.concatenate(run)
            word, count = np.frombuffer(b"".join(got.pop("words")), "<u4"), np.concatenate([_wide(c) for c in got.pop("counts")])
            c = np.repeat(asked, runs)
            by_gram = np.lexsort((word, c))
            c, w = c[by_gram], word[by_gram].astype(np.uint64)
            new = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))[: len(c)]
            first, gram = np.flatnonzero(new), np.empty(len(c), np.int64)
            gram[by_gram] = np.cumsum(new) - 1  # of each asked n-gram its place among the different ones
            every_c, every_w, n = c[first], w[first], np.add.reduceat(count[by_gram], first) if len(first) else count[:0]
            seen = n > 0
            c, w, n = every_c[seen], every_w[seen], n[seen]
            start, size = _runs(c)
            whole = np.add.reduceat(n, start) if len(start) else n[:0]
            low, place = hot & LOW40, np.zeros(len(start), np.int64)
            by_low = np.argsort(low)
            place = by_low[np.minimum(np.searchsorted(low[by_low], c[start]), len(low) - 1)]
            spread = low[place] == c[start]  # of these the shard has a part only: their count is known, their backoff is made up by the driver
            whole = np.where(spread, hot_count[place], whole)
            log_prob = np.log10(np.maximum(n - DISCOUNT, 1e-9) / np.repeat(whole, size))
            shard = got["shard"][0]
            trie = _mapped(elias_fano.build(c, w, log_prob, c[start], np.log10(DISCOUNT * size / whole)))
            begin, many = _runs(every_c)
            codes, back = trie.lookup(every_c[begin], every_w, many)
            back = np.repeat(back, many)[gram[np.cumsum(runs) - runs]]
            codes = codes[gram]
            at, own, out = 0, 0, []
            for block, file, r in zip(got["block"], got["file"], run, strict=True):
                m = int(r.sum())
                out.append((block, file, k, shard, np.array(trie.scale).tobytes() + codes[at : at + m].tobytes() + back[own : own + len(r)].tobytes()))
                at, own = at + m, own + len(r)
            high = (n > least_hot) & (w != END & LOW32)  # contexts of the next level to be spread
            out.append((-1, "", int(spread.sum()), shard, place[spread].tobytes() + size[spread].tobytes() + chained(c[high], w[high]).tobytes() + n[high].tobytes()))
            return pa.Table.from_batches([_batch(out, answer)])

        return send, answers

    tables, hots, start = [words], [], START
    for k in range(2, order + 1):
        send, answers = level(k, hot, hot_count)
        table = materialize(sent.mapInArrow(send, sizes).groupBy("shard").applyInArrow(answers, answer), f"lm-{k}-grams")
        tables.append(table)
        after = np.zeros(len(hot), np.int64)  # different words after each spread context
        start = chained(start, START)
        next_words, next_counts = [start], [int(start_count)]
        for r in table.where("block = -1").toLocalIterator():
            part = np.frombuffer(r.data, np.int64, 2 * r.kind).reshape(2, -1)
            after[part[0]] += part[1]
            more = np.frombuffer(r.data, np.uint64, offset=16 * r.kind).reshape(2, -1)
            next_words += list(more[0])
            next_counts += more[1].astype(np.int64).tolist()
        hots.append((hot, hot_count, after))
        hot, hot_count = _sorted_hot(next_words, next_counts)
    unknown = min(max(once / total, 1 / (total + 1)), 0.5) if total else 1.0

    def add_up(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        block = Block.load(got["file"][0])
        answers = {(k, s): d for k, s, d in zip(got["kind"], got["shard"], got["data"], strict=True)}
        shard = _shard(block.words, shards)
        by_shard = np.argsort(shard, kind="stable")
        count = np.zeros(len(block.words), np.int64)
        count[by_shard] = np.concatenate([_wide(answers[0, s]) for s in np.unique(shard).tolist()])
        p1 = np.where(count > 0, (1 - unknown) * count / max(total, 1), unknown)
        p = p1[block.tokens]  # of each token, by contexts of the levels so far
        for k, (context, word, _, back) in enumerate(block.levels(order), 2):
            hot, hot_count, after = hots[k - 2]
            by_shard, cuts = _gram_shards(context, word, hot, shards)
            direct, backoff = np.zeros(len(context)), np.ones(len(context))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                data, o = answers[k, s], by_shard[cuts[s] : cuts[s + 1]]
                scale, m = np.frombuffer(data, np.float64, 4), len(o)
                start, run = _runs(context[o] & LOW40)
                codes, back_codes = np.frombuffer(data, np.uint8, m, 32), np.repeat(np.frombuffer(data, np.uint8, len(start), 32 + m), run)
                direct[o] = np.where(codes > 0, 10.0 ** elias_fano.restored(codes, scale[0], scale[1]), 0)
                backoff[o] = np.where(back_codes > 0, 10.0 ** elias_fano.restored(back_codes, scale[2], scale[3]), 1)
            place = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            spread = (hot[place] == context) & (hot_count[place] > 0)
            backoff[spread] = DISCOUNT * after[place[spread]] / hot_count[place[spread]]
            # A context that was never trained on has no entry and backs off wholly.
            p = direct[back] + backoff[back] * p
        log = np.log10(p)
        base = np.log10((count + 1) / (total + vocabulary + 1))[block.tokens]
        known = (count > 0)[block.tokens]
        first = block.first[:-1]
        sums = [np.add.reduceat(x.astype(np.float64), first) for x in (base, log, known)]
        return pa.table({
            "doc_id": pa.array(block.doc_ids, mask=~block.valid), "held_out": ~block.training, "n_tokens": np.diff(block.first), "n_known": sums[2].astype(np.int64),
            "train_tokens": np.full(len(first), total), "base_score": sums[0], "score": sums[1],
        })

    every = reduce(DataFrame.unionByName, (t.where("block >= 0") for t in tables))
    return every.groupBy("block").applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sorted_hot(words: list, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    words, by_word = np.unique(np.array(words, np.uint64), return_index=True)
    return words, np.array(counts, np.int64)[by_word]


def _training_documents(batches):
    for batch in batches:
        yield _batch([(int(Block.load(f).training.sum()),) for f in batch.column("file").to_pylist()], "n long")


def _mapped(data: bytes) -> elias_fano.Trie:
    """The trie in a file of the worker's temporary folder, mapped into memory; the file has no name and goes with the trie."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return elias_fano.Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
