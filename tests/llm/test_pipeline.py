"""The pipeline, stage by stage, against brute force on a small corpus."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import deduped_lines, jaccard, tokens

import corpus_pipeline
from revlattice.llm import quality
from revlattice.llm.mixing import quotas_by_weight
from revlattice.llm.tokens import tokenizer_path

NAMES = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k)) + "."
    common, rows, labels = [line(12) for _ in range(4)], [], []
    for i in range(240):
        good = r.random() < 0.8
        text = "\n".join([line(r.randint(5, 40)) for _ in range(r.randint(1, 4))] + ([r.choice(common)] if i % 3 == 0 else []))
        if i % 7 == 1:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "changed"
            text, good = " ".join(w), True
        if i % 10 == 5:  # a near copy with other line ends, which only the join on shingles sees
            w = rows[-1][1].split()
            text, good = "\n".join(" ".join(w[k : k + 11]) for k in range(0, len(w), 11)), True
        if not good:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", None if i % 11 == 0 else f"s{i % 3}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        held[name] = docs, spark.read.parquet(f"{tmp_path}/{name}")
        docs = held[name][1]
        if name != "packing":
            assert docs.columns == list(NAMES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near duplicates", "mixing", "packing"]

    before, after = (rows_of(x) for x in held["quality"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    fit_on = [r for r in before if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 5]
    stats = lambda rows: quality.statistics(pa.array([r[1] for r in rows]))
    trees = quality.fit(stats(fit_on), np.array([labels[r[0]] for r in fit_on], float))
    assert after == [r for r, s in zip(before, trees.score(stats(before)), strict=True) if s >= 0.3]
    assert 20 < len(before) - len(after) < 80

    before, after = (rows_of(x) for x in held["line dedup"])
    want = [(i, t, lang, s, len(t) if n else chars) for (i, _, lang, s, chars), (t, n) in zip(before, deduped_lines(before)[0], strict=True) if not n or t.strip()]
    assert after == want and sum(len(r[1]) for r in after) < sum(len(r[1]) for r in before)

    before, after = (rows_of(x) for x in held["near duplicates"])
    component = jaccard(before)
    assert after == [r for r in before if component[r[0]] == r[0]] and len(after) < len(before)

    before, after = (rows_of(x) for x in held["mixing"])
    sizes, taken, times = collections.Counter(), collections.Counter(), collections.Counter(after)
    for r in before:
        sizes[r[3]] += len(tokens(r[1]))
    for r, n in times.items():
        assert r in before and n <= 3
        taken[r[3]] += n * len(tokens(r[1]))
    targets = quotas_by_weight()({(s,): n for s, n in sizes.items()})
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(len(tokens(r[1])) for r in before if r[3] == s) / 2 + 1

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    before, pieces = held["mixing"][1].collect(), held["packing"][1].collect()
    want, got = collections.Counter(), collections.Counter()
    for r in before:
        ids = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        for p in {(p.start, p.length) for p in pieces if p.doc_id == r.doc_id}:
            want[r.doc_id, p[0], zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes())] += 1
    windows = collections.Counter()
    for p in pieces:
        got[p.doc_id, p.start, p.ids_crc32] += 1
        windows[p.sequence_id] += p.length
    assert got == want and max(windows.values()) <= 2048


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.columns[0] == "doc_id"
    assert corpus_pipeline.ORACLE_SQL is None
