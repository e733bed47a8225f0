"""The operators on small tables against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from brute import deduped_lines, grouped, jaccard, shingles, tokens
from pyspark.sql import functions as F

from revlattice.llm import components as cc
from revlattice.llm import exact_dedup as dedup
from revlattice.llm import line_dedup, topk
from revlattice.llm.components import components
from revlattice.llm.jaccard import jaccard_components, one_of_each
from revlattice.llm.lm import lm_scores
from revlattice.llm.mixing import mix_sources, mixture, quotas_by_weight
from revlattice.llm.packing import pack_documents
from revlattice.llm.quality import keep_good, quality_scores
from revlattice.llm.runtime import shared_dir
from revlattice.llm.token_counts import token_counts
from revlattice.llm.token_files import Reader, read_documents, write_token_files
from revlattice.llm.tokens import tokenizer_path

#: Extra columns whose names the operators use inside.
EXTRA = ("id", "key", "row", "h", "pattern", "size", "lines", "rid", "may", "gone", "x", "score", "n_dropped", "digest", "repeats")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in EXTRA)


def frame(spark, rows):
    """Rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, *["?"] * len(EXTRA)) for i, t, s in rows], SCHEMA)


def corpus(seed=1, n=60):
    """Documents with exact and near copies, shared passages, repeated lines and rows, null and empty values."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, out = text(60), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            out.append((i, r.choice(out)[1], f"s{i % 3}"))
        elif kind == 2 and out:
            w = (r.choice(out)[1] or "").split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            out.append((i, " ".join(w), f"s{i % 3}"))
        elif kind == 3:
            out.append((i, text(40) + "\n" + passage + ".\n" + text(r.randint(1, 30)), None))
        else:
            out.append((i, "\n".join(text(r.randint(1, 40)) for _ in range(r.randint(1, 4))), f"s{i % 3}"))
    out += [(n, None, "s0"), (n + 1, "", "s1"), (n + 2, " \n\t ", None), (n + 3, "one", "s0"), (n + 4, "ONE", "s0"), (n + 5, text(4000), "s2"), (n + 6, None, "s1"), out[5], out[5], (None, out[5][1], "s0"), (None, None, None), (n + 7, "é ß " + text(5), "Z")]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.mark.parametrize("most", [cc.ONE_TASK, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(cc, "ONE_TASK", most)
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = grouped(pairs, {n for p in pairs for n in p})
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    rows = corpus(seed, 90)
    got = jaccard_components(frame(spark, rows).repartition(4)).collect()
    want = jaccard(rows)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingles(t))) for i, t, _ in rows)
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert len(set(want.values())) < len(want) - 10


def test_jaccard_edges(spark, nothing):
    assert jaccard_components(nothing).count() == 0
    # One document of two rows ties two groups together; small sets at the threshold.
    rows = [(1, "a b c d e f g h i j k l", "s"), (2, "m n o p q r s t", "s"), (2, "a b c d e f g h i j k l", "s"), (3, "m n o p q r s t", "s"), (4, "a b c d e f g", "s"), (5, "a b c d e f g h", "s"), (6, "x", "s"), (7, "X ", "s"), (8, "x y", "s")]
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}


def test_one_of_each(spark, docs, rows):
    want = jaccard(rows)
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((i, t)) for i, t, _ in rows if i is None or want[i] == i)


def test_mixing(spark, docs, rows, nothing):
    held = {}
    got = mix_sources(docs, quotas_by_weight(held=held)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(tokens(t))
    assert held["sizes"] == dict(sizes) and abs(sum(held["targets"].values()) - sum(sizes.values())) < 1e-6
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.repeats <= 3
        taken[r.pattern[0]] += r.repeats * r.size
    for s, target in held["targets"].items():
        largest = max(len(tokens(t)) for _, t, x in rows if x == s)
        assert abs(taken[s] - target) <= largest / 2 + 1
    again = mix_sources(docs.repartition(5), quotas_by_weight()).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixture(docs, quotas_by_weight())
    assert mixed.columns == docs.columns
    counts = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    want = collections.Counter()
    for r in got:
        want[r.id] += r.repeats
    by_id = collections.Counter()
    for (i, _), n in counts.items():
        by_id[i] += n
    assert by_id == +want
    assert mix_sources(nothing, quotas_by_weight()).count() == 0 and mixture(nothing, quotas_by_weight()).count() == 0


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 9), "ab" if i % 3 else "a") for i in range(200)]
    parts = F.array_sort(F.split("source", ""))
    got = mix_sources(frame(spark, rows), lambda totals: {"a": sum(totals.values()) * 0.5, "b": sum(totals.values()) * 0.7}, parts).collect()
    total = sum(1 + i % 9 for i in range(200))
    assert abs(sum(r.repeats * r.size for r in got) - 1.2 * total) <= 10


def _encoder(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(name))
    return lambda t, end: np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, docs, rows, nothing):
    encode = _encoder("byte_bpe_50k.json")
    files = write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), end=0)
    got = sorted(read_documents(spark, files).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(-1 if i is None else i for i, _, _ in rows)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    want = [(-1 if i is None else i, len(e), zlib.crc32(e.tobytes())) for i, t, _ in rows for e in [encode(t, 0)]]
    assert sorted(zip(ids, (r.n_tokens for r in got), (r.ids_crc32 for r in got), strict=True)) == sorted(want)
    assert Reader(files[0][0]).bits == 16
    assert read_documents(spark, write_token_files(nothing, tokenizer_path("byte_bpe_50k.json"), end=0)).count() == 0


def test_packing(spark, docs, rows, nothing):
    encode = _encoder("word_bpe_49k.json")
    got = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end=1, chunk=40).collect()
    windows = collections.defaultdict(list)
    pieces = collections.Counter((-1 if p.doc_id is None else p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got)
    for p in got:
        windows[p.sequence_id].append((p.offset, p.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t, _ in rows:
        e, at = encode(t, 1), 0
        mine = sorted({p for p in pieces if p[0] == (-1 if i is None else i) and p[4] == len(e)})
        while at < len(e):
            p = next(p for p in mine if p[1] == at and p[3] == zlib.crc32(e[at : at + p[2]].tobytes()))
            pieces[p] -= 1
            at += p[2]
    assert not +pieces and not -pieces
    assert pack_documents(nothing, tokenizer_path("word_bpe_49k.json"), end=1).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(spark, docs, rows, nothing, order):
    end = b"\0"
    training = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    contexts = lambda w, k: [tuple([None] * k + w)[i : i + k] for i in range(len(w))]
    c, grams, after, kinds = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        if training(i):
            w = [*tokens(t), end]
            c.update(w)
            for k in range(1, order):
                grams.update(zip(contexts(w, k), w, strict=True))
    for (a, _), n in grams.items():
        after[a] += n
        kinds[a] += 1
    total, unknown = sum(c.values()), sum(n == 1 for n in c.values()) / sum(c.values())
    want = collections.defaultdict(list)
    for i, t, _ in rows:
        w = [*tokens(t), end]
        p = [(1 - unknown) * c[b] / total if b in c else unknown for b in w]
        for k in range(1, order):
            p = [max(grams[a, b] - 0.75, 0) / after[a] + 0.75 * kinds[a] / after[a] * x if after[a] else x for a, b, x in zip(contexts(w, k), w, p, strict=True)]
        base = sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w)
        want[i].append((len(w), sum(x in c for x in w), base, sum(map(math.log10, p))))
    got = lm_scores(docs, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.train_tokens == total and r.held_out == (not training(r.doc_id))
        assert any(r.n_tokens == n and r.n_known == k and abs(r.base_score - b) < 1e-6 and abs(r.score - s) < 0.02 * n for n, k, b, s in want[r.doc_id]), r
    assert lm_scores(nothing, order=order).count() == 0
    only_held = next(i for i in range(1000) if not training(i))
    (r,) = lm_scores(frame(spark, [(only_held, "a b", "s")]), order=order).collect()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_lm_work_files(docs):
    """Of a run only the packed blocks and the answers stay in the shared folder: tries go once their shard has answered."""
    folder = Path(shared_dir(docs.sparkSession, "any").removeprefix("file://")).parent
    before = set(folder.rglob("*"))
    assert lm_scores(docs).count() == docs.count()
    made = [p for p in folder.rglob("*") if p.is_file() and p not in before]
    assert any(p.name.startswith("block-") for p in made)
    assert all(p.name.startswith("block-") or p.parent.name.startswith(("lm-blocks-", "lm-words-", "lm-2-grams-", "lm-3-grams-")) for p in made), made


def test_lm_order(docs):
    with pytest.raises(ValueError):
        lm_scores(docs, order=0)


def test_line_dedup(spark, nothing):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(400)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    common, long = [line(9) for _ in range(6)], line(120)
    near = [long.replace(w, w[:-1] + "x", 1) for w in long.split()[:25]]
    rows = [(i, "\n".join([line(8), r.choice(common), near[i % 25], "  " + r.choice(common).upper() + "!", "short one", line(5)]), "s") for i in range(70)]
    rows += [(100, None, "s"), (101, "", "s"), rows[3], rows[3], (None, rows[4][1], "s"), (102, f"{common[0]}\n\n{common[0]}", "s")]
    docs = frame(spark, rows).repartition(3)
    out = line_dedup.dedup_lines(docs)
    assert [c for c in out.columns if c != "n_dropped"] == [c for c in docs.columns if c != "n_dropped"]
    got = collections.defaultdict(list)
    for x in out.collect():
        got[x.doc_id].append((x.text, x.n_dropped))
    want, links = deduped_lines(rows)
    assert links > 5
    for (i, _, _), w in zip(rows, want, strict=True):
        assert w in got[i]
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_by_edit_similarity_alone(spark):
    """One word of 10, 20 or 40 replaced, and one letter of short lines: whatever the SimHashes, of each pair one line stays."""
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    pairs = []
    for k in [10, 20, 40] * 12:
        w = [word() for _ in range(k)]
        i = r.randrange(k)
        pairs.append((" ".join(w), " ".join([*w[:i], word(), *w[i + 1 :]])))
    for _ in range(12):
        t = " ".join(word() for _ in range(5))
        i = r.randrange(len(t))
        pairs.append((t, f"{t[:i]}q{t[i + 1:]}"))
    assert all(line_dedup.similar(a, b) for a, b in pairs)
    rows = [(2 * i + j, x, "s") for i, p in enumerate(pairs) for j, x in enumerate(p)]
    got = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: i % 2 for i, _, _ in rows}


def test_line_dedup_of_short_lines(spark):
    """Lines of one to three words, of a script without blanks and of signs only are deduplicated; blank lines stay."""
    lines = ["Read more", "Home", "All rights reserved", "\u8fd9\u662f\u4e00\u884c\u6ca1\u6709\u7a7a\u683c\u7684\u6587\u5b57", "* * *", "-----", "", "  "]
    rows = [(1, "\n".join(lines), "s"), (2, "\n".join(["READ  more!", *lines[1:], "Rest"]), "s"), (3, "***", "s"), (4, "Menu", "s")]
    got = {x.doc_id: (x.text, x.n_dropped) for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n  \nRest", 6), 3: ("***", 0), 4: ("Menu", 0)}


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("short", [False, True])
def test_exact_dedup(spark, docs, rows, nothing, monkeypatch, largest, short):
    """short: with digests that clash, so that the bytes decide."""
    monkeypatch.setattr(dedup, "HEAVY_SHARE", 0.05)
    cut = (lambda c: F.unhex(F.concat(F.substring(F.sha2(c, 256), 1, 1), F.lit("0" * 63)))) if short else None
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (max(known) if known else None) if largest else (None if None in ids else min(known))
        want += [str((i, stays, len(ids), i == stays and i not in ids[:n])) for n, i in enumerate(ids)]
    got = [str((r.id, r.keep_id, r.group_size, r.kept)) for r in dedup.exact_dedup(docs, keep_largest=largest, digest=cut).collect()]
    assert sorted(got) == sorted(want)
    if not short:
        assert dedup.exact_dedup(nothing).count() == 0


def test_digests_are_sha256(docs, rows):
    from revlattice.llm.queries import QUERIES  # noqa: F401

    got = {r.hex for r in dedup.exact_dedup(docs).select(F.lower(F.hex("digest")).alias("hex")).collect()}
    assert got == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows}


def test_quality(spark, nothing):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.8
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 80))]
        rows.append((i, ". ".join(words) if good else " ".join(w + r.choice(["###", "!!", "%%%"]) for w in words), "s"))
        if i % 2:
            labels.append((i, int(good), 0))
    docs = frame(spark, [*rows, (None, None, None), (700, "", "s"), (701, "x" * 50_000, "s"), rows[0]])
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, known).collect()
    assert len(got) == 604 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    truth, score = dict((i, q) for i, q, _ in labels), {x.doc_id: x for x in got}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(score[i].held_out for i in held) and len(held) > 30
    assert np.mean([score[i].predicted == truth[i] for i in held]) > 0.97
    again = {x.doc_id: x.score for x in quality_scores(docs.repartition(5), known).collect()}
    assert again == {i: x.score for i, x in score.items()}
    kept = keep_good(docs, known)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x.doc_id) for x in got if x.predicted)
    assert {x.score for x in quality_scores(docs, known.where("doc_id < 0")).collect()} == {0.5}
    assert quality_scores(nothing, known).count() == 0


@pytest.mark.parametrize("few", [topk.FEW, 0])
def test_topk(spark, monkeypatch, few):
    monkeypatch.setattr(topk, "FEW", few)
    r = random.Random(4)
    vec = lambda: [r.randint(-3, 3) / 8 for _ in range(6)]
    rows = [(i, vec()) for i in range(300)] + [(1000 + i, [0.25] * 6) for i in range(80)] + [(7, vec()), (200, vec()), (300, None), (400, [0.5, None, 0, 0, 0, 0]), (500, [float("nan")] * 6), (600, [float("inf")] * 6), (None, vec()), (700, [1.0, 2.0]), (701, [1.5, -2.0]), (800, [])]
    table = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "?", "?") for i, v in rows], "vec_id long, embedding array<double>, score string, rank string").withColumn("embedding", F.col("embedding").cast("array<float>")).repartition(4)
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    for block in (2048, 2):
        got = topk.exact_topk(table, "vec_id % 100 = 0", block=block).collect()
        assert sorted(tuple(x) for x in got) == sorted(want)
    assert topk.exact_topk(table, "vec_id < 0").count() == 0


def test_topk_of_large_numbers(spark):
    table = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -2.0]), (2, [-1e30, 2.0]), (3, [0.0, 1e12])], "vec_id long, embedding array<double>")
    got = [(x.id, x.score) for x in topk.exact_topk(table, "vec_id = 0").orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, int(1e12) * 1024 * 1024), (2, -(2**63))]


def test_token_counts(docs, rows, nothing):
    from revlattice.llm.token_counts import automaton

    one = automaton(tokenizer_path("piece_bpe_32k.model"))
    import pyarrow as pa

    want = [(-1 if i is None else i, int(one.count_rows(pa.array([t], pa.string()))[0])) for i, t, _ in rows]
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_counts(docs, tokenizer_path("piece_bpe_32k.model")).collect()]
    assert sorted(got) == sorted(want)
    assert token_counts(nothing, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_line_dedup_writes_no_row_for_a_line_that_stays_alone(spark, monkeypatch):
    written = {}

    def counted(df, name, write=line_dedup.materialize):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    rows = [(i, f"line {chr(97 + i) * 9} alone\n----\n \t\n\u00a0\n", "s") for i in range(20)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and all(out[i] == f"line {chr(97 + i) * 9} alone\n \t\n" for i in range(1, 20))
    assert written["lines"] == 60 and written["repeated-lines"] == 2 and "distinct-lines" not in written
