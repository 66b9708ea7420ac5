"""Long recordings in blocks, online features in a streaming query, dictionary words, models once a worker."""

import itertools
import json
import math
import shutil
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessitura.operators import alignment, ordered, segmenter
from tessitura.streaming import endpoints, frontend

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_align_as_one_piece(spark, block):
    rng = np.random.default_rng(block)
    rows, targets, want = [], [], []
    for k, (frames, tokens) in enumerate([(1, []), (2, [3]), (20, [1, 1, 2]), (23, [2, 3, 2, 3, 1]), (9, []), (6, [4, 4, 4, 4])]):
        scores = rng.integers(-3, 3, (frames, 5)).astype(float)  # ties are likely
        rows += [(f"u{k}", 10 * t + 3, scores[t].tolist()) for t in range(frames)]
        targets.append((f"u{k}", tokens))
        want += [(f"u{k}", 10 * t + 3, int(x)) for t, x in enumerate(alignment.align(scores, tokens))]
    rows.append(("no targets", 0, [0.0] * 5))
    want.append(("no targets", 0, 0))
    frames = spark.createDataFrame(rows, "k string, o long, s array<double>").repartition(3)
    own = spark.createDataFrame(targets, "k string, tokens array<int>")
    got = [tuple(r) for r in alignment.forced_align(frames, own, "k", "o", "s", block=block).collect()]
    assert sorted(got) == sorted(want)
    got = [tuple(r) for r in alignment.align_blocks(frames, own, "k", "o", "s", block=block).collect()]
    assert sorted(got) == sorted(want)


def test_blocks_of_an_empty_table(spark):
    frames = spark.createDataFrame([], "k string, o int, s array<float>")
    own = spark.createDataFrame([], "k string, tokens array<int>")
    assert alignment.forced_align(frames, own, "k", "o", "s").count() == 0
    assert alignment.align_blocks(frames, own, "k", "o", "s").count() == 0


def test_folds_get_a_keys_rows_in_order_over_many_batches(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), (F.hash("id") % 1_000_000).cast("long").alias("o"), "id")

    def check(key, batches):
        import pyarrow as pa

        n, last, parts = 0, None, 0
        for batch in batches:
            for o in batch.column("o").to_pylist():
                assert last is None or o >= last
                last = o
            n, parts = n + batch.num_rows, parts + 1
        yield pa.RecordBatch.from_pydict({"k": [key], "n": [n], "parts": [parts]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = sorted(map(tuple, ordered.fold_groups(rows, "k", ["o"], check, "k long, n long, parts long").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(k, n) for k, n, _ in got] == [(0, 10_000), (1, 10_000), (2, 10_000)] and min(p for *_, p in got) >= 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=6), st.integers(0, 99))
def test_endpoints_of_any_split(cuts, seed):
    rng = np.random.default_rng(seed)
    silence = np.repeat(rng.random(60), rng.integers(1, 60, 60)).astype(np.float32)
    detector, at, out = endpoints.Endpoints(5000), 0, []
    for stop in [*sorted(c * len(silence) // 40 for c in cuts), len(silence)]:
        out += detector.push(silence[at:stop])
        at = stop
    assert out + detector.finish() == endpoints.segments(silence, 5000)


@pytest.mark.parametrize("files", [1, 5])
def test_online_features_in_a_streaming_query(spark, tmp_path, files):
    rng = np.random.default_rng(3)
    waves = {k: rng.normal(0, 0.1, n).astype(np.float32) for k, n in {"a": 9000, "b": 500, "c": 399, "d": 2345}.items()}
    pushes = []
    for key, wave in waves.items():
        cuts = sorted(rng.integers(0, len(wave), 9).tolist())
        parts = np.split(wave, cuts)
        pushes += [{"k": key, "o": n, "s": part.tolist(), "last": n == len(parts) - 1} for n, part in enumerate(parts)]
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "k string, o long, s array<float>, last boolean"
    query = frontend.features_of_stream(spark.readStream.schema(schema).json(str(folder)), "k", "o", "s", "last").writeStream.format("memory").queryName(f"features{files}").outputMode("append").start()
    try:
        for n in range(files):
            (tmp_path / "one.json").write_text("\n".join(json.dumps(p) for p in pushes if p["o"] * files // 10 == n))
            shutil.copy(tmp_path / "one.json", folder / f"{n}.json")
            query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(((r.k, r.frame_idx, r.vec) for r in spark.table(f"features{files}").collect()), key=lambda r: r[:2])
    want = []
    for key, wave in waves.items():
        online = frontend.OnlineFeatures()
        want += [(key, i, np.array(v, np.float32).tolist()) for i, v in enumerate(online.push(wave, True))]
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) > 10
    assert all(np.allclose(a[2], b[2], atol=1e-5) for a, b in zip(got, want, strict=True))
    batch = frontend.stream_features(spark.read.schema(schema).json(str(folder)), "k", "o", "s").collect()
    assert sorted((r.k, r.frame_idx) for r in batch) == [r[:2] for r in want]
    assert all(np.allclose(r.vec, {w[:2]: w[2] for w in want}[r.k, r.frame_idx], atol=1e-5) for r in batch)


WORDS = [("ab", 5), ("abc", 2), ("c", 9), ("bc", 2), ("ab", 1), (None, 3), ("", 3), ("d", None), ("dd", 0), ("cd", 4), ("é🙂", 3)]


def brute_words(text, words):
    """All ways to cut a text; of equal ones, the longest first word, then the longest second."""
    total = sum(words.values()) or 1
    best = None
    for marks in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), len(text)] if text else [0]
        parts = [text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        if any(len(p) > 1 and p not in words for p in parts):
            continue
        score = 0.0
        for p in reversed(parts):
            score = math.log(words.get(p, 1) / total) + score
        rank = (score, [len(p) for p in parts])
        best = max(best, (rank, parts)) if best else (rank, parts)
    return best[1]


@pytest.mark.parametrize("broadcast_bytes", [0, 10**6])
def test_dictionary_words_equal_brute_force(spark, broadcast_bytes):
    rng = np.random.default_rng(5)
    texts = [None, "", "abcd", "é🙂é", "ddd", *("".join(rng.choice(list("abcdé"), rng.integers(1, 11))) for _ in range(120))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    dictionary = spark.createDataFrame(WORDS, "word string, frequency long")
    clean = {"ab": 5, "abc": 2, "c": 9, "bc": 2, "cd": 4, "é🙂": 3}
    got = {r.id: r.words for r in segmenter.segment(rows, "t", dictionary, broadcast_bytes=broadcast_bytes).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else brute_words(t, clean))
    empty = segmenter.segment(rows, "t", dictionary.where("false"), broadcast_bytes=broadcast_bytes).where("id = 2").first()
    assert empty.words == list("abcd")


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    (tmp_path / "model").write_text("3")
    log = tmp_path / "loads"
    log.mkdir()

    def load(path):
        import os
        import uuid

        (log / f"{os.getpid()}-{uuid.uuid4().hex}").write_text("")
        factor = float(open(path).read())
        return lambda x: x * factor

    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 != 0, F.array(F.col("id").cast("float"), F.lit(1.0).cast("float"))).alias("v")).repartition(16)
    got = alignment.file_scores(rows, str(tmp_path / "model"), load, "v", size=64).collect()
    assert len(got) == 4000 and all(r.scores == (None if r.id % 10 == 0 else [3.0 * r.id, 3.0]) for r in got)
    pids = [p.name.split("-")[0] for p in log.iterdir()]
    assert len(pids) == len(set(pids)) <= 8
