import io
import itertools
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.functions import arrays as A
from tessitura.functions import audio
from tessitura.operators import alignment, latency, scoring, segmentation, sequences
from tessitura.streaming import endpoints


def one(spark, column, value, schema):
    return spark.createDataFrame([(value,)], f"x {schema}").select(column).first()[0]


@pytest.mark.parametrize("ids,blank,want", [([3, 3, 3, 4, 4, 5], 0, [3, 4, 5]), ([0, 3, 0, 0, 4, 0], 0, [3, 4]), ([2, 2, 0, 2, 2], 0, [2, 2]), ([], 0, []), ([0] * 4, 0, []), ([0, 5, 5, 1], 5, [0, 1])])
def test_greedy(spark, ids, blank, want):
    assert one(spark, A.ctc_greedy(F.col("x"), blank), ids, "array<int>") == want


def test_argmax_first_wins_and_ban(spark):
    assert one(spark, A.argmax(F.col("x")), [1.0, 3.0, 3.0], "array<double>") == 1
    assert one(spark, A.argmax(A.ban(F.col("x"), 1)), [1.0, 3.0, 2.0], "array<double>") == 2


@pytest.mark.parametrize("t,m,n", [(1, 7, 6), (5, 7, 6), (13, 7, 6), (20, 5, 1), (12, 3, 4)])
def test_stacking_offline_and_online(spark, t, m, n):
    rows = [[float(i), float(-i)] for i in range(t)]
    padded = [rows[0]] * ((m - 1) // 2) + rows
    want = [[x for j in range(m) for x in padded[min(i * n + j, len(padded) - 1)]] for i in range(-(-t // n))]
    assert one(spark, A.stack_frames(F.col("x"), m, n), rows, "array<array<double>>") == want
    if n > m:
        with pytest.raises(ValueError):
            endpoints.stack_online([], rows, m, n, True, True)
        return
    for cut in range(1, t):
        a, carried = endpoints.stack_online([], rows[:cut], m, n, True, False)
        b, _ = endpoints.stack_online(carried, rows[cut:], m, n, False, True)
        assert a + b == want


def test_softmax_layer_norm(spark):
    x = [0.5, -1.0, 2.0]
    e = np.exp(np.array(x) - 2)
    assert np.allclose(one(spark, A.softmax(F.col("x")), x, "array<double>"), e / e.sum())
    assert np.allclose(one(spark, A.log_softmax(F.col("x")), x, "array<double>"), np.log(e / e.sum()))
    assert np.allclose(one(spark, A.layer_norm(F.col("x")), x, "array<double>"), (np.array(x) - np.mean(x)) / np.sqrt(np.var(x) + 1e-5))


def test_chunks_newest_pad(spark):
    assert one(spark, A.chunks(F.col("x"), 2), [1, 2, 3], "array<int>") == [[1, 2], [3]]
    assert one(spark, A.chunks(F.col("x"), 2), [], "array<int>") == [[]]
    assert one(spark, A.newest(F.col("x"), 2), [1, 2, 3], "array<int>") == [2, 3]
    assert one(spark, A.pad(F.col("x"), F.lit(3)), [1.0], "array<double>") == [1.0, 0.0, 0.0]


def test_sample_index_rounds_half_even(spark):
    got = one(spark, F.array(A.sample_index(F.col("x"), F.lit(10**6)), A.sample_index_truncated(F.col("x"))), 0.15625, "double")
    assert got == [2, 2]
    assert one(spark, A.sample_index(F.col("x"), F.lit(100)), 9999.0, "double") == 100


def test_frame_count(spark):
    assert [one(spark, A.frame_count(F.col("x")), n, "int") for n in (0, 399, 400, 559, 560)] == [0, 0, 1, 1, 2]


def test_pcm(spark):
    rows = [(np.array([0, 16384, -32768, 32767], "<i2").tobytes(), "int16"), (b"abc", "float32"), (b"a", "int16"), (b"", "int16"), (b"abcd", "float64"), (None, "int16")]
    got = [r[0] for r in spark.createDataFrame(rows, "p binary, f string").select(audio.decode_pcm("p", "f")).collect()]
    assert got[0] == pytest.approx([0, 0.5, -1, 32767 / 32768]) and got[1:] == [None, None, [], None, None]


def test_wav_and_fbank(spark):
    t = np.arange(8000) / 8000
    x = (np.sin(2 * np.pi * 440 * t) * 20000).astype("<i2")
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(8000), f.writeframes(np.repeat(x, 2).tobytes())
    got = spark.createDataFrame([(raw.getvalue(),), (b"no wav",), (None,)], "c binary").select(audio.load_wav("c").alias("s")).collect()
    assert len(got[0].s) == 16000 and got[1].s is None and got[2].s is None
    assert np.allclose(got[0].s[1000:15000], np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[1000:15000] * 20000 / 32768, atol=0.01)
    frames = spark.createDataFrame([(got[0].s,), ([0.0] * 10,)], "x array<float>").select(audio.fbank("x").alias("f")).collect()
    assert len(frames[0].f) == 98 and len(frames[0].f[0]) == 80 and frames[1].f == []
    centre = 1127 * np.log(1 + 440 / 700)
    low, high = 1127 * np.log(1 + 20 / 700), 1127 * np.log(1 + 8000 / 700)
    assert abs(int(np.argmax(frames[0].f[50])) - ((centre - low) / ((high - low) / 81) - 1)) <= 1


def test_alignment_against_all_paths():
    rng = np.random.default_rng(1)
    for targets in ([1], [1, 1], [2, 1], [1, 2, 1], []):
        logp = np.log(rng.dirichlet(np.ones(3), size=5))
        best = max(
            (p for p in itertools.product(range(3), repeat=5) if [k for i, k in enumerate(p) if k and (i == 0 or p[i - 1] != k)] == targets),
            key=lambda p: sum(logp[t, k] for t, k in enumerate(p)),
        )
        assert tuple(alignment.align(logp, targets)) == best


def test_model_is_a_function(spark):
    f = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k int, v array<float>")
    assert [r.scores for r in alignment.model_scores(f, lambda x: x * 2, "v").orderBy("k").collect()] == [[2.0, 4.0], [6.0, 8.0]]


def test_rates_and_joins(spark):
    refs = spark.createDataFrame([("a", "滨海新区"), ("b", "x"), ("c", "")], "key string, ref string")
    hyps = spark.createDataFrame([("a", "冰海心区"), ("c", "yy"), ("z", "q")], "key string, hyp string")
    scored = scoring.score_pairs(refs, hyps, ["key"])
    got = scoring.micro_rate(scored).first()
    assert (got.n_files, got.edits, got.ref_chars, got.micro_cer) == (2, 4, 4, 100.0)
    times = spark.createDataFrame([("a", 2.0)], "key string, seconds double")
    got = scoring.real_time(scored.withColumn("duration", F.lit(8.0)), times, ["key"]).first()
    assert (got.n_timed, got.rtf, got.speed_up) == (1, 0.25, 4.0)
    assert scoring.real_time(scored.withColumn("duration", F.lit(8.0)), times.withColumn("seconds", F.lit(0.0)), ["key"]).first().speed_up is None


def test_percentiles_and_budget(spark):
    s = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "label string, v double")
    assert latency.summarise(s, "label", "v").first().p95_ms == 3.85
    m = spark.createDataFrame([("a", 10, 100.0, 250.0), ("a", 20, 200.0, 250.0), ("a", 30, 300.0, 250.0), ("b", 10, 100.0, 50.0), ("c", 10, 1.0, 5.0)], "label string, frames int, p95_ms double, budget double")
    got = {r.label: (r.max_measured_frames, r.interpolated_frames) for r in latency.recommend(m, "budget").collect()}
    assert got == {"a": (20, 25), "b": (None, None), "c": (10, None)}


def test_slice_chunks_is_the_range_join(spark):
    rng = np.random.default_rng(3)
    chunks = [(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 3, 60), rng.integers(0, 500, 60), rng.integers(0, 90, 60), strict=True)]
    segments = [(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 3, 40), rng.integers(0, 500, 40), rng.integers(0, 200, 40), strict=True)]
    got = segmentation.slice_chunks(spark.createDataFrame(chunks, "k int, lo int, hi int"), spark.createDataFrame(segments, "k int, start int, end int"), "k", 64)
    want = sorted((max(a, c), min(b, d)) for k, a, b in chunks for j, c, d in segments if k == j and a < d and b > c and b > a and d > c)
    assert sorted((r["from"], r["to"]) for r in got.collect()) == want


@given(st.lists(st.sampled_from([0.0, 0.1, 0.9, 1.0]), max_size=400))
@settings(max_examples=40, deadline=None)
def test_endpoints_are_apart_and_inside(silence):
    found = endpoints.segments(np.repeat(np.array(silence, np.float32), 5))
    assert all(0 <= a < b <= len(silence) * 50 for a, b in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


def test_endpoints_of_one_utterance():
    silence = np.array([1.0] * 100 + [0.0] * 200 + [1.0] * 400, np.float32)
    assert endpoints.segments(silence) == [(740, 3150)]  # 40 frames before the 15th loud one; 11 after speech has faded


def test_online_features_are_the_whole_ones(spark):
    from tessitura.streaming.frontend import OnlineFeatures, stream_features

    x = (np.random.default_rng(0).normal(size=9000) * 0.1).astype(np.float32)
    frames = audio.log_mel(x)
    padded = [frames[0]] * 3 + list(frames)
    want = np.array([np.concatenate([padded[min(i * 6 + j, len(padded) - 1)] for j in range(7)]) for i in range(-(-len(frames) // 6))])
    for cuts in ([], [100], [399, 400, 401, 5000], list(range(500, 9000, 500))):
        online, got = OnlineFeatures(), []
        parts = np.split(x, cuts)
        for k, part in enumerate(parts):
            got += online.push(part, k == len(parts) - 1)
        assert np.allclose(got, want, atol=1e-4)
    assert OnlineFeatures().push(x[:100], True) == []
    df = spark.createDataFrame([("a", 1, x[4000:].tolist()), ("a", 0, x[:4000].tolist()), ("b", 0, [0.0] * 10), ("b", 1, None)], "k string, o int, s array<float>")
    rows = stream_features(df, "k", "o", "s").orderBy("frame_idx").collect()
    assert {r.k for r in rows} == {"a"} and np.allclose([r.vec for r in rows], want, atol=1e-3)


def test_lookups(spark):
    from tessitura.functions import lookups

    v = ["a", "b", "<unk>"]
    assert one(spark, lookups.token_ids(F.col("x"), v), ["b", "z", "a"], "array<string>") == [1, 2, 0]
    assert one(spark, lookups.tokens_of(F.col("x"), v), [1, 7, -1, 0], "array<int>") == ["b", "a"]
    ids = {"withitn": 14, "woitn": 15}
    df = spark.createDataFrame([("woitn", True), (None, True), (None, False)], "e string, u boolean")
    assert [r[0] for r in df.select(lookups.choose_text_norm(F.col("e"), F.col("u"), ids)).collect()] == [15, 14, 15]
    with pytest.raises(Exception, match="unknown text norm"):
        df.select(lookups.choose_text_norm(F.lit("x"), F.col("u"), ids)).collect()
    lookups.register(spark)
    assert spark.sql("select json_command('{\"type\": \"EOF\"}')").first()[0] == "eof"


@pytest.mark.parametrize("width", [3, 50, 65_536])
def test_ranges_give_what_whole_windows_give(spark, monkeypatch, width):
    from pyspark.sql import Window

    from tessitura.operators import ordered

    monkeypatch.setattr(ordered, "RANGE", width)
    rng = np.random.default_rng(width)
    rows = [(int(k), int(o), None if rng.random() < 0.3 else int(rng.integers(5))) for k, o in {(int(a), int(b)) for a, b in zip(rng.integers(0, 3, 200), rng.integers(-100, 200, 200), strict=True)}]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    w = Window.partitionBy("k").orderBy("o")
    up, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "o", F.row_number().over(w) - 1, F.coalesce(F.sum("v").over(up), F.lit(0)), F.max("v").over(before), F.lag(F.struct("v")).over(w)["v"], F.last("v", True).over(up))
    got = ordered.number(df, "k", "o", "n")
    for f, name in ((ordered.running_sum, "s"), (ordered.running_max, "m"), (ordered.previous, "p"), (ordered.latest, "l")):
        got = f(got, "k", "o", "v", name)
    assert sorted(map(tuple, got.select("k", "o", "n", "s", "m", "p.value", "l").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("width", [3, 50, 65_536])
def test_neighbours_in_ranges_are_those_of_whole_windows(spark, monkeypatch, width):
    from tessitura.operators import ordered

    monkeypatch.setattr(ordered, "RANGE", width)
    values = {k: np.random.default_rng(k).normal(size=n) for k, n in ((1, 1), (2, 40), (3, 7))}
    df = spark.createDataFrame([(k, f, float(x)) for k, v in values.items() for f, x in enumerate(v)], "k int, f long, x double")
    taps = [0.1, 0.2, -0.3, 0.25, 0.05]
    got = sequences.sliding_sum(sequences.memory_filter(df, "k", "f", "x", taps, 1, "y"), "k", "f", "x", 6, "s").collect()
    assert len(got) == 48
    for r in got:
        v = values[r.k]
        near = [v[r.f - 1 + i] if 0 <= r.f - 1 + i < len(v) else 0.0 for i in range(5)]
        assert r.y == pytest.approx(v[r.f] + np.dot(taps, near)) and r.s == pytest.approx(v[max(0, r.f - 5) : r.f + 1].sum())


@pytest.mark.parametrize("m,n", [(7, 6), (5, 1), (3, 4), (9, 2), (1, 1)])
def test_stacked_rows_are_the_stacked_array(spark, m, n):
    rows = [(k, f, [float(f), -float(f)]) for k, t in ((1, 1), (2, 5), (3, 13), (4, 20)) for f in range(t)]
    df = spark.createDataFrame(rows, "k int, f long, v array<double>")
    got = {(r.k, r.f): r.stacked for r in sequences.stack_rows(df, "k", "f", "v", m, n).collect()}
    whole = df.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias("v"))
    want = {(r.k, i): x for r in whole.select("k", A.stack_frames(F.col("v"), m, n).alias("s")).collect() for i, x in enumerate(r.s)}
    assert got == want


def test_segments_with_equal_starts_are_ordered_by_ties(spark):
    df = spark.createDataFrame([(1, 5, 9, 2), (1, 5, 9, 1), (1, 5, 7, 3), (1, 0, 6, 4), (1, 8, 50_000_000, 5), (1, 9, 12, 2_000_000)], "k int, start long, end long, id long")
    kept = segmentation.keep_apart(df.withColumn("total", F.lit(60_000_000)), "k", ["end", "id"], "total").select("id", "start", "end").collect()
    assert sorted(map(tuple, kept)) == [(1, 7, 9), (3, 6, 7), (4, 0, 6), (5, 9, 50_000_000)]


def test_language_runs_of_arrays_are_those_of_rows_and_shuffle_no_text(spark):
    texts = [(1, "a b 你 好 c"), (2, ""), (3, None), (4, "x"), (5, "1  2 '"), (6, "a 1"), (6, "a 1"), (6, "b"), (None, "q 9"), (None, "w w w"), (7, "9 " * 500 + "end")]
    rows = spark.createDataFrame(texts, "k int, t string").select("k", F.split("t", " ").alias("words"))
    want = sequences.language_runs(rows.select("k", F.posexplode("words").alias("i", "w")), "k", "i", "w")
    show = lambda df: sorted(((r.k, r.run, r.english, sorted(r.tokens)) for r in df.collect()), key=str)
    alone = lambda df: df.where("k <> 6 and k is not null")
    got = sequences.language_runs_of_arrays(rows, "k", "words")
    assert show(alone(got)) == show(alone(want)) and len(show(got)) > 12
    twice = rows.where("k = 6 and size(words) = 2")
    by_row = sequences.language_runs(twice.select("k", F.posexplode("words").alias("i", "w")), "k", "i", "w")
    assert show(sequences.language_runs_of_arrays(twice, "k", "words")) == show(by_row) == [(6, 1, True, ["a", "a"]), (6, 2, False, ["1", "1"])]
    plan = sequences.language_runs_of_arrays(rows.where("k < 6"), "k", "words")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
