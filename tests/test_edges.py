"""Containers, ranged files, Unicode widths, banded distances, nulls in ordered ranges, references with odd values, empty arrays."""

import json
import math
import struct
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.functions import arrays as A
from tessitura.functions import audio, lookups
from tessitura.functions import text as T
from tessitura.operators import ordered, scoring, sequences
from tessitura.sources import features
from tessitura.sources import manifests as M

# --- WAVE


def chunk(name, data, size=None):
    return name + struct.pack("<I", len(data) if size is None else size) + data + b"\0" * (len(data) % 2)


def riff(*chunks, name=b"RIFF"):
    body = b"WAVE" + b"".join(chunks)
    return name + struct.pack("<I", len(body)) + body


def fmt(kind, channels, rate, bits, sub=None):
    head = struct.pack("<HHIIHH", 0xFFFE if sub else kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return chunk(b"fmt ", head + (struct.pack("<HHIH", 22, bits, 3, sub) + b"\0" * 14 if sub else b""))


X = np.array([[0.5, -0.25], [-1.0, 0.75], [0.125, 0.0]])


def data_of(kind, bits):
    if kind == 3:
        return X.astype(f"<f{bits // 8}").tobytes()
    if bits == 8:
        return (X * 128 + 128).astype("u1").tobytes()
    whole = np.clip(X * 2.0 ** (bits - 1), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype("<i4")
    return b"".join(struct.pack("<i", v)[: bits // 8] for v in whole.ravel().tolist())


@pytest.mark.parametrize("kind,bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
@pytest.mark.parametrize("extensible", [False, True])
def test_wave_forms(kind, bits, extensible):
    form = fmt(kind, 2, 16_000, bits, kind if extensible else None)
    data = data_of(kind, bits)
    plain = audio.wave_samples(riff(form, chunk(b"data", data)))
    assert plain[1] == 16_000 and np.abs(plain[0] - X).max() < 1e-9
    # chunks in any order, others between them (of odd sizes), unknown and cut lengths
    for raw in (
        riff(chunk(b"LIST", b"abc"), chunk(b"data", data), chunk(b"fact", b"\0" * 5), form),
        riff(form, chunk(b"data", data, 0xFFFFFFFF)),
        riff(form, chunk(b"data", data, len(data) + 1000)),
        riff(form, chunk(b"data", data[:-1] + b"", 0xFFFFFFFF), name=b"RF64")[: 12 + len(form) + 8 + len(data) - 1],
    ):
        found, _ = audio.wave_samples(raw)
        assert np.abs(found - X[: len(found)]).max() < 1e-9 and len(found) >= 2
    assert np.abs(audio.wave_samples(riff(form, b"data" + struct.pack("<I", 0) + data))[0] - X).max() < 1e-9


def test_logarithmic_forms():
    codes = np.arange(256, dtype="u1")
    mu, a = audio.mu_law(codes) * 32768, audio.a_law(codes) * 32768
    # the tables' ends and smallest steps
    assert (mu[0x00], mu[0x80], mu[0x7F], mu[0xFF], mu[0x0F], mu[0x70]) == (-32124, 32124, 0, 0, -16764, -120)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA], a[0x54]) == (-8, 8, -32256, 32256, -24)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256 and (np.sort(-a) == np.sort(a)).all()
    for kind, f in ((7, audio.mu_law), (6, audio.a_law)):
        found, rate = audio.wave_samples(riff(fmt(kind, 1, 8000, 8), chunk(b"data", codes.tobytes())))
        assert rate == 8000 and np.array_equal(found[:, 0], f(codes))


@pytest.mark.parametrize("raw", [None, b"", b"RIFF", riff(), riff(fmt(1, 1, 16_000, 16)), riff(chunk(b"data", b"12")), riff(fmt(1, 0, 16_000, 16), chunk(b"data", b"12")), riff(fmt(2, 1, 16_000, 4), chunk(b"data", b"12")), riff(fmt(1, 1, 0, 16), chunk(b"data", b"12")), b"OggS" + b"\0" * 60])
def test_other_files_are_null(raw):
    assert audio.wave_samples(raw) is None


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_no_bytes_crash_the_walker(data):
    for raw in (data, riff(data), riff(fmt(1, 1, 8000, 16), data), riff(fmt(0, 1, 1, 8, 0xABC), chunk(b"data", data))):
        audio.wave_samples(raw)


def test_files_and_arrays_as_samples(spark, tmp_path):
    tone = np.sin(np.arange(8000) / 10)
    (tmp_path / "a.wav").write_bytes(audio.encode_wave(tone, 8000, bits=24))
    (tmp_path / "b.wav").write_bytes(b"no wave")
    files = {r.key: r.samples for r in M.read_wavs(spark, f"{tmp_path}/*.wav").collect()}
    assert files["b"] is None and len(files["a"]) == 16_000
    rows = spark.createDataFrame([(1, tone.tolist(), 8000), (2, None, 8000), (3, [1.0], None), (4, [0.5, 0.25], 16_000), (5, [], 8000), (6, [1.0], 0)], "id int, x array<double>, rate int")
    got = {r.id: r.samples for r in M.audio_of_arrays(rows, "x", "rate").collect()}
    assert np.abs(np.array(got[1]) - np.array(files["a"])).max() < 1e-5
    assert got[2] is None and got[3] is None and got[4] == [0.5, 0.25] and got[5] == [] and got[6] is None


# --- feature files


def test_feature_files_in_ranges(spark, tmp_path):
    x = np.arange(50 * 3, dtype="<f4").reshape(50, 3)
    (tmp_path / "whole.bin").write_bytes(np.array([50, 3], "<i4").tobytes() + x.tobytes())
    (tmp_path / "none.bin").write_bytes(np.array([0, 3], "<i4").tobytes())
    (tmp_path / "short.bin").write_bytes(np.array([50, 3], "<i4").tobytes() + x.tobytes()[:-1])
    (tmp_path / "odd.bin").write_bytes(b"odd")
    (tmp_path / "minus.bin").write_bytes(np.array([-1, 3], "<i4").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = M.read_feature_files(spark, str(tmp_path), range_bytes=37)
    assert rows.rdd.getNumPartitions() > 30
    got = rows.collect()
    assert sorted((r.key, r.frame_idx, r.vec) for r in got if r.error is None) == [("whole", k, x[k].tolist()) for k in range(50)]
    assert {r.key: r.error for r in got if r.error} == {"short": "607 bytes, not 608", "odd": "no header", "minus": "negative sizes", "empty": "no header"}


def test_a_file_beyond_two_gigabytes_is_read_in_ranges(tmp_path):
    rows, width = 9_000_000, 64
    path = tmp_path / "large.bin"
    with path.open("wb") as f:  # sparse: it takes no room
        f.write(np.array([rows, width], "<i4").tobytes())
        f.truncate(8 + 4 * rows * width)
        f.seek(8 + 4 * width * (rows - 1))
        f.write(np.arange(width, dtype="<f4").tobytes())
    reader = features.FeatureReader({"path": str(path), "rangebytes": str(1 << 20)})
    parts = reader.partitions()
    assert len(parts) > 2000 and path.stat().st_size > 2 << 30
    last = list(reader.read(parts[-1]))
    assert last[-1][:2] == ("large", rows - 1) and last[-1][2] == list(range(width))
    edge = len(list(reader.read(parts[5])))
    assert edge == math.ceil(6 * (1 << 20) / (4 * width)) - math.ceil(5 * (1 << 20) / (4 * width))


def test_small_feature_files_share_partitions(tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"{k:03d}.bin").write_bytes(np.array([1, 2], "<i4").tobytes() + np.array([k, -k], "<f4").tobytes())
    x = np.arange(3000, dtype="<f4").reshape(1000, 3)
    (tmp_path / "long.bin").write_bytes(np.array([1000, 3], "<i4").tobytes() + x.tobytes())
    want = sorted([(f"{k:03d}", 0, [k, -k], None) for k in range(300)] + [("long", k, x[k].tolist(), None) for k in range(1000)])
    monkeypatch.chdir(tmp_path)
    for most, many in ((10_000, 6), (4, 3), (1, 1)):
        monkeypatch.setattr(features, "MOST_PARTITIONS", most)
        for path in (str(tmp_path), f"{tmp_path}/", f"{tmp_path}/*.bin", f"file://{tmp_path}"):
            reader = features.FeatureReader({"path": path, "rangebytes": "4096"})
            parts = reader.partitions()
            assert len(parts) == many and sorted(r for p in parts for r in reader.read(p)) == want
    for path in ("007.bin", f"{tmp_path}/007.bin"):
        one = features.FeatureReader({"path": path})
        assert [r for p in one.partitions() for r in one.read(p)] == [("007", 0, [7, -7], None)]
    (tmp_path / "none").mkdir()
    assert features.FeatureReader({"path": str(tmp_path / "none")}).partitions() == []


# --- text


def test_widths_are_unicodes(spark):
    signs = [chr(c) for c in [*range(0x20, 0x3400), *range(0x4DB0, 0x4E10), *range(0x9FF0, 0xA4D0), *range(0xA950, 0xA990), *range(0xABF0, 0xAC10), *range(0xF8F0, 0xFB00), *range(0xFE00, 0xFFF0), *range(0x16FE0, 0x1B300), *range(0x1F000, 0x20010), *range(0x3FFF0, 0x40010)]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(signs)], "i int, c string").select("c", T.display_width(F.col("c")).alias("w")).collect()
    assert all(r.w == (2 if unicodedata.east_asian_width(r.c) in "WF" else 1) for r in rows)
    assert len(T.wide_ranges()) < 200


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_banded_distances_equal_the_whole_table(spark):
    rng = np.random.default_rng(3)
    pairs = [("", ""), ("", "abc"), ("é🙂", "e🙂"), ("x" * 700, "y" * 700), (None, "a")]
    for edits in (0, 1, 7, 8, 9, 30, 64, 65, 200):
        a = "".join(rng.choice(list("abcdé"), 300))
        b = list(a)
        for _ in range(edits):
            k = int(rng.integers(0, max(1, len(b))))
            b[k : k + int(rng.integers(0, 2))] = rng.choice(list("abcdé"), int(rng.integers(0, 2))).tolist()
        pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("whole")).collect()
    assert all(r.d == r.whole for r in rows)
    assert all(r.d == plain_distance(r.a, r.b) for r in rows if r.a is not None)


def test_error_rates_count_letters_of_all_scripts(spark):
    refs = spark.createDataFrame([(1, "<|de|>Straße, schön!"), (2, "你好，世界")], "k int, ref string")
    hyps = spark.createDataFrame([(1, "strasse schon"), (2, "你好世间")], "k int, hyp string")
    got = {r.k: (r.edits, r.ref_chars) for r in scoring.score_pairs(refs, hyps, ["k"]).collect()}
    assert got == {1: (1, 12), 2: (1, 4)}


def test_query_tokens_and_keys(spark):
    rows = spark.createDataFrame([(0, "zh"), (1, None), (2, "klingon"), (3, "yue"), (7, "auto")], "n long, lang string")
    got = rows.select("n", lookups.language_id(F.col("lang")).alias("id"), lookups.tiled_key(F.col("n"), ["a", "b", "c"]).alias("key"), lookups.tiled_key(F.col("n"), []).alias("none"), lookups.default_key(F.lit(None).cast("string"), F.col("lang")).alias("d")).orderBy("n").collect()
    assert [(r.id, r.key, r.none, r.d) for r in got] == [(3, "a", None, "zh"), (0, "b", None, None), (0, "c", None, "klingon"), (7, "a", None, "yue"), (0, "b", None, "auto")]


# --- nulls and empty arrays


def test_numbers_of_null_keys_and_null_orders(spark):
    rows = [(None, 5), (None, 9), ("a", None), ("a", 3), ("a", 70_000), ("a", 140_000), (None, 200_000)]
    got = ordered.number(spark.createDataFrame(rows, "k string, o long"), "k", "o", "n").collect()
    assert sorted((str(r.k), r.n, str(r.o)) for r in got) == [("None", 0, "5"), ("None", 1, "9"), ("None", 2, "200000"), ("a", 0, "None"), ("a", 1, "3"), ("a", 2, "70000"), ("a", 3, "140000")]
    runs = sequences.runs(spark.createDataFrame([(None, 1, 7), (None, 2, 7), (None, 3, 8), ("a", 1, 8)], "k string, o long, v int"), "k", "o", "v").collect()
    assert sorted((str(r.k), r.value, r.length) for r in runs) == [("None", 7, 2), ("None", 8, 1), ("a", 8, 1)]
    batches = sequences.batches(spark.createDataFrame([(None, i) for i in range(5)], "k string, o long"), "k", "o", 2).collect()
    assert sorted(r.batch for r in batches) == [0, 0, 1, 1, 2]


def test_ties_are_numbered_by_the_named_columns(spark):
    rows = spark.createDataFrame([("a", 1, 9), ("a", 1, 3), ("a", 0, 5), ("a", 1, 4)], "k string, o long, t int")
    assert [r.t for r in ordered.number(rows, "k", "o", "n", ["t"]).orderBy("n").collect()] == [5, 3, 4, 9]


def test_constant_dimensions_and_single_frames(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 4.0]), ("b", [7.0, 7.0])], "k string, v array<double>")
    made = rows.join(sequences.moments(rows, "k", "v", 2), "k").select("k", A.cmvn(F.col("v"), F.col("shift"), F.col("scale")).alias("c")).collect()
    assert sorted((r.k, r.c) for r in made) == [("a", [0.0, -1.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0])]


def test_kernels_of_empty_arrays(spark):
    row = spark.createDataFrame([([],)], "v array<double>").select(A.layer_norm(F.col("v")).alias("n"), A.preemphasis(F.col("v")).alias("p"), A.position_encoding(F.lit(1.0), 2).alias("e")).first()
    assert row.n == [] and row.p == [] and row.e == [math.sin(1.0), math.cos(1.0)]


def test_references_with_odd_values(spark, tmp_path):
    items = [{"id": 12345678901234567890, "ref": "a", "duration": "long"}, {"id": 5, "ref": "b", "duration": "1.5"}, {"id": -5, "ref": "c"}, {"id": 1.0, "key": "k", "ref": "d"}, {"id": None, "key": "m", "ref": "e", "duration": None}, {"id": True, "key": "t", "ref": "f"}]
    (tmp_path / "refs.json").write_text(json.dumps(items))
    assert {(r.key, r.ref, r.duration) for r in M.read_references(spark, str(tmp_path / "refs.json")).collect()} == {("12345678901234567890", "a", 0.0), ("005", "b", 1.5), ("-05", "c", 0.0), ("k", "d", 0.0), ("m", "e", 0.0), ("t", "f", 0.0)}
