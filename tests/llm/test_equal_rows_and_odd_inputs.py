"""Many equal rows, benchmarks of several automata, pages without known names, and tokens that are no secrets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import decontamination, html_extraction, packing, quality, secret_scan
from tessitura.llm.common import held_out

from test_cases import vocabulary

LINE = "The river was long and the stones lay in the water for many years, as people of the city said in the morning. "
PROSE = f"<p>{LINE * 3}</p>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<form action=x><article><h1>A title here</h1>{PROSE * 4}</article></form>", 5),
        (f"<body><form id=aspnet><div>{PROSE * 4}</div></form></body>", 4),
        (f"<section class=blog>{PROSE * 4}</section>", 4),
        (f"<nav><a href=x>Home</a><a href=y>About</a></nav><section class=zzwrap><h1>My title</h1>{PROSE * 4}</section><footer>All rights reserved.</footer>", 5),
        ("<article><p>short text here</p></article>", 1),
        ("<article><h1>My heading</h1><p>short text here</p></article>", 2),
        (f"<div>{PROSE}</div>", 1),
        ("<nav><a href=x>Home</a></nav><footer>All rights reserved.</footer>", 0),
        (f"<article><h1>One</h1>{PROSE}</article><form><label>Name</label><p>Sign in here please</p></form>", 2),
        ("", 0),
    ],
)
def test_pages_of_unknown_names_and_forms(page, want):
    text = html_extraction.main_text(page, html_extraction.trained_field())
    assert len(text.split("\n")) == want if want else text == ""
    assert "Home" not in text and "rights" not in text and "Sign in" not in text


def test_quality_learns_from_a_bounded_number_of_rows(spark):
    ids = [r.id for r in spark.range(100).where(~held_out(F.col("id"))).collect()]
    docs = spark.createDataFrame([(ids[0], "the same text over and over again")] * 3000 + [(ids[0], f"text number {k} of one id") for k in range(300)] + [(i, f"another text of {i}, which is longer.") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    rows = quality.fit_statistics(docs, labels, fit_rows=20).collect()
    assert 0 < len(rows) <= 20
    whole = quality.fit_statistics(docs, labels, fit_rows=5000).collect()
    assert len(whole) == len(ids) + 301  # each different text of an id once
    few = spark.createDataFrame([(i, "x") for i in ids[:3]] * 50, "doc_id long, text string")
    assert quality.fit_statistics(few, labels).count() == 3


def test_quality_margin_is_the_difference_of_log_densities():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (80, 4)), rng.normal(1, 2, (60, 4))])
    y = np.array([0] * 80 + [1] * 60)
    model = quality.Model(x, y)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    centred = np.concatenate([z[y == c] - z[y == c].mean(0) for c in (0, 1)])
    pooled, plain = centred.T @ centred / len(z), []
    for c in (0, 1):
        own = z[y == c]
        lean = max(quality.SHRINK_POOLED, 4 / (4 + len(own)))
        cov = (1 - lean) * np.cov(own.T, bias=True) + lean * pooled
        cov = (1 - quality.SHRINK_DIAGONAL) * cov + quality.SHRINK_DIAGONAL * np.eye(4)
        off = z - own.mean(0)
        density = -0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) - 0.5 * np.log(np.linalg.det(2 * np.pi * cov))
        plain.append(density + np.log(len(own) / len(z)))
    assert np.allclose(model.margin(x), plain[1] - plain[0])


def test_packing_of_equal_rows_is_dealt_over_groups(spark):
    docs = spark.createDataFrame([(7, "one two three")] * 2000 + [(None, "one two three")] * 1000 + [(8, "w " * 900)], "doc_id long, text string").repartition(4)
    got = packing.pack(docs, vocabulary(), capacity=1000).collect()
    assert len(got) == 3001
    filled = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1000
    cut = packing.pieces(docs, vocabulary(), "doc_id", "text", 1000, False).withColumn("row", F.monotonically_increasing_id())
    groups = cut.groupBy("length", F.pmod(F.xxhash64("row"), F.lit(16))).count().agg(F.max("count")).first()[0]
    assert groups < 3000 / 16 * 2


def test_several_automata_over_a_run_of_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words, 14))) for k in range(40)]
    docs = [(k, " ".join(rng.choice(words, 60)) + " " + (items[k % 40][1] if k % 3 == 0 else "")) for k in range(120)]
    built = []
    plain = decontamination.Part.__init__
    monkeypatch.setattr(decontamination.Part, "__init__", lambda self, *a: built.append(1) or plain(self, *a))
    benchmark = decontamination.prepare([(str(i), t) for i, t in items], automaton_words=200)
    assert len(benchmark.parts) >= 3
    import pyarrow as pa

    slices = [pa.record_batch({"text": [t for _, t in docs[k : k + 10]]}) for k in range(0, 120, 10)]
    runs = list(benchmark.runs(iter(slices)))
    assert len(runs) == 1  # less than RUN_BYTES
    found = list(benchmark.scan_run([x.column("text") for x in runs[0]]))
    assert len(built) == len(benchmark.parts)
    whole = decontamination.prepare([(str(i), t) for i, t in items])
    for part, got in zip(slices, found, strict=True):
        want = whole.scan(part.column("text"))
        assert all(np.array_equal(a, b) for a, b in zip(got[:3], want[:3], strict=True))
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), automaton_words=200).collect()
    assert sorted(map(tuple, got)) == sorted(decontamination.brute_force(docs, items))


@pytest.mark.parametrize(
    "token",
    [*(c * 24 for c in "xAZ0_"), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "zyxwvutsrqponmlkjihgf", "01234567890123456789", "2024-11-28T04-48-57-000001", "123e4567-e89b-12d3-a456-426614174000",
     "Llanfairpwllgwyngyllgogerych", "Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch", "abcabcabcabcabcabcabcabc", "AAAABBBBCCCCDDDDEEEE"],
)
def test_tokens_that_are_no_secrets(token):
    assert secret_scan.find_spans(f"see {token} now")[1] == []


def test_random_strings_still_are():
    rng = np.random.default_rng(5)
    small = "abcdefghijklmnopqrstuvwxyz"
    for signs in (small + small.upper() + "0123456789", small + small.upper() + "0123456789+/", small.upper() + "234567"):
        caught = [bool(sum(secret_scan.find_spans("a " + "".join(rng.choice(list(signs), 20)) + " b"), [])) for _ in range(1000)]
        assert np.mean(caught) >= 0.99


@pytest.mark.parametrize("most_hot", [3])
def test_hot_n_grams_change_the_way_and_not_the_rows(spark, monkeypatch, most_hot):
    from tessitura.llm import jaccard_join

    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words, 12))
    base = [" ".join(rng.choice(words, 60)) + " " + passage for _ in range(900)]
    rows = [(k, base[k % 900] if k < 1500 else base[k % 900].replace("w7 ", "w8 ", 1) + " end") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    monkeypatch.setattr(jaccard_join, "HOT", 200)
    monkeypatch.setattr(jaccard_join, "HOT_SAMPLE", 2)
    monkeypatch.setattr(jaccard_join, "MOST_HOT", most_hot)
    assert 0 < len(jaccard_join.hot_grams(docs, 2000, 5)) <= most_hot
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == plain
    assert len({c for *_, c in plain}) == 900
