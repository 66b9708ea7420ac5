"""Operators 11 to 13 against brute force: odd rows, hot groups, both paths of joins, and parts of long texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.llm import alignment, importance, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (5, "one two"), (5, "one two"), (None, "null id text"), (6, "Ünïcode ééé words. here; now!"), (7, "blank▁sign"), (8, "a\x00b <|endoftext|> <s><0x0A>"), (9, "x" * 900)]


def docs_of(spark, rows):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumn("key", F.lit(1)).withColumn("score", F.lit(2.0)).withColumn("rank", F.lit("x")).withColumn("d1", F.lit(0)).withColumn("group", F.lit("g")).withColumn("text2", F.col("text"))


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def words(seed, n, letters="abcdé"):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 40))) for _ in range(n)]


# --- alignment


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own(files):
    return alignment.Vocabularies(*files)


@pytest.mark.parametrize("broadcast_groups", [0, 10**6])
def test_alignment_equals_brute_force(spark, files, broadcast_groups):
    rows = ODD + list(enumerate(words(1, 60, "abtheingr's,.1 é"), 100)) + [(50, "the same text, again.")] * 40
    got = alignment.align(docs_of(spark, rows), *files, broadcast_groups=broadcast_groups)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(map(str, alignment.brute_force(rows, *files)))


def test_alignment_of_an_empty_table_and_of_zero_rows(spark, files):
    assert alignment.align(docs_of(spark, ODD).where("false"), *files).count() == 0
    got = {tuple(r)[1:] for r in alignment.align(docs_of(spark, [(1, None), (2, ""), (3, "a▁b")]), *files).collect()}
    assert got == {(0, 0, 0, 0, 0, 0, "")}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab  \t\n\r é你🙂\x1c\x85́'sd1.,<|>▁\x00", max_size=60))
def test_cuts_have_the_tokens_of_the_text(own, text):
    (whole,) = own.encode([text])
    parts = list(own.encode(own.cut(text)))
    assert [i for a, _ in parts for i in a] == whole[0] and [i for _, b in parts for i in b] == whole[1]


def test_keys_that_collide_lead_to_another_seed(spark, files, own):
    coder = alignment.GroupCoder(own, 0)
    coder.documents([["some", "words"]])
    assert len(set(coder.keys)) == len(coder.known)
    text = "these are some words, and some more words"
    assert coder.seed == 0 and rows_of(alignment.align(docs_of(spark, [(1, text)]), *files)) == [str(alignment.brute_force([(1, text)], *files)[0])]


def test_a_small_memory_of_cuts_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    coder, totals = alignment.GroupCoder(own, 0), {}
    for text in words(3, 30):
        coder.documents([own.cut(text)])
        if coder.full:
            for g, n in zip(coder.names, coder.count.tolist(), strict=True):
                totals[g] = totals.get(g, 0) + n
            coder.forget()
    for g, n in zip(coder.names, coder.count.tolist(), strict=True):
        totals[g] = totals.get(g, 0) + n
    want = {}
    for text in words(3, 30):
        ((a, b),) = own.encode([text])
        for g in own.groups(text, a, b):
            want[g] = want.get(g, 0) + 1
    assert {g: n for g, n in totals.items() if n} == want


# --- repeated strings


def repeated_texts(seed):
    rng = random.Random(seed)
    passages = words(seed, 12)
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.6 else words(rng.random(), 1)[0] for _ in range(rng.randint(1, 7)))) for i in range(90)]
    return rows + ODD + [(200, "xy" * 200), (201, "x" * 60 + "y"), (202, "line one two\n" * 30), (203, rows[3][1]), (204, rows[3][1]), (205, "z" + rows[5][1] + "q"), (206, "x" * 43)]


@pytest.mark.parametrize("seed,ranges,width,gram", [(1, 1, 40, 20), (2, 7, 40, 16), (4, 5, 33, 33)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, ranges, width, gram):
    monkeypatch.setattr(suffix_dedup, "RANGE", 40)
    rows = repeated_texts(seed)
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), width=width, gram=gram, ranges=ranges)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows_of(got) == sorted(map(str, suffix_dedup.brute_force(rows, width)))


def test_a_passage_of_most_texts_is_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE", 30)
    passage = " ".join(words(9, 3))[:90]
    rows = [(i, f"{own} {passage} {other}") for i, (own, other) in enumerate(zip(words(5, 200), words(6, 200), strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = suffix_dedup._scanned(docs, "doc_id", "text", 40, 20)
    held = docs.join(scanned, docs.doc_id == scanned.own_id).select("d1", "d2", "text", "anchors")
    ordered = suffix_dedup.sort_strings(held, "anchors", suffix_dedup._backwards(20, 40), 20, 100)
    sizes = [r[0] for r in ordered.selectExpr("size(p)").collect()]
    assert len(sizes) > 20 and max(sizes) < 6 * 30
    assert rows_of(suffix_dedup.remove_repeats(docs, width=40, gram=20)) == sorted(map(str, suffix_dedup.brute_force(rows, 40)))


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, ODD).where("false")).count() == 0


def test_a_long_run_of_one_byte_is_held_by_few_anchors():
    text = b" " * 300_000
    found = suffix_dedup.anchors(text, 400, 200)
    left, windows = suffix_dedup.own_repeats(text, found, 400)
    assert len(left) < 5 and windows.tolist() == [[0, 300_000 - 400]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=4), st.integers(0, 60))
def test_equal_windows_have_equal_anchors(parts, pad):
    text = b"abcab" * 20 + bytes(pad) + b"".join(parts) + bytes(range(pad)) + b"abcab" * 20
    place = {}
    for h, at, lo, hi in suffix_dedup.anchors(text, 32, 12).tolist():
        for p in range(lo, hi + 1):
            assert place.setdefault(text[p : p + 32], (h, at - p)) == (h, at - p)
    assert set(place) == {text[p : p + 32] for p in range(len(text) - 31)}


def test_anchors_don_t_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choices(b"abc", k=5000))
    whole = suffix_dedup.anchors(text, 60, 20)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    suffix_dedup._powers.cache_clear()
    assert suffix_dedup.anchors(text, 60, 20)[:, 1:].tolist() == whole[:, 1:].tolist()
    suffix_dedup._powers.cache_clear()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=12).map(str.encode), max_size=8), max_size=7))
def test_loser_tree_merges_front_coded_runs(lists):
    runs, n = [], 0
    for strings in lists:
        lcps, lengths, rest = suffix_dedup.front_code(sorted(strings))
        runs.append(suffix_dedup.Run(lcps, lengths, rest, [(n + k,) for k in range(len(strings))]))
        n += len(strings)
    out = list(suffix_dedup.merge(runs)) if runs else []
    want = sorted(s for strings in lists for s in strings)
    assert [s for _, s, _ in out] == want
    assert [lcp for lcp, _, _ in out][1:] == [suffix_dedup.common(a, b) for a, b in zip(want, want[1:], strict=False)]
    assert sorted(p for _, _, (p,) in out) == list(range(n))


def test_known_prefixes_are_not_compared_again(monkeypatch):
    """Equal long strings in many runs: each comparison starts behind what is known."""
    seen = []
    plain = suffix_dedup.common
    monkeypatch.setattr(suffix_dedup, "common", lambda a, b, known=0: seen.append(plain(a, b, known) - known) or plain(a, b, known))
    runs = [suffix_dedup.Run([0, 500], [500, 1], b"p" * 500 + bytes([k]), [(k, 0), (k, 1)]) for k in range(8)]
    assert len(list(suffix_dedup.merge(runs))) == 16
    assert sum(seen) <= 7 * 500 + 16  # the tournament's first round, then single bytes


# --- importance resampling

TARGET = [None, "", "abc de abc", "Great words of a target, GREAT words", "ab ab ab"]


@pytest.mark.parametrize("longest,buckets,percent,nodes", [(1, 10_000, 10, 10**6), (3, 50, 40, 20), (1, 10, 0, 5)])
def test_importance_equals_brute_force(spark, longest, buckets, percent, nodes):
    rows = ODD + list(enumerate(words(7, 150), 100)) + [(None, t) for t in words(8, 5)]
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(docs_of(spark, rows), target, least_words=5, percent=percent, longest=longest, buckets=buckets, nodes=nodes).drop("n_words")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == sorted(map(str, importance.brute_force(rows, TARGET, longest=longest, buckets=buckets, least_words=5, percent=percent)))


def test_equal_rows_are_ranked_each(spark):
    rows = [(1, "one two three four five")] * 400 + [(2, "six seven eight nine ten")] * 200
    target = spark.createDataFrame([("one two",)], "text string")
    got = importance.resample(docs_of(spark, rows), target, least_words=5, percent=80).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert len(got) == 600 and ranks == list(range(1, 481))


def test_importance_of_empty_tables(spark):
    target = spark.createDataFrame([("one two",)], "text string")
    assert importance.resample(docs_of(spark, ODD).where("false"), target).count() == 0
    rows = list(enumerate(words(2, 40)))
    got = importance.resample(docs_of(spark, rows), target.where("false"), least_words=1).drop("n_words")
    assert rows_of(got) == sorted(map(str, importance.brute_force(rows, [], least_words=1)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "é", "X9"]), max_size=40), st.integers(1, 4))
def test_walks_of_long_texts_in_parts(words_of, longest):
    text = " ".join(words_of).encode()
    whole = importance.WordTrie(longest, 97)
    whole.add(text)
    before = importance.PART_BYTES
    importance.PART_BYTES = 5
    try:
        parts = importance.WordTrie(longest, 97)
        parts.add(text)
    finally:
        importance.PART_BYTES = before
    assert whole.totals().tolist() == parts.totals().tolist()
