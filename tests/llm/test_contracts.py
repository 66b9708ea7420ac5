"""The queries over whole tables of the smallest scale, against SQL or a brute-force version."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessitura.llm import alignment, ann, decontamination, entries, html_extraction, packing, secret_scan

from test_cases import plain_base

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = entries.QUERIES[name](spark, SF).toPandas(), duck.execute(entries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_op2_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    want = ann.brute_force(rows, [i for i in rows if i % 100 == 0])
    got = {(r.query_id, r.vec_id): r.score for r in entries.QUERIES["op2_additive_quantisation"](spark, SMALL).collect()}
    hit = [(q, v) in got for q, _, v, _ in want]
    assert np.mean(hit) >= 0.9
    assert all(abs(got[q, v] - s) < 1e-12 for q, _, v, s in want if (q, v) in got)


def test_op3_articles(spark, duck):
    import html
    import re

    def truth(page):  # these pages hold their text in one article element
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1|article)>", inner)]
        return "\n".join(p for p in parts if p)

    pages = {p: h for p, h in duck.execute("select page_id, html from pages").fetchall()}
    got = entries.QUERIES["op3_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    assert np.mean([r.text == truth(pages[r.page_id]) for r in got]) > 0.97
    assert all(r.n_chars == len(r.text) for r in got)


def test_op6_spans(spark, duck):
    docs = dict(duck.execute("select doc_id, text from documents").fetchall())
    for r in entries.QUERIES["op6_secret_scan"](spark, SF).collect():
        base, added = secret_scan.find_spans(docs[r.doc_id])
        assert [(secret_scan.KINDS[k], a, b) for a, k, b in base] == plain_base(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(secret_scan.join_spans(base).encode()).hexdigest()
        assert r.spans == secret_scan.join_spans(base + added)
        assert r.n_hex == sum(k == 2 for _, k, _ in base)


def test_op7_round_trip(spark, duck):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = duck.execute("select doc_id, text from documents").fetchall()
    got = {(r.doc_id, r.piece): r for r in entries.QUERIES["op7_best_fit_packing"](spark, SF).collect()}
    n = total = 0
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            r = got[doc_id, piece]
            assert (r.start, r.length, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
            n += 1
    assert n == len(got)
    filled: dict = {}
    for r in sorted(got.values(), key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-total // 2048) + 1


def test_op11_against_brute_force(spark, duck):
    import public_tokenizers

    docs = duck.execute("select doc_id, text from documents").fetchall()
    got = sorted(tuple(r) for r in entries.QUERIES["op11_cross_tokenizer_alignment"](spark, SF).collect())
    assert got == sorted(alignment.brute_force(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


@pytest.mark.parametrize("name,label,least", [("op9_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.95)])
def test_classifiers_on_the_held_out_fold(spark, duck, name, label, least):
    sf = "/root/testdata/sf0.1"
    known = dict(duck.execute(f"select doc_id, {label} from '{sf}/labels.parquet'").fetchall())
    got = entries.QUERIES[name](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) >= least


def test_op10_recall_and_precision_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    known = dict(duckdb.connect().execute(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    held = [r for r in entries.QUERIES["op10_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in known]
    caught = sum(r.predicted and known[r.doc_id] for r in held)
    assert caught / sum(known[r.doc_id] for r in held) >= 0.9
    assert caught / sum(r.predicted for r in held) >= 0.95


def test_op8_is_native_and_whole(spark, duck):
    df = entries.QUERIES["op8_chat_formatting"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = df.collect()
    assert len(rows) == duck.execute("select count(distinct (conv_id, turn)) from conversations").fetchone()[0]
    by: dict = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    for own in by.values():  # nothing is quoted here: replies follow turns
        assert [r.reply_order for r in sorted(own, key=lambda r: r.turn)] == list(range(1, len(own) + 1))


def test_pipeline_against_stages_one_by_one(spark, tmp_path, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    whole = corpus_pipeline.run(spark, SF)
    assert rows_of(whole.drop("sequence_id", "offset").toPandas()) == rows_of(docs.drop("sequence_id", "offset").toPandas())
    items = duck.execute("select item_id, text from benchmark").fetchall()
    hit = {i for i, _, n, *_ in decontamination.brute_force([(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "secret_scans")).collect()], items) if n}
    last = spark.read.parquet(str(tmp_path / "secret_scans")).collect()
    assert len(last) == kept[2] == kept[3] < kept[0] < 200
    assert not hit and all(not sum(map(len, secret_scan.find_spans(r.text))) and r.n_chars == len(r.text) for r in last)


def test_html_field_on_unseen_pages():
    field = html_extraction.trained_field()
    wrong = total = 0
    for rows, labels in html_extraction.learn(html_extraction.labelled_pages(150, seed=77)):
        found = field.decode(rows)
        wrong, total = wrong + sum(a != b for a, b in zip(found, labels, strict=True)), total + len(labels)
    assert wrong / total < 0.03
    assert packing.CAPACITY == 2048
