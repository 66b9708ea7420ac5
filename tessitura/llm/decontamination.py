"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one pass over each text.

Normal form: A-Z lower-cased; words are runs of digits, a-z and non-ASCII characters. A window is ``width``
consecutive words of an item, or the whole item where it has fewer. Words are numbered by the benchmark's vocabulary, and
the automaton walks each text's word numbers once. It holds each item's aligned blocks of ``(width + 1) // 2`` words (every
window of an item contains one of them whole) and the short items; a node per benchmark word, not one per character of
each window. Where a block occurs, the windows around it are looked up by their hashes and compared word by word with the
item, so that a hit is an occurrence of a whole window. Hit words are carried back to code-point offsets of the original.

A benchmark of more words than ``AUTOMATON_WORDS`` is dealt into parts, each with its own automaton; a task keeps the
word numbers of ``RUN_BYTES`` of text and passes them through one part after another, so the text is read and split once, and
an automaton is built once for so much text. All parts give
the same kind of hits, united per row: a row's result doesn't depend on the parts.

Cases: null or wordless texts have no words and are never hit; null, empty or wordless items have no window; an
item given twice counts once by id; null item ids are left out of the id list but their windows still hit; a
repeated document row gives its row again; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, text_slices, total_bytes

WIDTH = 10
#: Words of one automaton (about 400 bytes each in a Python worker, and 17 seconds to build a full one).
AUTOMATON_WORDS = 1_000_000
#: Text that a task scans with one part before it builds the next, where there are several: its word numbers are held.
RUN_BYTES = 48 << 20
#: Benchmark text that is held by the driver and broadcast as word numbers at once. A larger benchmark takes several passes.
PASS_BYTES = 64 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The normal form, byte by byte: what parts words becomes a blank; all bytes of a non-ASCII character stay.
FOLD = np.array([c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], dtype=np.uint8)

HITS = "doc_id long, n_words long, words array<int>, spans array<struct<start:int,end:int>>, item_ids array<string>"


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all words on end in normal form."""
    whole = pa.concat_arrays([pc.fill_null(texts, "")]).cast(pa.large_string())
    if not len(whole):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64, count=len(whole) + 1)
    data = FOLD[np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]]
    folded = pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(folded)
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(ends[0], ends[-1] - ends[0])
    kept = pc.not_equal(flat, "")
    count = np.concatenate(([0], np.cumsum(kept.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return np.diff(count[ends - ends[0]]), flat.filter(kept)


def _hashes(windows: np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers."""
    out = np.zeros(len(windows), np.uint64)
    for k in range(windows.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + windows[:, k].astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out


class Part:
    """Some items' words as numbers (from 1) on end: the automaton of their blocks and short items, the table of their windows."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, width: int):
        self.ids, self.width, self.block = ids, width, (width + 1) // 2
        entries: dict[tuple[int, ...], int] = {}
        self.is_block: list[bool] = []
        self.owners: list[set[int]] = []  # of a short item: the items that are these words
        starts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def entry(a: int, b: int) -> int:
            key = tuple(ids[a:b].tolist())
            if key not in entries:
                entries[key] = len(entries)
                self.is_block.append(False)
                self.owners.append(set())
            return entries[key]

        begin = 0
        for size, own in zip(sizes.tolist(), owner.tolist(), strict=True):
            if size >= width:
                starts.append(np.arange(begin, begin + size - width + 1))
                items.append(np.full(size - width + 1, own))
                for b in range(begin, begin + size - self.block + 1, self.block):
                    self.is_block[entry(b, b + self.block)] = True
            elif size:
                self.owners[entry(begin, begin + size)].add(own)
            begin += size
        start, item = np.concatenate(starts), np.concatenate(items)
        hashes = np.concatenate([np.zeros(0, np.uint64), *(_hashes(self._windows(ids, start[i : i + 100_000])) for i in range(0, len(start), 100_000))])
        order = np.lexsort((item, hashes))
        self.hashes, self.starts, self.items = hashes[order], start[order], item[order]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.lengths = [len(key) for key in entries]
        for key, k in entries.items():
            self.automaton.add_word(key, k)
        if entries:
            self.automaton.make_automaton()

    def _windows(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        return numbers[at[:, None] + np.arange(self.width)]

    def find(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in word numbers on end, 0 being a word that the benchmark lacks or a text's end: first word, words, item."""
        none = np.zeros(0, np.int64)
        if not self.lengths:
            return none, none, none
        block_ends, short = [], []
        for end, k in self.automaton.iter(tuple(flat.tolist())):
            if self.is_block[k]:
                block_ends.append(end)
            if self.owners[k]:
                short += [(end - self.lengths[k] + 1, self.lengths[k], own) for own in self.owners[k]]
        first, many, item = (np.array(x, dtype=np.int64) for x in zip(*short, strict=True)) if short else (none, none, none)
        if block_ends:
            # all windows around a block that lie inside the words
            at = np.unique((np.array(block_ends) - self.block + 1)[:, None] - np.arange(self.width - self.block + 1))
            at = at[(at >= 0) & (at + self.width <= len(flat))]
            at = at[self._windows(flat, at).all(axis=1)]
            hashes = _hashes(self._windows(flat, at))
            lo, hi = np.searchsorted(self.hashes, hashes, side="left"), np.searchsorted(self.hashes, hashes, side="right")
            size = hi - lo
            place = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            at = np.repeat(at, size)
            same = np.zeros(len(at), bool)
            for i in range(0, len(at), 50_000):  # word by word, a run of windows at a time
                same[i : i + 50_000] = (self._windows(flat, at[i : i + 50_000]) == self._windows(self.ids, self.starts[place[i : i + 50_000]])).all(axis=1)
            first = np.concatenate((first, at[same]))
            many = np.concatenate((many, np.full(int(same.sum()), self.width)))
            item = np.concatenate((item, self.items[place[same]]))
        return first, many, item


KEPT: dict[tuple[str, int], Part] = {}


class Benchmark:
    """The broadcast benchmark: its vocabulary, its item ids, and its parts as word numbers."""

    def __init__(self, vocabulary: pa.Array, names: list[str], parts: list, width: int, token: str):
        self.vocabulary, self.names, self.parts, self.width, self.token = vocabulary, names, parts, width, token

    def part(self, k: int) -> Part:
        """A Python worker's automaton, kept between its tasks as long as no other part is asked for."""
        if (self.token, k) not in KEPT:
            KEPT.clear()
            KEPT[self.token, k] = Part(*self.parts[k], self.width)
        return KEPT[self.token, k]

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; (text, word) of the distinct hit words; (text, item) of the distinct items, -1 being one without id."""
        return next(self.scan_run([texts]))

    def scan_run(self, run: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``scan`` of several arrays of texts: each part's automaton goes over all of them before the next one is built."""
        coded = [self._coded(texts) for texts in run]
        found: list[list] = [[] for _ in run]
        order = range(len(self.parts))
        if len(order) > 1 and (self.token, len(order) - 1) in KEPT:  # the part in hand comes first
            order = reversed(order)
        for k in order:
            part = self.part(k)
            for own, (_, _, flat) in zip(found, coded, strict=True):
                own.append(part.find(flat))
        for own, (sizes, begin, _) in zip(found, coded, strict=True):
            first, many, item = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in own)]) for i in range(3))
            row = np.searchsorted(begin, first, side="right") - 1
            spread = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            hit = np.unique(spread)
            hit_row = np.searchsorted(begin, hit, side="right") - 1
            owned = np.unique(np.stack([row, item], axis=1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
            yield sizes, hit_row, hit - begin[hit_row] if len(hit) else hit, owned[:, 0], owned[:, 1]

    def runs(self, slices: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Slices to scan together: one by one where one automaton holds the benchmark, else about ``RUN_BYTES`` of them."""
        own, size = [], 0
        for part in slices:
            own.append(part)
            size += part.nbytes
            if len(self.parts) < 2 or size >= RUN_BYTES:
                yield own
                own, size = [], 0
        if own:
            yield own

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, where each begins, and all word numbers on end, with a 0 behind each text."""
        sizes, words = split_words(texts)
        coded = words.dictionary_encode()
        number = pc.fill_null(pc.add(pc.index_in(coded.dictionary, self.vocabulary), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        flat[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else 0
        return sizes, np.cumsum(sizes + 1) - sizes - 1, flat


def prepare(items: list[tuple[str | None, str | None]], width: int = WIDTH, automaton_words: int = AUTOMATON_WORDS) -> Benchmark:
    """The benchmark of (item id, text) rows. An item longer than a part is cut into pieces that share ``width`` - 1 words."""
    names = sorted({i for i, _ in items if i is not None})
    number = {name: k for k, name in enumerate(names)}
    sizes, words = split_words(pa.array([t for _, t in items], pa.string()))
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    step = max(1, automaton_words - width + 1)
    pieces: list[tuple[int, int, int]] = []  # first word, words, owner
    begin = 0
    for size, (item, _) in zip(sizes.tolist(), items, strict=True):
        own = -1 if item is None else number[item]
        pieces += [(begin + a, min(automaton_words, size - a), own) for a in (range(0, size - width + 1, step) if size > automaton_words else (0,)) if size]
        begin += size
    parts, held, total = [], [], 0
    for k, piece in enumerate(pieces):
        if held and total + piece[1] > automaton_words:
            parts.append(held)
            held, total = [], 0
        held.append(piece)
        total += piece[1]
    parts += [held] if held else []
    made = [(np.concatenate([ids[a : a + n] for a, n, _ in own]), np.array([n for _, n, _ in own]), np.array([o for _, _, o in own])) for own in parts]
    return Benchmark(coded.dictionary, names, made, width, uuid.uuid4().hex)


def spans_of(text: str, hit: list[int]) -> list[dict[str, int]]:
    """Merged code-point spans of the hit words (rising numbers) in the original text."""
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    spans: list[dict[str, int]] = []
    for k, w in enumerate(hit):
        if k and hit[k - 1] == w - 1:
            spans[-1]["end"] = places[w][1]
        else:
            spans.append({"start": places[w][0], "end": places[w][1]})
    return spans


def _lists(row: np.ndarray, values: pa.Array, many: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(many + 1)).astype(np.int32)), values)


def _scan(docs: DataFrame, items: list[tuple[str | None, str | None]], doc_id: str, text: str, width: int, automaton_words: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(prepare(items, width, automaton_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.names
        for own_run in shared.value.runs(text_slices(batches, "text", 4 << 20)):
            for part, (sizes, row, word, item_row, item) in zip(own_run, shared.value.scan_run([x.column("text") for x in own_run]), strict=True):
                yield told(part, names, sizes, row, word, item_row, item)

    def told(part: pa.RecordBatch, names: list[str], sizes: np.ndarray, row: np.ndarray, word: np.ndarray, item_row: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
        words = _lists(row, pa.array(word, pa.int32()), len(part))
        hit = {i: words[i].as_py() for i in np.unique(row).tolist()}
        spans = [spans_of(part.column("text")[i].as_py(), hit[i]) if i in hit else [] for i in range(len(part))]
        named = item >= 0
        own = _lists(item_row[named], pa.array([names[k] for k in item[named].tolist()], pa.string()), len(part))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), words, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), own], names=["doc_id", "n_words", "words", "spans", "item_ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, HITS)


def _passes(benchmark: DataFrame, item_id: str, item_text: str, pass_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's rows, in shares of about ``pass_bytes`` at most; its size is looked at first."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    _, size = total_bytes(items, "t")
    many = max(1, -(-size * 2 // pass_bytes)) if size > pass_bytes else 1
    dealt = items.withColumn("share", F.pmod(F.xxhash64("i", "t"), F.lit(many)))
    for k in range(many):
        yield [tuple(r) for r in dealt.where(F.col("share") == k).select("i", "t").collect()]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, automaton_words: int = AUTOMATON_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document row: n_words, the hit words' numbers, their merged spans in the original text, the items' ids.

    A benchmark of over ``pass_bytes`` of text is scanned for in several passes, whose hits are united by row.
    """
    passes = _passes(benchmark, item_id, item_text, pass_bytes)
    first, second = next(passes), next(passes, None)
    if second is None:
        return _scan(docs, first, doc_id, text, width, automaton_words)
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("own_id"), F.col(text).alias("own_text")), "decontaminate")
    found = None
    for items in (first, second, *passes):
        one = _scan(rows, items, "row", "own_text", width, automaton_words).drop("spans")
        found = one if found is None else found.unionByName(one)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = found.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), united("words").alias("words"), united("item_ids").alias("item_ids"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "own_text"):
            hit = part.column("words").to_pylist()
            spans = [spans_of(t, w) if w else [] for t, w in zip(part.column("own_text").to_pylist(), hit, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("own_id"), part.column("n_words"), part.column("words"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), part.column("item_ids")], names=["doc_id", "n_words", "words", "spans", "item_ids"])

    return rows.join(merged, "row").select("own_id", "own_text", "n_words", "words", "item_ids").mapInArrow(place, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The report: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, **options)
    return hits.select(
        "doc_id",
        "n_words",
        F.size("words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, automaton_words: int = AUTOMATON_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs. Each row is judged by its own text."""
    left, before = docs, None
    passes = _passes(benchmark, "item_id", "text", pass_bytes)
    items = next(passes)
    while items is not None:
        left, items = _without(left, items, text, width, automaton_words), next(passes, None)
        if items is not None:
            left = materialise(left, "clean")
            if before is not None:
                discard(before)
            before = left
    return left


def _without(docs: DataFrame, items: list[tuple[str | None, str | None]], text: str, width: int, automaton_words: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(prepare(items, width, automaton_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_run in shared.value.runs(text_slices(batches, text, 4 << 20)):
            for part, (_, row, *_) in zip(own_run, shared.value.scan_run([x.column(text) for x in own_run]), strict=True):
                kept = np.ones(len(part), bool)
                kept[row] = False
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def windows_of(text: str | None, width: int = WIDTH) -> list[str]:
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple]:
    """The contract word for word, for tests: every window is tried at every word."""
    out = []
    for doc_id, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for item_id, item in items:
            for window in windows_of(item, width):
                want = window.split(" ")
                for i in range(len(words) - len(want) + 1):
                    if words[i : i + len(want)] == want:
                        hit |= set(range(i, i + len(want)))
                        ids.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_OP4 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, array_to_string(w[i:i + {WIDTH - 1}], ' ') as k, least(len(w), {WIDTH}) as n
       from (select item_id, w, unnest(range(1, greatest(1, len(w) - {WIDTH - 1}) + 1)) as i from b where len(w) > 0)),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as k
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
m as (select doc_id, i, dw.n, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from m) group by doc_id),
t as (select doc_id, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as f
      from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(f, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id
"""
