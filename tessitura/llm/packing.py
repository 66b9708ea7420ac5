"""Best-fit packing of tokenised documents by large-item matching.

A document's ids end with the id 0; only documents longer than the capacity are cut, into full pieces and a rest.
The plan is made from the histogram of piece lengths, which has ``capacity`` rows at most whatever the corpus' size:
lengths above a third of the capacity are matched greedily, longest first with the longest partner that fits, two to
a sequence at most; then the smaller ones, longest first, go where the least room is left (best fit), and into new
sequences where none fits. Identical sequences are planned once with a multiplicity. Each piece then gets a rank
among the pieces of its length (counted by groups salted by row number, so that a length held by a third of all rows is
shared out, equal rows too) and reads its place from the plan.

Cases: null and empty texts are the single id 0; repeated rows are packed each; null doc_ids are kept; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, text_slices

CAPACITY = 2048
#: Words whose ids a Python worker remembers; beyond it the memory is emptied, which only costs time.
REMEMBERED = 300_000
#: Punctuation that is parted from an ASCII letter before it: a token ends there in any case.
PARTED = np.isin(np.arange(256), [ord(c) for c in ".,;:!?*#$%&|"])
LETTER = np.isin(np.arange(256), [ord(c) for c in "abcdefghijklmnopqrstuvwxyz"])
#: A-Z to a-z and newline to blank, which this vocabulary's normal form does too.
FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256)], dtype=np.uint8)


BAR = "|"
#: The vocabulary's special tokens, in any case.
SPECIAL = r"(?i)<\|(start|end)oftext\|>"


class WordCoder:
    """The ids of texts, each distinct word being encoded once while it is remembered.

    White space separates tokens in the vocabulary's normal form, and so does the step from a letter to punctuation;
    a text's ids are therefore those of its words on end. A text that may hold a special token's string is cut at
    blanks alone, like the others, since such strings hold no blank.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        (self.bar,) = self._ids(BAR)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin = [np.zeros(0, np.uint32)], [0]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.begin) - 1, len(self.begin) - 1 + len(words)), strict=True))
        self.begin.extend((ends + self.begin[-1]).tolist())
        self.flat.append(ids)

    def _index(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in the memory; new ones are encoded."""
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.known]
        # many at once, between bars; words that hold a bar themselves go alone
        plain = [w for w in new if BAR not in w]
        for k in range(0, len(plain), 2_000):
            some = plain[k : k + 2_000]
            ids = np.array(self._ids(f" {BAR} ".join(some)), dtype=np.uint32)
            bars = np.flatnonzero(ids == self.bar)
            self._keep(some, np.delete(ids, bars), np.concatenate((bars - np.arange(len(bars)), [len(ids) - len(bars)])))
        for word in new if len(plain) < len(new) else ():
            if BAR in word:
                ids = np.array(self._ids(word), dtype=np.uint32)
                self._keep([word], ids, np.array([len(ids)]))
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each ended by 0, and where each ends."""
        if pc.any(pc.match_substring_regex(pc.fill_null(texts, ""), SPECIAL)).as_py():
            made = [np.array([*x.ids, 0], dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.concatenate(made), np.cumsum([len(x) for x in made])
        lists = pc.split_pattern(parted(texts), " ")
        coded = lists.values.dictionary_encode()
        own = self._index(coded.dictionary.to_pylist())
        begin = np.array(self.begin, dtype=np.int64)
        word = own[coded.indices.to_numpy(zero_copy_only=False)]
        count = (begin[1:] - begin[:-1])[word]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[0][np.repeat(begin[word] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[lists.offsets.to_numpy()]
        return np.insert(ids, bounds[1:], np.uint32(0)), bounds[1:] + np.arange(1, len(bounds))


def parted(texts: pa.Array) -> pa.Array:
    """The texts with A-Z folded, newlines as blanks, and a blank before punctuation that follows a letter."""
    whole = pa.concat_arrays([pc.fill_null(texts, "")]).cast(pa.large_string())
    if not len(whole):
        return whole
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64, count=len(whole) + 1)
    data = FOLD[np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    at = np.flatnonzero(PARTED[data[1:]] & LETTER[data[:-1]]) + 1
    at = at[~np.isin(at, offsets)]
    data = np.insert(data, at, 32)
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer((offsets + np.searchsorted(at, offsets, side="left")).tobytes()), pa.py_buffer(data))


@lru_cache(1)
def word_coder(vocabulary: str) -> WordCoder:
    """A Python worker's own coder, kept between its tasks."""
    return WordCoder(vocabulary)


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise and cut: a row per piece with its document's ids before it, its length and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(vocabulary)
        for part in text_slices(batches, "text", 4 << 20):
            ids, ends = coder.encode(part.column("text"))
            sizes = np.diff(ends, prepend=0)
            many = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            first = (ends - sizes)[row] + start
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            columns = [
                part.column("doc_id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)], pa.int64()),
            ]
            if keep_ids:
                columns.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(first, length, strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, copies a sequence, offset), over the ranks within a length.

    The plan's size depends on the number of distinct lengths, not on the number of documents.
    """
    left = {n: c for n, c in histogram.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    # A kind of sequence: (multiplicity, [(length, copies), ...]); kinds by the room they leave.
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(room: int, many: int, held: list[tuple[int, int]]) -> None:
        if many:
            if room not in rooms:
                rooms[room] = []
                insort(gaps, room)
            rooms[room].append((many, held))

    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            put(capacity - a, left.pop(a), [(a, 1)])
            large.pop()
            continue
        b = large[k]
        many = min(left[a], left[b]) if a != b else left[a] // 2
        if not many:  # one of this length is left, and fits with itself only
            if k == 0:
                put(capacity - a, left.pop(a), [(a, 1)])
            else:
                b = large[k - 1]
                put(capacity - a - b, 1, [(a, 1), (b, 1)])
                left[a] -= 1
                left[b] -= 1
        else:
            put(capacity - a - b, many, [(a, 1), (b, 1)] if a != b else [(a, 2)])
            left[a] -= many
            left[b] -= many
        large = [n for n in large if left.get(n)]
        left = {n: c for n, c in left.items() if c}
    for n in sorted(left, reverse=True):
        need = left[n]
        while need:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                put(capacity - each * n, need // each, [(n, each)])
                put(capacity - need % each * n, int(need % each > 0), [(n, need % each)])
                break
            room = gaps[k]
            many, held = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                gaps.pop(k)
            each = room // n
            full = min(many, need // each)
            put(room - each * n, full, [*held, (n, each)])
            need -= full * each
            rest = many - full
            if rest and need and need < each:
                put(room - need * n, 1, [*held, (n, need)])
                rest, need = rest - 1, 0
            put(room, rest, held)
    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for room in sorted(rooms):
        for many, held in rooms[room]:
            offset = 0
            for n, each in held:
                rows.append((n, ranks[n], ranks[n] + many * each, sequence, each, offset))
                ranks[n] += many * each
                offset += n * each
            sequence += many
    return rows


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to materialised pieces, whose ``row`` numbers tell equal pieces apart; ``row`` goes."""
    spark = cut.sparkSession
    total = cut.count()
    salts = int(min(1024, max(16, total // 2_000_000)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    # capacity x salts rows at most, whatever the input
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "salt"]).astype("int64")
    groups["before"] = groups.groupby("length")["n"].cumsum() - groups["n"]
    before = np.zeros((capacity + 1, salts), dtype=np.int64)
    before[groups["length"], groups["salt"]] = groups["before"]
    table = pd.DataFrame(plan({int(k): int(v) for k, v in groups.groupby("length")["n"].sum().items()}, capacity), columns=["length", "lo", "hi", "sequence", "each", "offset"]).astype("int64").sort_values(["length", "lo"])
    shared = spark.sparkContext.broadcast((before, *(table[c].to_numpy() for c in table.columns)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, lengths, lo, _, sequence, each, offset = shared.value
        for part in batches:
            get = lambda c: part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            n = get("length")
            rank = get("rank") + before[n, get("salt")]
            # plan rows are ordered by (length, lo): one search over both
            step = np.int64(1) << 44
            at = np.searchsorted(lengths * step + lo, n * step + rank, side="right") - 1
            inside = rank - lo[at]
            kept = [c for c in part.schema.names if c not in ("salt", "rank", "row")]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(sequence[at] + inside // each[at]), pa.array(offset[at] + inside % each[at] * n)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "row") + ", sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` and pack them: a row per piece with its sequence and its place there."""
    cut = pieces(docs, vocabulary, doc_id, text, capacity, keep_ids).withColumn("row", F.monotonically_increasing_id())
    return place(materialise(cut, "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
