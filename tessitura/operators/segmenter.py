"""Words of unspaced text by a given dictionary: a lattice of the dictionary's words and the path of the highest probability.

A word weighs log(frequency / sum of frequencies). A character that no path's word covers stands alone, with frequency 1.
Of paths of equal weight the one whose first word is longer wins, then whose second is, and so on. Weights are added
from the end of the text to its begin.

A dictionary within ``BROADCAST_BYTES`` (its size is checked) goes to the tasks as a trie; beyond it, texts are cut into
the spans that the dictionary's longest word allows, spans are joined to the dictionary by a shuffle, and each text's
lattice is made of what was found. Both ways give the same words.

Cases: null texts stay null, empty ones have no words; null and empty words, null frequencies and those below 1 are left
out of the dictionary; of a word that comes twice the highest frequency holds; with an empty dictionary each
character is a word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of a dictionary's words up to which it is broadcast; a trie takes some 100 times as many in a worker.
BROADCAST_BYTES = 8 << 20


def trie_of(words: dict[str, float]) -> dict:
    """Nested dicts by character; the weight of the word that ends at a node is under the empty string."""
    root: dict = {}
    for word, weight in words.items():
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = weight
    return root


def best_path(length: int, spans: Callable[[int], Iterator[tuple[int, float]]], alone: float) -> list[tuple[int, int]]:
    """The path through ``length`` characters; ``spans(i)`` gives (end, weight) of the words that begin at i."""
    score, end = [0.0] * (length + 1), [0] * (length + 1)
    for i in range(length - 1, -1, -1):
        best, to = alone + score[i + 1], i + 1
        for j, weight in spans(i):
            own = weight + score[j]
            if own > best or (own == best and j > to):
                best, to = own, j
        score[i], end[i] = best, to
    out, i = [], 0
    while i < length:
        out.append((i, end[i]))
        i = end[i]
    return out


def segment_text(text: str, trie: dict, alone: float) -> list[str]:
    def spans(i: int) -> Iterator[tuple[int, float]]:
        node, j = trie, i
        while j < len(text) and text[j] in node:
            node = node[text[j]]
            j += 1
            if "" in node:
                yield j, node[""]

    return [text[i:j] for i, j in best_path(len(text), spans, alone)]


def _clean(dictionary: DataFrame) -> DataFrame:
    good = dictionary.where((F.col("word") != "") & (F.col("frequency") >= 1))
    return good.groupBy("word").agg(F.max("frequency").cast("long").alias("frequency"))


def segment(rows: DataFrame, text: str, dictionary: DataFrame, name: str = "words", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with ``name``, the words of ``text`` as an array; ``dictionary`` has word and frequency."""
    clean = _clean(dictionary)
    size, total, longest = clean.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0)), F.coalesce(F.sum("frequency"), F.lit(1)), F.coalesce(F.max(F.length("word")), F.lit(1))).first()
    if size <= broadcast_bytes:
        return _by_trie(rows, text, clean, name, int(total))
    return _by_join(rows, text, clean, name, int(total), int(longest))


def _by_trie(rows: DataFrame, text: str, clean: DataFrame, name: str, total: int) -> DataFrame:
    alone = math.log(1 / total)
    words = rows.sparkSession.sparkContext.broadcast({r.word: math.log(r.frequency / total) for r in clean.toLocalIterator()})

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = trie_of(words.value)
        for part in parts:
            yield pd.Series([None if x is None else segment_text(x, trie, alone) for x in part], dtype=object)

    return rows.withColumn(name, cut(F.col(text)))


def _by_join(rows: DataFrame, text: str, clean: DataFrame, name: str, total: int, longest: int) -> DataFrame:
    """Distinct texts only are cut into spans, so a text that many rows share is worked on once."""
    alone = math.log(1 / total)
    own = rows.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    n = F.length("_text")
    starts = own.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))))
    spans = starts.withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.greatest(F.least(F.col("_i") + longest, n), F.col("_i") + 1))))
    found = spans.select("_text", "_i", "_j", F.expr("substring(_text, _i + 1, _j - _i)").alias("word")).join(clean, "word")
    lattice = found.groupBy("_text").agg(F.collect_list(F.struct("_i", "_j", "frequency")).alias("_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for whole, pieces in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                at: dict[int, list[tuple[int, float]]] = {}
                for p in pieces or []:
                    at.setdefault(p["_i"], []).append((p["_j"], math.log(p["frequency"] / total)))
                words.append([whole[i:j] for i, j in best_path(len(whole), lambda i: iter(sorted(at.get(i, []))), alone)])  # noqa: B023
            yield pa.RecordBatch.from_arrays([batch.column("_text"), pa.array(words, pa.list_(pa.string()))], names=["_text", name])

    made = own.join(lattice, "_text", "left").mapInArrow(cut, f"_text string, `{name}` array<string>")
    return rows.join(made, rows[text] == made["_text"], "left").drop("_text")
