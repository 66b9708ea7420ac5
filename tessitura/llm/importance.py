"""Resampling towards a target distribution: importance weights over hashed word n-grams, from partition-local tries.

Features are all runs of 1 to ``longest`` consecutive words. Each task keeps the runs that it sees in a trie whose nodes
hold a count and the CRC state of the run's bytes, so a longer run's CRC goes on from its parent's. A task gives what
its nodes add up to per bucket (``buckets`` rows at most), the totals of source and target are merged by bucket, and
each bucket gets its gain. Documents are then scored by walking a trie whose nodes hold gains. A trie that reaches
``NODES`` nodes is emptied (counts are handed to the bucket totals first), which bounds a task's memory.

The draw is an order by score over all rows, without a sort in one task: scores are whole numbers from a range that does
not grow with the corpus (a gain lies between plus and minus 1000 times the logarithm of a count, Gumbel noise between
-3,200 and 22,900), so the histogram of scores is small; it gives each score's first rank and the least score that is
drawn. Only drawn rows are sorted, dealt by ranges of (score, doc_id, row number), so equal rows split too.

Cases: null and empty texts have no words, weight 0 and can't be drawn unless ``least_words`` is 0; a null doc_id is
hashed as the empty text, comes last among ties and keeps its row; repeated rows are scored and ranked each, in any
order among themselves; an empty table gives no rows; an empty target gives each bucket the gain of t = 0; extra
columns are ignored. A word without end is one word.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, text_slices

BUCKETS = 10_000
LONGEST = 1
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: Trie nodes that a task holds.
NODES = 1_000_000
#: Text whose words are listed at once; a longer text is read in parts that end between words.
PART_BYTES = 4 << 20
#: Words are runs of ASCII letters, digits and all that isn't ASCII; in UTF-8 that is a class of bytes.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


class _Children(defaultdict):
    """A node's children by word; a missing child is made by the trie."""

    def __init__(self, trie: WordTrie, node: int):
        super().__init__()
        self.trie, self.node = trie, node

    def __missing__(self, word: bytes) -> int:
        made = self[word] = self.trie.grow(self.node, word)
        return made


class WordTrie:
    """Runs of words; ``crc`` holds each node's CRC state, ``gain`` (if gains are given) what its bucket is worth."""

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None, nodes: int = NODES):
        self.longest, self.buckets, self.gains, self.nodes = longest, buckets, gains, nodes
        self.clear()

    def clear(self) -> None:
        self.children: list[_Children] = []
        self.crc: list[int] = []
        self.gain: list[int] = []
        self.count = np.zeros(0, np.int64)
        self.grow(-1, b"")

    def grow(self, parent: int, word: bytes) -> int:
        crc = zlib.crc32(word if parent <= 0 else b" " + word, self.crc[parent] if parent > 0 else 0)
        self.crc.append(crc)
        if self.gains is not None:
            self.gain.append(int(self.gains[crc % self.buckets]))
        self.children.append(_Children(self, len(self.children)))
        return len(self.children) - 1

    def walk(self, text: bytes) -> Iterator[tuple[int, list[int]]]:
        """Lengths and node numbers of all runs of a text, each run once; long texts come in parts."""
        carried: list[bytes] = []
        for words in word_parts(text):
            old, words = len(carried), carried + words
            nodes = list(map(self.children[0].__getitem__, words))
            yield 1, nodes[old:]
            for extra in range(1, self.longest):
                children = self.children
                nodes = [children[node][word] for node, word in zip(nodes, words[extra:], strict=False)]
                yield extra + 1, nodes[max(0, old - extra) :]
            carried = words[max(0, len(words) - self.longest + 1) :] if self.longest > 1 else []

    def add(self, text: bytes) -> None:
        """Count a text's runs."""
        for _, nodes in self.walk(text):
            found = np.bincount(nodes)
            if len(self.count) < len(found):
                self.count = np.concatenate((self.count, np.zeros(2 * len(found), np.int64)))
            self.count[: len(found)] += found

    def score(self, text: bytes) -> tuple[int, int, int]:
        """Words, runs, and the sum of the runs' gains."""
        words = runs = total = 0
        for length, nodes in self.walk(text):
            words += len(nodes) if length == 1 else 0
            runs += len(nodes)
            total += sum(map(self.gain.__getitem__, nodes))
        return words, runs, total

    def totals(self) -> np.ndarray:
        """Counts by bucket."""
        own = np.zeros(len(self.crc), np.int64)
        own[: len(self.count)] = self.count[: len(own)]
        total = np.zeros(self.buckets, np.int64)
        np.add.at(total, np.array(self.crc[1:], dtype=np.int64) % self.buckets, own[1:])
        return total

    @property
    def full(self) -> bool:
        return len(self.crc) > self.nodes


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lowered; long texts in parts."""
    start = 0
    while start < len(text):
        stop = len(text)
        if stop - start > PART_BYTES:
            found = OTHER.search(text, start + PART_BYTES)
            stop = found.end() if found else stop
        yield WORD.findall(text[start:stop].lower())
        start = stop


def bucket_totals(rows: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = WordTrie(longest, buckets, nodes=nodes), np.zeros(buckets, np.int64)
        for part in text_slices(batches, text):
            for value in part.column(text).to_pylist():
                if value:
                    trie.add(value.encode())
                    if trie.full:
                        total += trie.totals()
                        trie.clear()
        total += trie.totals()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    return rows.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain, from the two tables of totals (``buckets`` rows at most each)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for totals, into in ((source, s), (target, t)):
        for row in totals.collect():
            into[row.bucket] = row.n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(all_s + buckets)) / (float(a + 1) * float(all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def importance_scores(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, nodes: int = NODES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    spark = docs.sparkSession
    gains = bucket_gains(bucket_totals(docs, text, longest, buckets, nodes), bucket_totals(target, target_text, longest, buckets, nodes), buckets)
    shared = spark.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(longest, buckets, shared.value, nodes)
        for part in text_slices(batches, "own_text"):
            found = []
            for value in part.column("own_text").to_pylist():
                words, runs, total = trie.score(value.encode()) if value else (0, 0, 0)
                found.append((words, runs, total // runs if runs else 0))
                if trie.full:
                    trie.clear()
            numbers = np.array(found, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("own_id"), *map(pa.array, numbers.T)], names=["doc_id", "n_words", "n_features", "weight"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("own_text"))
    scored = rows.mapInArrow(score, f"doc_id {id_type}, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    return scored.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored``, a written table, with ``rank``: 1, 2, ... for the highest ``percent`` of the rows with enough words, else null."""
    able = scored.where(F.col("n_words") >= least_words)
    histogram = sorted(able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda row: -row.score)
    wanted = sum(row.n for row in histogram) * percent // 100
    seen, least = 0, None
    for row in histogram:
        if seen < wanted:
            seen, least = seen + row.n, row.score
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    chosen = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    dealt = scored.where(chosen).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # a row's number holds its partition above and its place there below
    dealt = materialise(dealt.withColumn("_place", F.monotonically_increasing_id()), "drawn")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")  # a row for each partition
    ranked = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + place + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``."""
    return draw(materialise(importance_scores(docs, target, **options), "scores"), least_words, percent)


def brute_force(docs: list[tuple[int | None, str | None]], target: list[str | None], longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> list[tuple]:
    """The contract word for word, for tests; rows in the order of ``docs``."""

    def words_of(text: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))

    def features(text: str | None) -> list[int]:
        words = words_of(text)
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    own = [features(text) for _, text in docs]
    s, t = Counter(b for f in own for b in f), Counter(b for text in target for b in features(text))
    gains = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, _), found in zip(docs, own, strict=True):
        weight = math.floor(sum(gains[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [k for k, (_, text) in enumerate(docs) if len(words_of(text)) >= least_words]
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(able[: percent * len(able) // 100]):
        out[k][4] = rank + 1
    return [tuple(row) for row in out]


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).drop("n_words")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 bit by bit: 3988292384 is its reversed polynomial.
ORACLE_OP13 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select {_WORDS} as w from benchmark),
dw as (select doc_id, unnest(w) as f from d),
bw as (select unnest(w) as f from b),
v as (select distinct f from (select f from dw union all select f from bw)),
tab as (select list(list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
        from (select unnest(range(256)) as i)),
vb as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(f))), lambda k: ('0x' || substr(hex(encode(f)), 2 * k + 1, 2))::bigint)),
         lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} as bucket from v, tab),
s as (select bucket, count(*) as n from dw join vb using (f) group by bucket),
t as (select bucket, count(*) as n from bw join vb using (f) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from dw) + {BUCKETS})::double
        / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from bw) + {BUCKETS})::double)))::bigint as gain
      from (select distinct bucket from vb) left join s using (bucket) left join t using (bucket)),
x as (select doc_id, floor(sum(gain)::double / count(*))::bigint as weight from dw join vb using (f) join g using (bucket) group by doc_id),
r as (select d.doc_id, len(d.w)::bigint as n_features, coalesce(x.weight, 0) as weight, coalesce(x.weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
      from d left join x using (doc_id)),
k as (select doc_id, row_number() over (order by score desc, doc_id) as rank from r where n_features >= {LEAST_WORDS}
      qualify rank <= {PERCENT} * count(*) over () // 100)
select r.doc_id, r.n_features, r.weight, r.score, k.rank from r left join k using (doc_id)
"""
