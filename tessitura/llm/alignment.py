"""Token alignment of two tokenizers by a dictionary of distinct groups.

Both encode a blank and the text; the byte offsets where tokens of both end cut the tokens into groups. A group's links
(pairs of tokens whose byte ranges overlap) depend on its ids alone, so tasks intern groups and write each document
as keys with counts; the dictionary of distinct groups, with corpus frequencies, is what links are expanded from, once
each. Pair counts, the best count of each B id and each group's sums are made there, and come back to the documents by
group key. A dictionary of at most ``BROADCAST_GROUPS`` groups is broadcast (8 bytes times four a group); a larger one
is joined by a shuffle, with the same result. Keys are 63-bit hashes of the groups; two groups with one key are found
in the dictionary and everything is done again with another seed.

A text is cut before each blank that stands between two other characters. Both vocabularies end a token there in any
case: the byte-level one splits before such blanks, and no piece of the other holds a blank after another character
(checked when it is loaded). So the tokens of a text are those of its cuts, and a worker remembers the groups of cuts.

Cases: null and empty texts, and texts that a tokenizer doesn't give back byte by byte (U+2581 for instance), have zeros
and an empty digest; a null doc_id and repeated rows keep their rows; an empty table gives no rows; extra columns are
ignored; ties for the best count all count.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, discard, materialise, text_slices

#: Groups up to which the dictionary's sums are sent to every executor: 64 MB.
BROADCAST_GROUPS = 2_000_000
#: Cuts and groups that a worker remembers; beyond either its counts are handed on and the memory is emptied.
REMEMBERED = 300_000
CUT = re.compile(r"(?<=[^\s▁]) (?=\S)")


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spelled = plain + [b for b in range(256) if b not in set(plain)]
        shown = {chr(b if k < len(plain) else 256 + k - len(plain)): b for k, b in enumerate(spelled)}
        self.a_bytes = [bytes(shown[c] for c in self.a.id_to_token(i)) if i != self.a.token_to_id("<|endoftext|>") else b"<|endoftext|>" for i in range(self.a.get_vocab_size())]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        self.cuts_are_safe = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of a blank and each text, by A and by B."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return zip((x.ids for x in a), self.b.encode(texts, num_threads=1), strict=True)

    def cut(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts_are_safe else [text]

    def bounds(self, text: str, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Where tokens of both end, and how many tokens of each end by then; None if the bytes aren't those of a blank and the text."""
        whole = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ended = np.zeros(len(whole) + 1, bool)
        ended[ends_a] = True
        at = ends_b[ended[ends_b]]
        return at, np.searchsorted(ends_a, at) + 1, np.searchsorted(ends_b, at) + 1

    def groups(self, text: str, a: list[int], b: list[int]) -> list[str] | None:
        """The groups of a text as ``a1,a2|b1``."""
        found = self.bounds(text, a, b)
        if found is None:
            return None
        stop_a, stop_b = (x.tolist() for x in found[1:])
        return [f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[k:m]))}" for i, j, k, m in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b, strict=False)]

    def links(self, group: str) -> list[tuple[int, int]]:
        """The overlapping pairs of a group, an entry for each occurrence."""
        a, b = (list(map(int, ids.split(","))) for ids in group.split("|"))
        out, i, j = [], 0, 0
        end_a, end_b = len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            out.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                i += 1
                if i == len(a):
                    return out
                end_a += len(self.a_bytes[a[i]])
            if step_b:
                j += 1
                end_b += len(self.b_bytes[b[j]])


@lru_cache(maxsize=1)
def vocabularies(byte_level: str, pieces: str) -> Vocabularies:
    """Loaded once a worker."""
    return Vocabularies(byte_level, pieces)


class GroupCoder:
    """Interned groups of one task: cuts lead to groups, groups have a key and a count."""

    def __init__(self, own: Vocabularies, seed: int):
        self.own, self.seed = own, seed
        self.forget()

    def forget(self) -> None:
        self.cuts: dict[str, int] = {}  # the number of a cut; -1 for one that isn't given back
        self.said: list[str] = []  # by cut: its groups on end
        self.sizes = np.zeros((0, 3), np.int64)  # by cut: A tokens, B tokens, groups
        self.parts = np.zeros(0, np.int64)  # the cuts' groups' numbers on end
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.keys: list[int] = []
        self.count = np.zeros(0, np.int64)

    def _number(self, group: str) -> int:
        n = self.known.get(group)
        if n is None:
            n = self.known[group] = len(self.keys)
            self.names.append(group)
            self.keys.append(xxhash.xxh3_64_intdigest(group, self.seed) >> 1)
        return n

    def learn(self, cuts: list[str]) -> None:
        """Encode cuts that aren't known yet: many on end, those with white space at an edge one by one."""
        new = [c for c in dict.fromkeys(cuts) if c not in self.cuts]
        plain = [c for c in new if self.own.cuts_are_safe and c == c.strip() and "▁" not in c and c]
        made = [self._learn_many(plain[k : k + 2_000]) for k in range(0, len(plain), 2_000)]
        made += [self._learn_one(c) for c in new if c not in self.cuts]
        self.sizes = np.concatenate([self.sizes, *(sizes for sizes, _ in made)])
        self.parts = np.concatenate([self.parts, *(parts for _, parts in made)])

    def _learn_one(self, cut: str) -> tuple[np.ndarray, np.ndarray]:
        ((a, b),) = self.own.encode([cut])
        groups = self.own.groups(cut, a, b)
        if groups is None:
            self.cuts[cut] = -1
            return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        self.cuts[cut] = len(self.said)
        self.said.append(";".join(groups))
        return np.array([[len(a), len(b), len(groups)]]), np.array([self._number(g) for g in groups])

    def _learn_many(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cuts between blanks are the cuts of the text that they make together."""
        text = " ".join(cuts)
        ((a, b),) = self.own.encode([text])
        bounds = self.own.bounds(text, a, b)
        if bounds is None:
            return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        at, stop_a, stop_b = bounds
        ids_a, ids_b = np.array(a), np.array(b)
        from_a, from_b = np.concatenate(([0], stop_a[:-1])), np.concatenate(([0], stop_b[:-1]))
        single = (stop_a - from_a == 1) & (stop_b - from_b == 1)
        numbers = np.empty(len(at), np.int64)
        pairs, which = np.unique(ids_a[from_a[single]] << 32 | ids_b[from_b[single]], return_inverse=True)
        numbers[single] = np.array([self._number(f"{p >> 32}|{p & 0xFFFFFFFF}") for p in pairs.tolist()], dtype=np.int64)[which]
        for g in np.flatnonzero(~single).tolist():
            numbers[g] = self._number(f"{','.join(map(str, a[from_a[g] : stop_a[g]]))}|{','.join(map(str, b[from_b[g] : stop_b[g]]))}")
        last = np.searchsorted(at, np.cumsum([len(c.encode()) + 1 for c in cuts])) + 1
        first = np.concatenate(([0], last[:-1]))
        self.cuts.update(zip(cuts, range(len(self.said), len(self.said) + len(cuts)), strict=True))
        names = list(map(self.names.__getitem__, numbers.tolist()))
        self.said += [";".join(names[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        sizes = np.stack([stop[last - 1] - begin[first] for stop, begin in ((stop_a, from_a), (stop_b, from_b))] + [last - first], 1)
        return sizes, numbers

    @property
    def full(self) -> bool:
        return len(self.cuts) > REMEMBERED or len(self.keys) > REMEMBERED

    def documents(self, texts: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as cuts: sizes, digests, how many distinct groups, and these groups' numbers and counts on end."""
        self.learn([c for own in texts for c in own])
        at = np.array([n for own in texts for n in map(self.cuts.__getitem__, own)], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
        lost = np.zeros(len(texts), bool)
        lost[row[at < 0]] = True
        kept = ~lost[row]
        at, row = at[kept], row[kept]
        sizes = np.zeros((len(texts), 3), np.int64)
        np.add.at(sizes, row, self.sizes[at])
        ends = np.searchsorted(row, np.arange(len(texts)), "right").tolist()
        said = list(map(self.said.__getitem__, at.tolist()))
        digests = [hashlib.sha256(";".join(said[i:j]).encode()).hexdigest() if i < j else "" for i, j in zip([0, *ends], ends, strict=False)]
        begin = np.concatenate(([0], np.cumsum(self.sizes[:, 2])))[at]
        many = self.sizes[at, 2]
        spread = np.repeat(begin - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
        pairs, counts = np.unique(np.repeat(row, many) << 32 | self.parts[spread], return_counts=True)
        numbers = pairs & 0xFFFFFFFF
        self.count = np.concatenate((self.count, np.zeros(len(self.keys) - len(self.count), np.int64)))
        np.add.at(self.count, numbers, counts)
        return sizes, digests, np.bincount(pairs >> 32, minlength=len(texts)), numbers, counts


_CODED = "n_a long, n_b long, n_groups long, groups_sha256 string, keys array<long>, counts array<long>, group string, frequency long"


def _coded(docs: DataFrame, byte_level: str, pieces: str, doc_id: str, text: str, seed: int) -> DataFrame:
    """One row per document, and one row (with ``group``) per distinct group of a task's memory."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["own_id", *(f.split(" ")[0] for f in _CODED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, id_kind = GroupCoder(vocabularies(byte_level, pieces), seed), None

        def dictionary() -> pa.RecordBatch:
            n = len(coder.keys)
            count = np.zeros(n, np.int64)
            count[: len(coder.count)] = coder.count[:n]
            nothing = [pa.nulls(n, t) for t in (id_kind, pa.int64(), pa.int64(), pa.int64(), pa.string())]
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), pa.array(coder.keys, pa.int64()))
            return pa.RecordBatch.from_arrays([*nothing, lists, pa.nulls(n, pa.list_(pa.int64())), pa.array(coder.names, pa.string()), pa.array(count)], names=names)

        for part in text_slices(batches, "own_text", 2 << 20):
            id_kind = part.column("own_id").type
            sizes, digests, many, numbers, counts = coder.documents([coder.own.cut(t) if t else [] for t in part.column("own_text").to_pylist()])
            offsets = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (np.array(coder.keys, dtype=np.int64)[numbers], counts)]
            yield pa.RecordBatch.from_arrays([part.column("own_id"), *map(pa.array, sizes.T), pa.array(digests, pa.string()), *lists, pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.int64())], names=names)
            if coder.full:
                yield dictionary()
                coder.forget()
        if id_kind is not None and coder.keys:
            yield dictionary()

    return docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("own_text")).mapInArrow(run, f"own_id {id_type}, {_CODED}")


def group_sums(dictionary: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """key, links, best, total of every group; ``dictionary`` has key, group, frequency, a row for each distinct group."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(byte_level, pieces)
        for batch in batches:
            for k in range(0, batch.num_rows, 10_000):
                some = batch.slice(k, 10_000)
                links = list(map(own.links, some.column("group").to_pylist()))
                sizes = [len(x) for x in links]
                pairs = np.array([p for x in links for p in x], dtype=np.int32).reshape(-1, 2)
                columns = [np.repeat(some.column(c).to_numpy(), sizes) for c in ("key", "frequency")]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(columns[1])], names=["key", "a", "b", "frequency"])

    links = materialise(dictionary.select("key", "group", "frequency").mapInArrow(expand, "key long, a int, b int, frequency long"), "links")
    pairs = links.groupBy("a", "b").agg(F.sum("frequency").alias("n"))
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))
    judged = pairs.join(best, "b")
    known = links.select("key", "a", "b").join(judged, ["a", "b"])
    return known.groupBy("key").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("n") == F.col("most")).alias("best"), F.sum("n").alias("total"))


def align(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    for seed in range(8):
        with arrow_batches(docs.sparkSession, 1000):
            coded = materialise(_coded(docs, byte_level, pieces, doc_id, text, seed), "coded")
        interned = coded.where(F.col("group").isNotNull())
        keyed = interned.select(F.col("keys")[0].alias("key"), "group", "frequency")
        dictionary = materialise(keyed.groupBy("key").agg(F.min("group").alias("group"), F.max("group").alias("_other"), F.sum("frequency").alias("frequency")), "groups")
        if dictionary.where(F.col("group") != F.col("_other")).isEmpty():
            break
        discard(coded, dictionary)
    else:
        raise RuntimeError("groups share keys under each of 8 seeds")
    sums = materialise(group_sums(dictionary, byte_level, pieces), "sums")
    rows = coded.where(F.col("group").isNull()).drop("group", "frequency")
    joined = _looked_up(rows, sums) if sums.count() <= broadcast_groups else _joined(rows, sums)
    return joined.withColumnRenamed("own_id", "doc_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_SUMS = ("links", "best", "total")


def _looked_up(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """The dictionary's sums, proven small, by search in sorted arrays."""
    table = sums.toArrow().sort_by("key")
    shared = rows.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("key", *_SUMS)])
    kept = ["own_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, *values = shared.value
        for batch in batches:
            keys, counts = batch.column("keys"), batch.column("counts").flatten().to_numpy()
            at = np.searchsorted(key, keys.flatten().to_numpy())
            ends = np.concatenate(([0], np.cumsum(np.diff(keys.offsets.to_numpy()))))
            found = []
            for value in values:
                running = np.concatenate(([0], np.cumsum(value[at] * counts)))
                found.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=[*kept, "n_links", "n_best", "count_sum"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(kept).schema)
    return rows.mapInArrow(run, f"{fields}, n_links long, n_best long, count_sum long")


def _joined(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """The same by a join on the group key; frequent keys are split by adaptive execution, as ``sums`` has each once."""
    numbered = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    spread = numbered.select("_row", F.explode(F.arrays_zip("keys", "counts")).alias("_g")).select("_row", F.col("_g.keys").alias("key"), F.col("_g.counts").alias("_n"))
    found = spread.join(sums, "key").groupBy("_row").agg(*(F.sum(F.col(c) * F.col("_n")).alias(o) for c, o in zip(_SUMS, ("n_links", "n_best", "count_sum"), strict=True)))
    return numbered.join(found, "_row", "left").fillna(0, ["n_links", "n_best", "count_sum"])


def brute_force(docs: list[tuple[int | None, str | None]], byte_level: str, pieces: str) -> list[tuple]:
    """The contract word for word, for tests: whole texts, all token pairs."""
    own = Vocabularies(byte_level, pieces)
    made, counts = [], {}
    for doc_id, text in docs:
        a = own.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = own.b.encode(text) if text else []
        whole = b" " + (text or "").encode()
        if not text or b"".join(own.a_bytes[i] for i in a) != whole or b"".join(own.b_bytes[i] for i in b) != whole:
            made.append((doc_id, [], [], [], []))
            continue
        # which token of either each byte belongs to: tokens that share a byte are linked
        of_a, of_b = (np.repeat(np.arange(len(ids)), [len(by[i]) for i in ids]) for ids, by in ((a, own.a_bytes), (b, own.b_bytes)))
        links = [(a[i], b[j]) for i, j in np.unique(np.stack([of_a, of_b], 1), axis=0).tolist()]
        groups, i, j = [], 0, 0
        for k in range(1, len(whole) + 1):
            if k == len(whole) or (of_a[k] != of_a[k - 1] and of_b[k] != of_b[k - 1]):
                groups.append(",".join(map(str, a[i : of_a[k - 1] + 1])) + "|" + ",".join(map(str, b[j : of_b[k - 1] + 1])))
                i, j = of_a[k - 1] + 1, of_b[k - 1] + 1
        for pair in links:
            counts[pair] = counts.get(pair, 0) + 1
        made.append((doc_id, a, b, groups, links))
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, x in made]


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
