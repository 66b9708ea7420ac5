"""Removal of long repeated strings by a distributed merge sort of suffixes that compares common prefixes once.

A byte goes if a string of ``width`` bytes that covers it starts anywhere else, in the same text or another.

Sorting all suffixes would move each many times over, so a sparse set of them is sorted from which every window of
``width`` bytes can be judged. A window's anchor is the least hashed ``gram``-byte string in it (the leftmost of equals):
it depends on the window's content alone, so equal windows have equal anchors at the same place. Anchors whose hash is
seen once are dropped. Then two sorts of the same kind follow:

1. The contexts to the left of the anchors, read backwards. The common prefixes of neighbours tell at which depths the set
   of places that share an anchor's left context changes; between two such depths it stays the same.
2. The suffixes at those depths, read forwards. The longest common prefix with a neighbour in this order tells how many
   windows from there on occur elsewhere.

A sort: each task sorts its strings, cuts the run at sampled splitters and sends it front-coded (length of the prefix
shared with the string before, rest, place). A range merges its runs by a loser tree whose nodes keep the prefix known
to be shared with the last winner: contenders with unequal prefixes are told apart by these alone, equal ones are
compared behind the prefix. Equal strings are ordered by place, so a passage held by a third of all texts is dealt over
ranges; what the ranges' edges share is settled over one row a range.

Equal texts are one text: each distinct one is sorted once, and copies lose all windows. Inside periodic stretches the
windows that repeat their text's own former ones are marked where they are read, and not sorted.

Cases: null and empty texts keep no bytes and lose none; texts shorter than ``width`` lose nothing; null doc_ids and
repeated rows keep their rows; an empty table gives no rows; extra columns are ignored. Places are byte offsets, so a
removed run may begin or end inside a character.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, discard, materialise, text_slices

WIDTH = 400
#: Length of the anchors' strings.
GRAM = 200
#: Bytes hashed at once inside a text.
BLOCK = 1 << 20
#: Strings that a task sorts into one run, and strings of a range of the order.
RUN = 50_000
RANGE = 20_000
#: Ranges at most, and sampled strings a range; their product times ``2 * width`` bytes (200 MB) bounds what the driver gets.
#: So 1.3 billion sorted strings, of some 130 GB of repeated text, are in ranges of ``RANGE``; of more the ranges grow.
MOST_RANGES = 65_536
SAMPLED = 4


# --- anchors


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and a number for each byte."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.cumprod(np.full(n, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
    return up, down, np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def _hashes(data: np.ndarray, gram: int, most: int) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte string of a block."""
    up, down, value = _powers(most)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=running[1:])
    h = (running[gram:] - running[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` neighbours."""
    span, out = 1, keys
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :])


def anchors(text: bytes, width: int, gram: int) -> np.ndarray:
    """Rows (hash, place, first window, last window): which windows, by their first byte, have which anchor."""
    n_windows, grams = len(text) - width + 1, width - gram + 1
    parts = []
    for start in range(0, n_windows, BLOCK):
        data = np.frombuffer(text, np.uint8, min(BLOCK + width - 1, len(text) - start), start)
        h = _hashes(data, gram, BLOCK + width)
        keys = h >> np.uint64(21) << np.uint64(21) | np.arange(len(h), dtype=np.uint64)  # equals: the leftmost
        at = (_least(keys, grams) & np.uint64((1 << 21) - 1)).astype(np.int64)
        begin = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        last = np.concatenate((begin[1:], [len(at)])) - 1
        parts.append(np.stack((h[at[begin]].view(np.int64), at[begin] + start, begin + start, last + start), 1))
    if not parts:
        return np.zeros((0, 4), np.int64)
    out = np.concatenate(parts)
    same = np.flatnonzero(np.diff(out[:, 1]) == 0)  # an anchor on both sides of a block's edge
    out[same + 1, 2] = out[same, 2]
    return np.delete(out, same, 0)


def own_repeats(text: bytes, found: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors without those of windows that repeat a former window nearby, and the (first, last) windows of such repeats."""
    same = np.flatnonzero(found[1:, 0] == found[:-1, 0]) + 1
    gone, windows = [], []
    for k, back, (lo, hi) in zip(same.tolist(), (found[same, 1] - found[same - 1, 1]).tolist(), found[same, 2:].tolist(), strict=True):
        if lo >= back and text[lo : hi + width] == text[lo - back : hi + width - back]:
            gone.append(k)
            if windows and windows[-1][1] >= lo - back - 1:
                windows[-1][1] = hi
            else:
                windows.append([lo - back, hi])
    return np.delete(found, gone, 0), np.array(windows, np.int64).reshape(-1, 2)


_ANCHOR = "array<struct<h:long,at:int,lo:int,hi:int>>"
_WINDOWS = "array<struct<lo:int,hi:int>>"


def _lists(tables: list[np.ndarray], names: list[str], wide: int) -> pa.ListArray:
    """Lists of structs from a two-dimensional array each; the first ``wide`` fields are long."""
    flat = np.concatenate([*tables, np.zeros((0, len(names)), np.int64)])
    fields = [pa.array(flat[:, k], pa.int64() if k < wide else pa.int32()) for k in range(len(names))]
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(t) for t in tables]))).astype(np.int32), pa.StructArray.from_arrays(fields, names))


def _digest(text: bytes) -> tuple[str, int, int]:
    whole = hashlib.sha256(text)
    return whole.hexdigest(), *np.frombuffer(whole.digest()[:16], "<i8").tolist()


def _scanned(docs: DataFrame, doc_id: str, text: str, width: int, gram: int) -> DataFrame:
    """A row per document; anchors and own repeats come with the first of equal texts in a task."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in text_slices(batches, "own_text"):
            rows, found, own = [], [], []
            for value in part.column("own_text").to_pylist():
                data = (value or "").encode()
                sha, *key = _digest(data)
                at, windows = np.zeros((0, 4), np.int64), np.zeros((0, 2), np.int64)
                if len(data) >= width and tuple(key) not in seen:
                    seen.add(tuple(key))
                    at, windows = own_repeats(data, anchors(data, width, gram), width)
                rows.append((*key, len(data), sha))
                found.append(at)
                own.append(windows)
            d1, d2, n, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("own_id"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), _lists(found, ["h", "at", "lo", "hi"], 1), _lists(own, ["lo", "hi"], 0)],
                names=["own_id", "d1", "d2", "n_bytes", "sha256", "anchors", "repeats"],
            )

    return docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("own_text")).mapInArrow(run, f"own_id {id_type}, d1 long, d2 long, n_bytes long, sha256 string, anchors {_ANCHOR}, repeats {_WINDOWS}")


def _texts(docs: DataFrame, text: str, width: int) -> DataFrame:
    """d1, d2, text: long enough texts, of equal ones the first in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in text_slices(batches, "own_text"):
            keys, kept = [], []
            for value in part.column("own_text").to_pylist():
                data = (value or "").encode()
                _, *key = _digest(data) if len(data) >= width else (None, 0, 0)
                kept.append(len(data) >= width and tuple(key) not in seen)
                if kept[-1]:
                    seen.add(tuple(key))
                    keys.append(key)
            own = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), part.column("own_text").filter(pa.array(kept, pa.bool_()))], names=["d1", "d2", "text"])

    return docs.select(F.col(text).alias("own_text")).mapInArrow(run, "d1 long, d2 long, text string")


# --- the merge sort


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    high = min(len(a), len(b))
    if a[known:high] == b[known:high]:
        return high
    low = known
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Run:
    """A front-coded sorted run that is read once: the string in hand, its place, the prefix it shares with the last."""

    def __init__(self, lcps: list[int], lengths: list[int], rest: bytes, places: list[tuple]):
        self.items = zip(lcps, lengths, places, strict=True)
        self.rest, self.at, self.string, self.place = rest, 0, b"", ()

    def step(self) -> int:
        """Go on; the shared prefix, or -1 at the end."""
        item = next(self.items, None)
        if item is None:
            return -1
        lcp, length, self.place = item
        self.string = self.string[:lcp] + self.rest[self.at : self.at + length]
        self.at += length
        return lcp


def front_code(strings: list[bytes]) -> tuple[list[int], list[int], bytes]:
    lcps = [0, *map(common, strings, strings[1:])][: len(strings)]
    rest = [s[n:] for s, n in zip(strings, lcps, strict=True)]
    return lcps, list(map(len, rest)), b"".join(rest)


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, tuple]]:
    """Loser tree: (prefix shared with the string before, string, place) in order.

    ``shared[k]`` is what run k's string is known to share with the last winner that passed its node; the run with more of it
    comes first. Only equals are compared, behind what they share, and the loser keeps the new length.
    """
    size = 1
    while size < len(runs):
        size *= 2
    shared = [run.step() for run in runs] + [-1] * (size - len(runs))

    def beats(a: int, b: int) -> bool:
        if shared[a] != shared[b] or shared[a] < 0:
            return shared[a] > shared[b]
        x, y = runs[a], runs[b]
        n = common(x.string, y.string, shared[a])
        if n == len(x.string) == len(y.string):
            first = x.place < y.place
        else:
            first = x.string[n : n + 1] < y.string[n : n + 1]
        shared[b if first else a] = n
        return first

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1]
    while shared[best] >= 0:
        run = runs[best]
        yield shared[best], run.string, run.place
        shared[best] = run.step()
        node = (best + size) // 2
        while node:
            other = losers[node]
            if beats(other, best):
                losers[node], best = best, other
            node //= 2


#: From a text's row: strings with two or three whole numbers that tell the place.
Spell = Callable[[bytes, list[dict]], Iterator[tuple[bytes, int, int, int]]]


def _backwards(gram: int, width: int) -> Spell:
    def spell(data: bytes, rows: list[dict]) -> Iterator[tuple[bytes, int, int, int]]:
        for x in rows:
            yield data[x["lo"] : x["at"] + gram][::-1], x["at"], x["lo"], x["hi"]

    return spell


def _forwards(gram: int, width: int) -> Spell:
    def spell(data: bytes, rows: list[dict]) -> Iterator[tuple[bytes, int, int, int]]:
        for x in rows:
            yield data[x["lo"] : x["hi"] + width], x["lo"], x["hi"], 0

    return spell


_PLACES = "d1 array<long>, d2 array<long>, p array<int>, q array<int>, r array<int>"
_RUNS = f"range int, lcps array<int>, lengths array<int>, rest binary, {_PLACES}"
_SORTED = f"range int, first binary, last binary, lcps array<int>, least int, head array<int>, tail array<int>, {_PLACES}"


def _place_columns(places: list[tuple]) -> list[pa.Array]:
    flat = np.array(places, np.int64).reshape(-1, 5)
    one = np.array([0, len(flat)], np.int32)
    return [pa.ListArray.from_arrays(one, pa.array(flat[:, k], pa.int64() if k < 2 else pa.int32())) for k in range(5)]


def sort_strings(rows: DataFrame, spelled: str, spell: Spell, floor: int, ranges: int) -> DataFrame:
    """Strings of ``rows`` (d1, d2, text and the array ``spelled``) in order: a written table with a row per range.

    ``lcps`` has the prefix that each string shares with the one before (0 for a range's first); ``head`` and ``tail``
    the distinct least values from either end, ``floor`` and more, ``least`` the least of all.
    """
    spark, total = rows.sparkSession, rows.agg(F.sum(F.size(spelled))).first()[0] or 0
    n_ranges = max(1, min(ranges, -(-total // RANGE)))
    rate = max(1, total // (SAMPLED * n_ranges))
    source = rows.select("d1", "d2", "text", F.col(spelled).alias("spelled"))

    def elements(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[tuple]:
        for part in text_slices(batches, "text"):
            for row in part.to_pylist():
                own = row["spelled"]
                if one_in > 1:
                    own = [x for k, x in enumerate(own) if (row["d1"] + 0x9E3779B1 * k) % one_in == 0]
                if own:
                    for string, *place in spell(row["text"].encode(), own):
                        yield string, row["d1"], row["d2"], *place

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for string, d1, d2, p, _, _ in elements(batches, rate):
            yield pa.RecordBatch.from_pylist([{"s": string, "d1": d1, "d2": d2, "p": p}], pa.schema([("s", pa.binary()), ("d1", pa.int64()), ("d2", pa.int64()), ("p", pa.int32())]))

    drawn = sorted(tuple(x) for x in source.mapInArrow(sample, "s binary, d1 long, d2 long, p int").collect()) if n_ranges > 1 else []
    drawn = [(bytes(s), *rest) for s, *rest in drawn]
    splitters = spark.sparkContext.broadcast([drawn[k * len(drawn) // n_ranges] for k in range(1, n_ranges)] if drawn else [])

    def deal(own: list[tuple]) -> Iterator[pa.RecordBatch]:
        own.sort()
        k = j = 0
        while j < len(own):  # only ranges that the run has strings in
            i = j
            k = bisect_right(splitters.value, own[i], lo=k)
            j = bisect_left(own, splitters.value[k], lo=i) if k < len(splitters.value) else len(own)
            lcps, lengths, rest = front_code([x[0] for x in own[i:j]])
            lists = [pa.array([x], pa.list_(pa.int32())) for x in (lcps, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *lists, pa.array([rest], pa.binary()), *_place_columns([x[1:] for x in own[i:j]])], names=[f.split(" ")[0] for f in _RUNS.split(", ")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        for element in elements(batches, 1):
            own.append(element)
            if len(own) == RUN:
                yield from deal(own)
                own = []
        yield from deal(own)

    def gather(table: pa.Table) -> pa.Table:
        runs = [Run(x["lcps"], x["lengths"], x["rest"], list(zip(x["d1"], x["d2"], x["p"], x["q"], x["r"], strict=True))) for x in table.to_pylist()]
        lcps, places, first, last = [], [], None, None
        for lcp, string, place in merge(runs):
            first = string if first is None else first
            last = string
            lcps.append(lcp)
            places.append(place)
        lcps[0] = 0
        head, tail = ([int(x) for x in np.unique(np.minimum.accumulate(np.array(ls, np.int64))) if x >= floor] if ls else [] for ls in (lcps[1:], lcps[:0:-1]))
        lists = [pa.array([x], pa.list_(pa.int32())) for x in (lcps, head, tail)]
        edges = [pa.array([x], pa.binary()) for x in (first, last)]
        least = pa.array([min(lcps[1:], default=1 << 30)], pa.int32())
        return pa.Table.from_arrays([table.column("range").slice(0, 1), *edges, lists[0], least, *lists[1:], *_place_columns(places)], names=[f.split(" ")[0] for f in _SORTED.split(", ")])

    return materialise(source.mapInArrow(send, _RUNS).groupBy("range").applyInArrow(gather, _SORTED), "sorted")


def _edges(ordered: DataFrame, floor: int) -> dict[int, tuple[list[int], list[int]]]:
    """By range: the least values handed over from the ranges before and after it, ``floor`` and more."""
    rows = sorted(ordered.select("range", "first", "last", "least", "head", "tail").collect(), key=lambda r: r["range"])
    between = [0, *(common(bytes(a["last"]), bytes(b["first"])) for a, b in zip(rows, rows[1:], strict=False)), 0]
    out: dict[int, tuple[list[int], list[int]]] = {}
    handed: set[int] = set()
    left = []
    for k, row in enumerate(rows):
        if k:
            before = rows[k - 1]
            handed = {min(between[k], v) for v in (1 << 30, *before["tail"], *(min(before["least"], h) for h in handed))}
            handed = {v for v in handed if v >= floor}
        left.append(sorted(handed))
    handed = set()
    for k in range(len(rows) - 1, -1, -1):
        if k < len(rows) - 1:
            after = rows[k + 1]
            handed = {min(between[k + 1], v) for v in (1 << 30, *after["head"], *(min(after["least"], h) for h in handed))}
            handed = {v for v in handed if v >= floor}
        out[rows[k]["range"]] = (left[k], sorted(handed))
    return out


def _stairs(lcps: list[int], handed: list[int], floor: int) -> list[tuple[int, ...]]:
    """For each string the distinct least values of the lcps back to each former string, ``floor`` and more."""
    stack, out = list(handed), [tuple(handed)]
    for lcp in lcps[1:]:
        while stack and stack[-1] > lcp:
            stack.pop()
        if lcp >= floor and (not stack or stack[-1] < lcp):
            stack.append(lcp)
        out.append(tuple(stack))
    return out


def _starts(ordered: DataFrame, gram: int) -> DataFrame:
    """d1, d2, lo, hi: from each depth at which a set of places changes, the windows up to the next."""
    shared = ordered.sparkSession.sparkContext.broadcast(_edges(ordered, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lcps, out = row["lcps"], []
                left, right = shared.value[row["range"]]
                before = _stairs(lcps, left, gram)
                after = _stairs([0, *lcps[:0:-1]], right, gram)[::-1]
                for a, b, d1, d2, at, lo, hi in zip(before, after, row["d1"], row["d2"], row["p"], row["q"], row["r"], strict=True):
                    if a or b:
                        starts = [x for x in sorted(at + gram - depth for depth in {*a, *b}) if lo <= x <= hi]
                        out += [(d1, d2, x, stop - 1) for x, stop in zip(starts, [*starts[1:], hi + 1], strict=False)]
                yield _window_rows(out)

    return ordered.select("range", "lcps", "d1", "d2", "p", "q", "r").mapInArrow(run, "d1 long, d2 long, lo int, hi int")


def _repeated(ordered: DataFrame, width: int) -> DataFrame:
    """d1, d2, lo, hi: windows that occur elsewhere, from the longest prefix shared with a neighbour."""
    shared = ordered.sparkSession.sparkContext.broadcast({k: (max(a, default=0), max(b, default=0)) for k, (a, b) in _edges(ordered, width).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = shared.value[row["range"]]
                lcps = [left, *row["lcps"][1:], right]
                out = [(d1, d2, lo, min(hi, lo + most - width)) for most, d1, d2, lo, hi in zip(map(max, lcps, lcps[1:]), row["d1"], row["d2"], row["p"], row["q"], strict=False) if most >= width]
                yield _window_rows(out)

    return ordered.select("range", "lcps", "d1", "d2", "p", "q").mapInArrow(run, "d1 long, d2 long, lo int, hi int")


def _window_rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    flat = np.array(rows, np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, k], pa.int64() if k < 2 else pa.int32()) for k in range(4)], names=["d1", "d2", "lo", "hi"])


# --- the operator


def covered(windows: list[tuple[int, int]], width: int) -> list[list[int]]:
    """Byte runs [start, stop) that windows (first, last) cover; runs that touch are one."""
    out: list[list[int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + width)
        else:
            out.append([lo, hi + width])
    return out


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """n_removed, n_spans, kept_sha256 of each distinct text that loses something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            out = []
            for row in part.to_pylist():
                data, kept, at, gone = row["text"].encode(), hashlib.sha256(), 0, 0
                spans = covered([(x["lo"], x["hi"]) for x in (row["repeats"] or []) + (row["found"] or [])], width)
                for start, stop in spans:
                    kept.update(data[at:start])
                    gone, at = gone + stop - start, stop
                kept.update(data[at:])
                out.append((row["d1"], row["d2"], gone, len(spans), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=["d1", "d2", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, ranges: int = MOST_RANGES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. ``gram`` is at most ``width``."""
    with arrow_batches(docs.sparkSession, 500):
        scanned = materialise(_scanned(docs, doc_id, text, width, gram), "scanned")
        places = scanned.select("d1", "d2", F.inline("anchors"))
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2", "at") for f in (F.min, F.max)]
        hashes = places.groupBy("h").agg(*ends).where("min_d1 <> max_d1 or min_d2 <> max_d2 or min_at <> max_at").select("h")
        shared = places.join(hashes, "h").select("d1", "d2", F.struct("at", "lo", "hi").alias("anchor"), F.lit(None).cast("struct<lo:int,hi:int>").alias("repeat"))
        own = scanned.select("d1", "d2", F.explode("repeats").alias("repeat")).select("d1", "d2", F.lit(None).cast("struct<at:int,lo:int,hi:int>").alias("anchor"), "repeat")
        found = shared.unionByName(own).groupBy("d1", "d2").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("repeat").alias("repeats"))
        # tasks send a text once each, so a key has at most one row a task
        held = materialise(_texts(docs, text, width).join(found, ["d1", "d2"]).dropDuplicates(["d1", "d2"]), "held")
        backwards = sort_strings(held, "anchors", _backwards(gram, width), gram, ranges)
        starts = _starts(backwards, gram).groupBy("d1", "d2").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
        begun = materialise(held.select("d1", "d2", "text").join(starts, ["d1", "d2"]), "begun")
        forwards = sort_strings(begun, "starts", _forwards(gram, width), width, ranges)
        repeated = _repeated(forwards, width).groupBy("d1", "d2").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
        lost = held.select("d1", "d2", "text", "repeats").join(repeated, ["d1", "d2"], "left").where("found is not null or size(repeats) > 0")
        cut = materialise(_cut(lost, width), "cut")
        discard(held, backwards, begun, forwards)
    rows = scanned.select("own_id", "d1", "d2", "n_bytes", "sha256")
    copies = rows.where(F.col("n_bytes") >= width).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = cut.join(copies, ["d1", "d2"], "full")
    copied, nothing = F.col("n").isNotNull(), hashlib.sha256(b"").hexdigest()
    return rows.join(judged, ["d1", "d2"], "left").select(
        F.col("own_id").alias("doc_id"),
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple]:
    """The contract word for word, for tests: every window of every text is counted."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[p : p + width] for _, t in texts for p in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window of every text by its digest; the bytes left between removed runs are strung together as hexadecimal digits.
ORACLE_OP12 = f"""
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
w as (select r, p, md5(array_slice(b, p + 1, p + {WIDTH})) as k
      from (select r, b, unnest(range(octet_length(b) - {WIDTH - 1})) as p from d where octet_length(b) >= {WIDTH})),
h as (select r, p from w where k in (select k from w group by k having count(*) > 1)),
g as (select r, p, sum(case when p > q + {WIDTH} or q is null then 1 else 0 end) over (partition by r order by p) as g
      from (select r, p, lag(p) over (partition by r order by p) as q from h)),
s as (select r, min(p) as a, max(p) + {WIDTH} as z from g group by r, g),
k as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as y from s),
o as (select r, sum(z - a) as n_removed, count(*) as n_spans,
        string_agg(hex(case when a > y then array_slice(b, y + 1, a) else ''::blob end), '' order by a)
        || hex(case when max(z) < octet_length(any_value(b)) then array_slice(any_value(b), max(z) + 1, octet_length(any_value(b))) else ''::blob end) as x
      from k join d using (r) group by r)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  case when x is null then sha256(b) else sha256(unhex(x)) end as kept_sha256
from d left join o using (r)
"""
