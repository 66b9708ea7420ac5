"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct word shingles, as 64-bit hashes. The global n-gram order (hash ranges, and inside a
range by rising frequency) is cut into fragments; a fragment's task sees each set's segment of that range and counts
partial overlaps there, and the partial counts are summed per pair. Fragments are hash ranges, and their number grows with
the input, so each holds a bounded number of n-grams on average. Many fragments cut a set into many short segments, so
in step 1 the segments that a slice of documents sends to a fragment share one row, and later steps cut horizontally as
well, by set size (below). A class sends a fragment one segment a task, however many copies it has, and documents' own
rows are never grouped. N-grams that over ``HOT`` different sets hold (found in a sample
that grows with the input, ``HOT_SAMPLE``; only the way of the work depends on it) are known to be shared, so step 1 counts
them where they are read and sends them to no fragment; later steps see them for the remaining classes alone.

1. Documents with equal sets are one class. The segments (32 bits an n-gram) of the order's first part, ``PART`` of it,
   meet in their fragments, which count for each class how many of its n-grams there another class has too. A link
   needs 4/5 of a set to be shared, so a class that shares too few of the first part alone is settled, and its other
   n-grams are never sent. Classes with equal segments are also hung on the least few of their kind (star pairs).
2. The remaining classes' segments (64 bits) give the star pairs' exact partial overlaps; sums over fragments decide
   the links, and their components are found.
   Steps 2 to 4 deal classes by size bands besides: linked sets' sizes differ by a quarter at most, so with bands wider
   than that a pair meets in its larger set's band, and a class is in its own band and at most the next.
3. Fragments then look for every other pair that could link two components: a pair with J >= t has a fragment where
   its segments' own J is >= t, so both share an n-gram among their segments' rarest (prefix filter by local
   frequency). A pair is passed on if its sizes agree and the bound from 256 finer fragments (in each, the overlap is
   at most the smaller count) reaches the threshold. Copies that already hang together are never paired again.
4. Those pairs' partial overlaps are counted and summed as in step 2; all links together give the components.

A class is a 64-bit hash of the set, checked against a second one: if two sets ever met in a class, all is done anew with
another seed. No link between components is lost: steps 1 and 3 only leave out pairs that can't reach the threshold or lie inside
one component. Cases: null, empty and wordless texts have an empty set, no link, and themselves as component; fewer
words than a shingle make one shingle; rows with a null doc_id are in no class (component null); repeated rows are in
one class; a doc_id with several texts has a row for each, and links of either; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, discard, materialise, text_slices
from .components import connected_components

SHINGLE = 5
#: J >= 80/100, as 9 * intersection >= 4 * (size + size).
PERCENT = 80
#: N-grams of one fragment: in the first step (4 bytes each), and later, in its fullest size band (8 bytes each).
FRAGMENT, LATER_FRAGMENT = 16_000_000, 3_000_000
LEAST_FRAGMENTS, LEAST_LATER = 24, 12
#: Of the n-gram order, what step 1 looks at. A text without near copies has this share of its n-grams for itself, and is
#: settled by it as long as it is well over a fifth.
PART = 3 / 8
#: Sets that hold an n-gram before it is hot, and of how many documents one is looked at for that.
HOT, HOT_SAMPLE = 100_000, 64
#: Hot n-grams that are sent to the tasks (4 MB), the most frequent ones; others go through the fragments, with the same result.
MOST_HOT = 500_000
#: Members of equal segments on which the others are hung, in the first ``LEAST_FRAGMENTS``; only the order of work depends on it.
HUBS = 4
#: Ratio of a size band's ends; at least 100 / PERCENT.
BAND = 1.5625
#: N-grams that a fragment of step 1 sorts at once.
SORTED = 2_000_000
#: Partners of a class that are tried before all others in step 3; only the order of work depends on it.
LIKELIEST = 2
#: Rows of an Arrow batch.
BATCH = 1000
#: Set keys that a task remembers at most, to send each set's segments once.
SEEN = 1_000_000
#: Finer fragments of the overlap bound.
BOUND = 256
#: Class ids (8 bytes) that are broadcast at most, with a component or with pairs; beyond that the join is left to Spark.
BROADCAST_IDS = 2_000_000


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two rounds of shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = SHINGLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts on end, how many each text has, each set's own hash, and a second one."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    kept = pc.not_equal(flat, "")
    ends = np.concatenate(([0], np.cumsum(kept.to_numpy(zero_copy_only=False), dtype=np.int64)))[offsets - offsets[0]]
    coded = flat.filter(kept).dictionary_encode()
    words = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    prime = np.uint64(0x9E3779B97F4A7C15)
    rolled = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        rolled = rolled * prime + words[k : k + len(rolled)]
    rolled = _mix(rolled)
    sets, sizes, keys, checks = [], *(np.zeros(len(texts), np.int64) for _ in range(3))
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b - a >= width:
            own = np.unique(rolled[a : b - width + 1])
        elif b > a:  # the whole sequence; its length keeps it apart from longer ones
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * prime + w
                own = _mix(np.array([h]))
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
        whole = np.array(_set_keys(own.tobytes(), seed), dtype=np.uint64).astype(np.int64)
        keys[i], checks[i] = whole
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), sizes, keys, checks


def _set_keys(raw: bytes, seed: int) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(raw, seed=2 * seed), xxhash.xxh3_64_intdigest(raw, seed=2 * seed + 1)


def hot_grams(base: DataFrame, rows: int, width: int, seed: int = 0) -> np.ndarray:
    """Sorted hashes of the n-grams that, by the sample, over ``HOT`` different sets hold; ``MOST_HOT`` at most."""
    if rows < HOT:
        return np.zeros(0, np.uint64)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 20):
            flat, sizes, keys, _ = shingle_sets(part.column("text"), width, seed)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(keys, sizes))], names=["gram", "k"])

    sample = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(grams, "gram long, k long").distinct()
    often = sample.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, HOT / HOT_SAMPLE))
    return np.sort(np.array([r["gram"] for r in often.orderBy(F.desc("n"), "gram").limit(MOST_HOT).select("gram").collect()], dtype=np.int64).view(np.uint64))


def _segments(flat: np.ndarray, sizes: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets on end: each non-empty segment's text, fragment and end in ``flat``."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    fragment = (((flat >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)
    key = row * fragments + fragment
    ends = np.flatnonzero(np.diff(key, append=-1)) + 1 if len(key) else np.zeros(0, np.int64)
    last = ends - 1
    return row[last], fragment[last], ends


def _packed(fragment: np.ndarray, keys: np.ndarray, n: np.ndarray, begin: np.ndarray, many: np.ndarray, flat: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """A row per fragment: its segments' heads (key; set size and segment length, 32 bits each) and n-grams on end."""
    order = np.argsort(fragment, kind="stable")
    fragment, begin, many = fragment[order], begin[order], many[order]
    total = np.cumsum(many)
    at = np.repeat(begin - (total - many), many) + np.arange(total[-1] if len(total) else 0)
    heads = np.stack([keys[order], n[order] << 32 | many], axis=1).ravel()
    last = np.flatnonzero(np.diff(fragment, append=-1))
    return pa.array(fragment[last].astype(np.int32)), _binary(heads, 2 * (last + 1)), _binary(flat[at].astype(np.uint32), total[last])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    offsets = np.concatenate(([0], ends)).astype(np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column on end, and how many each row has."""
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for chunk in column.chunks:
        _, offsets, data = chunk.cast(pa.large_binary()).buffers() if not chunk.offset else pa.concat_arrays([chunk]).cast(pa.large_binary()).buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[: len(chunk) + 1] if len(chunk) else np.zeros(1, np.int64)
        sizes.append(np.diff(ends))
        if ends[-1] > ends[0]:
            parts.append(np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).view(dtype), np.concatenate(sizes) // np.dtype(dtype).itemsize


def _unseen(keys: np.ndarray, may: np.ndarray, seen: set[int]) -> np.ndarray:
    """Of the rows that ``may``, whether a row is the first of its key in this task. Later copies' segments are never sent,
    so a class sends a fragment at most a row a task, however many copies it has."""
    out = np.zeros(len(keys), dtype=bool)
    for i in np.flatnonzero(may).tolist():
        key = int(keys[i])
        if key not in seen:
            out[i] = True
            if len(seen) >= SEEN:
                seen.clear()  # only sends some segments again
            seen.add(key)
    return out


def _first_of_each(keys: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(keys, return_index=True)[1])


#: ``other``: of SHARED rows the number of shared n-grams, of STAR rows a class.
FIRST = "kind int, k long, other long"
SHARED, STAR = 1, 2


def _shared_counts(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many of each row's n-grams another row has too. Values are sorted range by range, so only a part is held twice."""
    count = np.zeros(rows, dtype=np.int64)
    edges = np.linspace(0, 1 << 32, 2 + len(values) // SORTED, dtype=np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        some = np.flatnonzero((values >= low) & (values < high)) if len(edges) > 2 else slice(None)
        both = values[some].astype(np.uint64) << np.uint64(32) | row[some]
        both.sort()
        ranked = both >> np.uint64(32)
        same = ranked[1:] == ranked[:-1]
        shared = np.append(same, False) | np.append(False, same) if len(both) else np.zeros(0, dtype=bool)
        count += np.bincount((both[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=rows)
    return count


def _count_shared(rest: pa.Table) -> pa.Table:
    """A fragment of step 1: classes' shared n-grams, star pairs."""
    heads = _joined(rest.column("heads"), np.int64)[0].reshape(-1, 2)
    k, n, sizes = heads[:, 0].copy(), heads[:, 1] >> 32, heads[:, 1] & 0xFFFFFFFF
    values, _ = _joined(rest.column("grams"), np.uint32)
    keep = _first_of_each(k)
    if len(keep) < len(k):
        fine = np.zeros(len(k), dtype=bool)
        fine[keep] = True
        values = values[np.repeat(fine, sizes)]
        k, n, sizes = k[keep], n[keep], sizes[keep]
    row = np.repeat(np.arange(len(k), dtype=np.uint32), sizes)
    count = _shared_counts(values, row, len(k))
    some = np.flatnonzero(count)
    groups: dict[bytes, list[int]] = {}
    end = np.cumsum(sizes)
    if rest.num_rows and rest.column("fragment")[0].as_py() < LEAST_FRAGMENTS:
        for i in np.flatnonzero((count == sizes) & (sizes > 0)).tolist():
            groups.setdefault(values[end[i] - sizes[i] : end[i]].tobytes(), []).append(i)
    pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for members in groups.values():
        if len(members) < 2:
            continue
        own = np.array(members)
        own = own[np.argsort(k[own])]
        for h in own[:HUBS]:
            other = own[(k[own] > k[h]) & (5 * np.minimum(n[own], n[h]) >= 4 * np.maximum(n[own], n[h]))]
            pairs_a.append(k[other])
            pairs_b.append(np.full(len(other), k[h]))
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    return pa.table(
        {
            "kind": np.repeat(np.array([SHARED, STAR], dtype=np.int32), [len(some), len(a)]),
            "k": np.concatenate((k[some], a)),
            "other": np.concatenate((count[some].astype(np.int64), b)),
        }
    )


def _overlaps(table: pa.Table) -> pa.Table:
    """A fragment of steps 2 and 4: the partial overlap of every asked pair."""
    k = table.column("k").to_numpy()
    keep = _first_of_each(k)
    table, k = table.take(keep), k[keep]
    values, sizes = _joined(table.column("grams"), np.uint64)
    _, code = np.unique(values, return_inverse=True)
    most = int(code.max()) + 1 if len(code) else 1
    row = np.repeat(np.arange(len(k)), sizes)
    present = np.sort(row * most + code)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    partners = table.column("partners").combine_chunks()
    many = pc.fill_null(pc.list_value_length(partners), 0).to_numpy(zero_copy_only=False)
    left = np.repeat(np.arange(len(k)), many)
    wanted = partners.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    right = _positions(k, wanted)
    found = right >= 0
    left, right = left[found], right[found]
    count = np.zeros(len(left), dtype=np.int64)
    for at in range(0, len(left), 20_000):
        i, j = left[at : at + 20_000], right[at : at + 20_000]
        size = sizes[i]
        total = np.cumsum(size)
        element = np.repeat(begin[i] - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        key = np.repeat(j, size) * most + code[element]
        spot = np.searchsorted(present, key)
        hit = present[np.minimum(spot, len(present) - 1)] == key
        count[at : at + 20_000] = np.bincount(np.repeat(np.arange(len(i)), size)[hit], minlength=len(i))
    some = np.flatnonzero(count)
    return pa.table({"a": k[left[some]], "b": k[right[some]], "part": count[some]})


def _positions(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value is in ``keys``, or -1."""
    order = np.argsort(keys)
    spot = np.minimum(np.searchsorted(keys[order], wanted), max(0, len(keys) - 1))
    at = order[spot] if len(keys) else np.zeros(len(wanted), np.int64)
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def _find_pairs(table: pa.Table, likeliest: int | None) -> pa.Table:
    """A fragment of step 3: pairs of different components that this fragment's segments allow.

    With ``likeliest``, of each class outside its places' main component only so many, by the bound.
    """
    k = table.column("k").to_numpy()
    keep = _first_of_each(k)
    table, k = table.take(keep), k[keep]
    n, component = table.column("n").to_numpy(), table.column("component").to_numpy()
    bound = _joined(table.column("bound"), np.uint8)[0].reshape(len(k), BOUND)
    segments: dict[bytes, int] = {}
    of = np.array([segments.setdefault(g, len(segments)) for g in table.column("grams").to_pylist()], dtype=np.int64)
    values = np.frombuffer(b"".join(segments), dtype=np.uint64)
    sizes = np.array([len(g) // 8 for g in segments], dtype=np.int64)
    _, code, df = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((code, df[code], owner))  # each segment's n-grams, rarest first
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - -(-sizes * PERCENT // 100) + 1
    early = place < prefix[owner]
    codes, owners = code[order][early], owner[early]
    # (n-gram, class) rows of the prefixes
    by_segment = np.argsort(of, kind="stable")
    many = np.bincount(of, minlength=len(sizes))
    first = np.cumsum(many) - many
    size = many[owners]
    total = np.cumsum(size)
    member = by_segment[np.repeat(first[owners] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
    gram = np.repeat(codes, size)
    order = np.argsort(gram, kind="stable")
    gram, member = gram[order], member[order]
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    ends = np.append(starts[1:], len(gram))
    asked: dict[int, list[tuple[int, int]]] = {}
    placed = component[member]
    mixed = np.minimum.reduceat(placed, starts) != np.maximum.reduceat(placed, starts) if len(starts) else np.zeros(0, dtype=bool)
    for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        own = placed[a:b]
        names, times = np.unique(own, return_counts=True)
        main = names[np.argmax(times)]
        for x in member[a:b][own != main].tolist():
            asked.setdefault(x, []).append((a, b))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, ranges in asked.items():
        other = np.unique(np.concatenate([member[a:b] for a, b in ranges]))
        other = other[(component[other] != component[x]) & (5 * np.minimum(n[other], n[x]) >= 4 * np.maximum(n[other], n[x]))]
        for at in range(0, len(other), 50_000):
            some = other[at : at + 50_000]
            least = np.minimum(bound[some], bound[x])
            most = least.sum(axis=1, dtype=np.int64)
            full = (least == 255).any(axis=1)  # a count that didn't fit its byte bounds nothing
            fits = full | (9 * most >= 4 * (n[some] + n[x]))
            some = some[fits]
            if likeliest is not None and len(some) > likeliest:
                some = some[np.argsort(-most[fits] / (n[some] + n[x]), kind="stable")[:likeliest]]
            out_a.append(np.maximum(k[some], k[x]))
            out_b.append(np.minimum(k[some], k[x]))
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _likeliest(table: pa.Table) -> pa.Table:
    return _find_pairs(table, LIKELIEST)


def _all_left(table: pa.Table) -> pa.Table:
    return _find_pairs(table, None)


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(BAND) + 1e-9).cast("int")


def _bands(n: Column) -> Column:
    """The bands of a set of n: its own, and that of sets a quarter larger. Two sets that may link are both in the larger one's."""
    return F.array_distinct(F.array(_band(n), _band(n * (100 / PERCENT))))


def _links(segments: DataFrame, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a > b) whose summed partial overlaps reach the threshold; materialised."""
    na, nb = sizes.select(F.col("k").alias("a"), F.col("n").alias("na")), sizes.select(F.col("k").alias("b"), F.col("n").alias("nb"))
    sized = materialise(pairs.join(na, "a").join(nb, "b").select("a", "b", "na", "nb", _band(F.greatest("na", "nb")).alias("band")), "sized")
    ends = sized.select(F.col("a").alias("k"), "band", "b").union(sized.select(F.col("b").alias("k"), "band", F.lit(None).cast("long")))
    asked = ends.groupBy("k", "band").agg(F.collect_list("b").alias("partners"))
    few = 2 * sized.count() <= BROADCAST_IDS
    rows = segments.select("fragment", "k", "grams").join(F.broadcast(asked) if few else asked, "k")
    parts = rows.groupBy("fragment", "band").applyInArrow(_overlaps, "a long, b long, part long")
    total = parts.groupBy("a", "b").agg(F.sum("part").alias("both"))
    linked = total.join(sized, ["a", "b"]).where(100 * F.col("both") >= PERCENT * (F.col("na") + F.col("nb") - F.col("both")))
    out = materialise(linked.select("a", "b"), "linked")
    discard(sized)
    return out


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """A row per document row: doc_id, n_shingles, component_id (least doc_id that links reach)."""
    with arrow_batches(docs.sparkSession, BATCH):
        for seed in range(8):
            found = _components(docs, doc_id, text, width, seed)
            if found is not None:
                return found
        raise RuntimeError("set hashes keep colliding")


def _components(docs: DataFrame, doc_id: str, text: str, width: int, seed: int) -> DataFrame | None:
    """None where different sets have met in a class."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    letters, rows = base.agg(F.coalesce(F.sum(F.length(F.col("text"))), F.lit(0)), F.count(F.lit(1))).first()
    words = letters // 6
    shared_hot = docs.sparkSession.sparkContext.broadcast(hot_grams(base, rows, width, seed))
    fragments = int(max(LEAST_FRAGMENTS, -(-words * PART // FRAGMENT)))
    whole = round(fragments / PART)  # fragments of the whole order, of which the first are looked at

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hot = shared_hot.value
        for part in text_slices(batches, "text", 4 << 20):
            flat, sizes, keys, checks = shingle_sets(part.column("text"), width, seed)
            own_sizes = sizes
            if len(hot) and len(flat):
                cold = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] != flat
                own_sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[cold], minlength=len(sizes)).astype(np.int64)
                flat = flat[cold]
            row, fragment, ends = _segments(flat, own_sizes, whole)
            many = len(sizes)
            ids = part.column("doc_id")
            # a row per document, in no fragment; and a row per fragment, with the segments of each set that an id has, once a task
            early = fragment < fragments
            named = early & _unseen(keys, ids.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0), seen)[row]
            lengths = np.diff(ends, prepend=0)
            part_sizes = np.bincount(row[early], weights=lengths[early], minlength=many).astype(np.int64)
            own = row[named]
            place, heads, grams = _packed(fragment[named], keys[own], sizes[own], (ends - lengths)[named], lengths[named], flat)
            none = len(place)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([place, pa.nulls(many, pa.int32())]),
                    pa.concat_arrays([heads, pa.nulls(many, pa.binary())]),
                    pa.concat_arrays([grams, pa.nulls(many, pa.binary())]),
                    *(pa.concat_arrays([pa.nulls(none, pa.int64()), c]) for c in (ids, pa.array(keys), pa.array(sizes), pa.array(part_sizes), pa.array(checks))),
                ],
                names=["fragment", "heads", "grams", "doc_id", "k", "n", "part", "second"],
            )

    scanned = materialise(base.mapInArrow(cut, "fragment int, heads binary, grams binary, doc_id long, k long, n long, part long, second long"), "scanned")
    first = materialise(scanned.where("fragment is not null").select("fragment", "heads", "grams").groupBy("fragment").applyInArrow(_count_shared, FIRST), "shared")
    meta = scanned.where("fragment is null").select("doc_id", "k", "n", "part", "second")
    classes = meta.where("n > 0 and doc_id is not null").groupBy("k").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("part").alias("part"), F.count(F.lit(1)).alias("copies"), (F.min("second") != F.max("second")).alias("odd"))
    shared = first.where(F.col("kind") == SHARED).groupBy("k").agg(F.sum("other").alias("shared"))
    alone = F.col("part") - F.coalesce(F.col("shared"), F.lit(0))
    alive = materialise(classes.join(shared, "k", "left").where(100 * alone <= (100 - PERCENT) * F.col("n")).select("k", "rep", "n"), "alive")
    n_alive = alive.count()
    fullest = alive.select("n", F.explode(_bands(F.col("n"))).alias("band")).groupBy("band").agg(F.sum("n").alias("grams")).agg(F.coalesce(F.max("grams"), F.lit(0))).first()[0]
    later = int(max(LEAST_LATER, -(-fullest // LATER_FRAGMENT)))

    wanted = alive.select(F.col("rep").alias("doc_id"), "k")

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in text_slices(batches, "text", 4 << 20):
            flat, sizes, keys, _ = shingle_sets(part.column("text"), width, seed)
            fine = keys == part.column("k").to_numpy()  # else another text of this doc_id
            fine = _unseen(keys, fine, seen)
            flat, sizes, keys = flat[np.repeat(fine, sizes)], sizes[fine], keys[fine]
            row, fragment, ends = _segments(flat, sizes, later)
            own = np.repeat(np.arange(len(sizes)), sizes)
            finer = np.bincount(own * BOUND + (_mix(flat) % np.uint64(BOUND)).astype(np.int64), minlength=len(sizes) * BOUND).clip(max=255).astype(np.uint8)
            bound = _binary(finer, np.arange(1, len(sizes) + 1) * BOUND)
            yield pa.RecordBatch.from_arrays([pa.array(fragment.astype(np.int32)), pa.array(keys[row]), pa.array(sizes[row]), _binary(flat, ends), bound.take(pa.array(row))], names=["fragment", "k", "n", "grams", "bound"])

    chosen = base.join(F.broadcast(wanted) if n_alive <= BROADCAST_IDS else wanted, "doc_id").select("text", "k")
    segments = materialise(chosen.mapInArrow(recut, "fragment int, k long, n long, grams binary, bound binary"), "segments")
    sizes = alive.select("k", "n")

    # the hubs that most of its segments name are a class's likeliest links; whatever else links it is found in step 3
    named = first.where(F.col("kind") == STAR).groupBy(F.col("k").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    star = named.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("times"), "b"))).where(F.col("place") <= HUBS).select("a", "b")
    star = star.join(sizes.select(F.col("k").alias("a")), "a", "left_semi").join(sizes.select(F.col("k").alias("b")), "b", "left_semi")
    links = _links(segments, star.select("a", "b"), sizes)
    for ask in (_likeliest, _all_left):  # the likeliest pairs first, which spare most of the others; then all that are left
        known = materialise(connected_components(links), "known")
        named = known.withColumnRenamed("node", "k")
        placed = segments.join(F.broadcast(named) if n_alive <= BROADCAST_IDS else named, "k", "left").withColumn("component", F.coalesce("component", "k"))
        banded = placed.withColumn("band", F.explode(_bands(F.col("n"))))
        pairs = materialise(banded.groupBy("fragment", "band").applyInArrow(ask, "a long, b long").distinct(), "pairs")
        links = links.unionByName(_links(segments, pairs, sizes))
        discard(known, pairs)
    final = connected_components(links)
    named = classes.select("k", "rep").join(final.withColumnRenamed("node", "k"), "k")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed_classes = named.join(least, "component").select("k", "component_id")
    # classes of one document without links need no row here: the document is its own component
    copies = classes.where("copies > 1").select("k", "rep", "odd")
    table = materialise(copies.join(placed_classes, "k", "full").select("k", F.coalesce("component_id", "rep").alias("component_id"), "odd"), "classes")
    if not table.where("odd").isEmpty():  # different sets have met in a class
        discard(scanned, segments, alive, table)
        return None
    out = meta.drop("second").join(table.drop("odd"), "k", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    discard(segments, alive)
    return out


ORACLE_OP1 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
u as (select a, b from e union all select b, a from e),
r(doc_id, seen) as (select doc_id, doc_id from w union select r.doc_id, u.b from r join u on r.seen = u.a)
select w.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(r.seen) as component_id
from w left join n on n.doc_id = w.doc_id join r on r.doc_id = w.doc_id group by w.doc_id
"""


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
