"""Nearest neighbours by additive quantisation, then exact reranking.

A vector is coded as the sum of one codeword from each of ``books`` full-dimensional codebooks. The codebooks are
fitted on a bounded sample, each by k-means to the residuals that the former ones leave, then refitted together by
least squares. Every row is encoded by beam search, and keeps its code and the squared norm of its reconstruction.
A query's approximate distance to a row is |q|^2 - 2 (sum of looked-up inner products) + stored norm.

Codes are written once, beside their vectors, and never sent to queries: the queries are broadcast, ``QUERY_BYTES`` of them
at once (more take more rounds over the codes), and each task walks its codes in chunks. A chunk gives every query a
shortlist by approximate distance, reranks it at once by exact distance in double precision on the original vectors, and
keeps the ``k`` + 1 best so far; so a task hands on that many rows per query, however many codes and chunks it has. The
chunks' shortlists together hold ``shortlist`` rows at least, each chunk's being its share with a margin for chance.

Equal vectors are coded once: a distinct vector keeps its ``k`` + 1 smallest ids, which is all that a result of ``k``
can hold of it, so a vector that a third of all rows share is one entry. Where what is kept holds too few different ids
(an id may have many vectors), its queries are asked again with more.

Cases: vectors that are null, all zero, of another length than the most common one, or hold null or non-finite
components take no part, neither do null ids; a repeated row counts once; an id with different vectors asks with each and
is met by each, and the least distance counts, so the ranks of a query name different ids; a query never meets its own
id; ties go to the smaller id; with fewer than ``k`` candidates all are returned; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

BOOKS, WORDS, BEAM = 24, 64, 4
#: Rows that the codebooks are fitted on at most.
FIT_ROWS = 16_000
#: Rows that are reranked for a query, at least.
SHORTLIST = 600
#: Query vectors that are broadcast at once, in bytes; and how many of them are scored together.
QUERY_BYTES, QUERY_BLOCK = 24 << 20, 512
#: Codes of a chunk.
ROW_CHUNK = 20_000
SALTS = 64
FINAL = "query_id long, rank int, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        many = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


class Quantiser:
    """Codebooks as an array (books, words, dimensions), in single precision: distances are only approximate here."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks = np.ascontiguousarray(codebooks, dtype=np.float32)
        self.flat = self.codebooks.reshape(-1, codebooks.shape[2])
        self.norms = (self.codebooks**2).sum(2)

    def encode(self, x: np.ndarray, beam: int = BEAM, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared norms of the reconstructions, by beam search over the codebooks in order."""
        x = np.asarray(x, dtype=np.float32)
        parts = [self._encode(x[i : i + block], beam) for i in range(0, len(x), block)]
        if not parts:
            return np.zeros((0, len(self.codebooks)), np.uint8), np.zeros(0)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, d = x.shape
        rest = x[:, None, :]  # what each beam leaves of its vector
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        for book, words in enumerate(self.codebooks):
            cost = (rest**2).sum(2)[:, :, None] + self.norms[book] - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, rest.shape[1], -1)
            cost = cost.reshape(n, -1)
            keep = min(beam if book < len(self.codebooks) - 1 else 1, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(words), best % len(words)
            rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0], ((x - rest[:, 0]) ** 2).sum(1).astype(float)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> Quantiser:
    """Residual k-means codebooks, then two rounds of beam encoding and joint least squares."""
    rng = np.random.default_rng(seed)
    sample = np.asarray(sample, dtype=np.float32)
    rest, made = sample.copy(), []
    for _ in range(books):
        centres = kmeans(rest, words, rng)
        if len(centres) < words:
            centres = np.concatenate([centres, np.zeros((words - len(centres), sample.shape[1]))])
        made.append(centres)
        rest = rest - centres[np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)]
    quantiser = Quantiser(np.stack(made))
    for _ in range(2):
        codes, _ = quantiser.encode(sample)
        columns = codes.astype(np.int64) + np.arange(books) * words
        normal = np.zeros((books * words, books * words))
        right = np.zeros((books * words, sample.shape[1]))
        for a in range(books):
            np.add.at(right, columns[:, a], sample)
            for b in range(books):
                np.add.at(normal, (columns[:, a], columns[:, b]), 1)
        solved = np.linalg.solve(normal + 0.1 * np.eye(len(normal)), right + 0.1 * quantiser.flat)
        quantiser = Quantiser(solved.reshape(books, words, -1))
    return quantiser


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vec (array of doubles) of the rows that take part."""
    vec = F.col("vec")
    fine = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull()
        & vec.isNotNull()
        & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vec, lambda x: x != 0)
    )
    common = fine.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    return fine.join(F.broadcast(common.select("d")), F.size("vec") == F.col("d"), "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(rows: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", shortlist: int = SHORTLIST, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``k`` nearest rows of each query row: query_id, rank, vec_id, score. ``is_query`` takes the vec_id column."""
    spark = rows.sparkSession
    # -0.0 + 0.0 is 0.0: equal vectors have equal bytes
    good = usable(rows, vec_id, embedding).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).dropDuplicates(["vec_id", "vec"])
    # a vector's ids are dealt to salted groups, each of which keeps what a result can need
    distinct = materialise(
        good.withColumn("n", F.row_number().over(Window.partitionBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")))
        .where(F.col("n") <= k + 1)
        .groupBy("vec")
        .agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
        .withColumn("entry", F.xxhash64("vec")),
        "vectors",
    )
    sample = distinct.orderBy(F.xxhash64("entry"), "vec").limit(fit_rows).select("vec").toPandas()
    if not len(sample):
        return spark.createDataFrame([], FINAL)
    quantiser = fit(np.array(sample["vec"].tolist(), dtype=float))
    shared = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, norms = shared.value.encode(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(bytes, codes)), pa.binary()), pa.array(norms)], names=["entry", "vec", "code", "norm"])

    coded = materialise(distinct.select("entry", "vec").mapInArrow(encode, "entry long, vec array<double>, code binary, norm double"), "codes")
    # each vector of a query id asks for itself
    queries = good.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec")
    asked = materialise(queries.withColumn("ask", F.monotonically_increasing_id()), "queries")
    entries = coded.count()
    wanted = good.select("vec_id").distinct().limit(k + 1).count() - 1
    ranked, keep = None, k + 1
    while True:
        done = materialise(_ask(coded, distinct, asked, entries, shared, k, shortlist, keep), "ranked")
        if keep >= entries:
            return done if ranked is None else ranked.unionByName(done)
        full = done.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= wanted).select("query_id")
        lacking = asked.join(full, "query_id", "left_anti")
        if lacking.isEmpty():
            return done if ranked is None else ranked.unionByName(done)
        some = done.join(full, "query_id", "left_semi")
        ranked = some if ranked is None else ranked.unionByName(some)
        asked, shortlist, keep = materialise(lacking, "queries"), 8 * shortlist, 8 * keep


def _share(entries: int, rows: int, shortlist: int, keep: int) -> int:
    """Of a chunk of so many rows, how many are reranked: its part of the shortlist, and thrice its standard deviation."""
    mean = shortlist * rows / max(1, entries)
    return min(rows, max(2 * keep, int(mean + 3 * mean**0.5) + keep))


def _nearest(q: np.ndarray, codes: np.ndarray, norms: np.ndarray, x: np.ndarray, quantiser: Quantiser, many: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of queries and a chunk: squared distances and rows of the ``keep`` nearest among the ``many`` approximately nearest."""
    books, words, _ = quantiser.codebooks.shape
    look = (q.astype(np.float32) @ quantiser.flat.T).reshape(len(q), books, words)
    approx = np.broadcast_to(norms.astype(np.float32), (len(q), len(codes))).copy()  # |q|^2 is the same for all rows
    for book in range(books):
        approx -= 2 * look[:, book, codes[:, book]]
    near = np.argpartition(approx, many - 1, axis=1)[:, :many] if many < len(codes) else np.tile(np.arange(len(codes)), (len(q), 1))
    exact = np.concatenate([((x[near[i : i + 64]] - q[i : i + 64, None, :]) ** 2).sum(2) for i in range(0, len(q), 64)])
    if keep < near.shape[1]:
        best = np.argpartition(exact, keep - 1, axis=1)[:, :keep]
        return np.take_along_axis(exact, best, axis=1), np.take_along_axis(near, best, axis=1)
    return exact, near


def _ask(coded: DataFrame, distinct: DataFrame, asked: DataFrame, entries: int, shared, k: int, shortlist: int, keep: int) -> DataFrame:
    """Ranks of the queries ``asked`` (query_id, vec, ask), by the ``keep`` nearest entries that shortlists of so many give."""
    context = coded.sparkSession.sparkContext
    at_once = max(1, QUERY_BYTES // (8 * shared.value.codebooks.shape[2]))
    rounds = max(1, -(-asked.count() // at_once))
    dealt = asked.select("ask", "vec").withColumn("round", F.pmod(F.xxhash64("ask"), F.lit(rounds)))
    found = None
    for number in range(rounds):
        own = dealt.where(F.col("round") == number).select("ask", "vec").toPandas()
        asking = context.broadcast((own["ask"].to_numpy(np.int64), np.array(own["vec"].tolist(), dtype=float)))

        def scan(batches: Iterator[pa.RecordBatch], asking=asking) -> Iterator[pa.RecordBatch]:
            asks, q = asking.value
            score, entry = np.full((len(asks), 0), np.inf), np.zeros((len(asks), 0), np.int64)
            for chunk in _chunks(batches, ROW_CHUNK):
                x = _matrix(chunk.column("vec"))
                codes = np.frombuffer(b"".join(chunk.column("code").to_pylist()), dtype=np.uint8).reshape(len(x), -1)
                norms, entry_ids = chunk.column("norm").to_numpy(), chunk.column("entry").to_numpy()
                many = _share(entries, len(x), shortlist, keep)
                parts = [_nearest(q[i : i + QUERY_BLOCK], codes, norms, x, shared.value, many, keep) for i in range(0, len(q), QUERY_BLOCK)]
                if parts:
                    score = np.concatenate([score, np.concatenate([p[0] for p in parts])], axis=1)
                    entry = np.concatenate([entry, entry_ids[np.concatenate([p[1] for p in parts])]], axis=1)
                if score.shape[1] > keep:
                    best = np.argpartition(score, keep - 1, axis=1)[:, :keep]
                    score, entry = np.take_along_axis(score, best, axis=1), np.take_along_axis(entry, best, axis=1)
            for i in range(0, len(asks), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks[i : i + 10_000], score.shape[1])), pa.array(entry[i : i + 10_000].ravel()), pa.array(score[i : i + 10_000].ravel())], names=["ask", "entry", "near"])

        near = coded.mapInArrow(scan, "ask long, entry long, near double")
        near = materialise(near, "near") if rounds > 1 else near
        found = near if found is None else found.unionByName(near)
    # ties at the end of what is kept: equal distances are kept alike, and vectors at equal distance are different entries
    cut = found.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy("near", "entry"))).where(F.col("n") <= keep)
    pairs = cut.select("ask", "entry").join(asked.select("ask", "query_id", F.col("vec").alias("q")), "ask").join(distinct.select("entry", "vec", "ids"), "entry")
    exact = F.sqrt(F.aggregate(F.zip_with("q", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    scored = pairs.select("query_id", "ids", exact.alias("score")).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    least = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held and sum(map(len, held)):
        yield pa.concat_batches(held)


def brute_force(vectors: dict[int, np.ndarray], queries: list[int], k: int = 10) -> list[tuple[int, int, int, float]]:
    """Exact neighbours, for tests."""
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids]).astype(float)
    out = []
    for q in queries:
        d = np.sqrt(((x - np.asarray(vectors[q], dtype=float)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out += [(q, r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)]
    return out


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 100 == 0)
