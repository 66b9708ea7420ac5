"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per class (label 0 and 1) a mean and a covariance of the statistics, shrunk towards the pooled covariance and its
diagonal, are kept as a Cholesky factor. The score is the logistic function of the difference of the two log
densities (Mahalanobis terms through the cached factors, log determinants, log priors), tempered by the number of
statistics so that it stays inside 0 and 1.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 isn't 1, of which at most ``fit_rows`` (chosen by a
hash of the id) are read. Scores use the text alone. Cases: null and empty texts have all-zero counts and are scored like
any other; where no label of both classes can be learnt every score is 0.5; a document labelled twice counts once,
with the larger label; null labels and ids teach nothing; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, text_slices

#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 20_000
SHRINK_POOLED, SHRINK_DIAGONAL = 0.10, 0.10
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "stops", "bangs", "bars", "non_ascii",
    "newlines", "distinct_words", "same_neighbour", "top_word", "distinct_lines", "line_length", "symbol_ends",
)


def _byte_classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    digit = (code >= 48) & (code <= 57)
    stop = np.isin(code, [ord(c) for c in ".,;:?'\"()-"])
    bang, bar, space = code == ord("!"), code == ord("|"), np.isin(code, [32, *range(9, 14)])
    return {
        "letter": letter, "upper": (code >= 65) & (code <= 90), "digit": digit, "stop": stop, "bang": bang, "bar": bar,
        "symbol": (code > 32) & (code < 127) & ~(letter | digit | stop | bang | bar), "high": code >= 128, "lead": code >= 192, "newline": code == 10, "space": space,
    }


CLASSES = _byte_classes()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    binary = pa.concat_arrays([pc.fill_null(texts, "")]).cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64, count=len(binary) + 1 + binary.offset)[binary.offset :]
    data = np.frombuffer(binary.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(binary) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _items(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a list array: each item's row, its code in the dictionary, the dictionary. Empty strings are left out."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    kept = pc.not_equal(flat, "")
    coded = flat.filter(kept).dictionary_encode()
    return row[kept.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def statistics(texts: pa.Array) -> np.ndarray:
    """The transformed statistics of each text, a row per text; all counts run over the whole text."""
    n = len(texts)
    data, offsets = _bytes_of(texts)
    count = {k: np.diff(np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))[offsets]) for k, table in CLASSES.items()}
    size = np.diff(offsets).astype(float)
    row, word, names = _items(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    words = np.bincount(row, minlength=n).astype(float)
    key, times = np.unique(row * (len(names) + 1) + word, return_counts=True)
    own = key // (len(names) + 1)
    distinct = np.bincount(own, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, own, times)
    same = np.bincount(row[1:][(row[1:] == row[:-1]) & (word[1:] == word[:-1])], minlength=n) if len(row) else np.zeros(n)
    ends = pc.match_substring_regex(names, r"[^\pL\pN.,;:?!'\"()\-]$") if len(names) else pa.array([], pa.bool_())
    symbol_ends = np.bincount(row, weights=ends.to_numpy(zero_copy_only=False)[word].astype(float), minlength=n) if len(row) else np.zeros(n)
    line_row, line, line_names = _items(pc.split_pattern(pc.fill_null(texts, ""), "\n"))
    lines = np.bincount(line_row, minlength=n).astype(float)
    distinct_lines = np.bincount(np.unique(line_row * (len(line_names) + 1) + line) // (len(line_names) + 1), minlength=n)
    part = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    seen = size - count["space"]
    out = np.stack(
        [
            np.log1p(size),
            np.log1p(words),
            np.log1p(seen / np.maximum(words, 1)),
            part(count["upper"], count["letter"] + count["lead"]),
            part(count["digit"], seen),
            part(count["symbol"], seen),
            part(count["stop"], seen),
            part(count["bang"], seen),
            part(count["bar"], seen),
            part(count["high"], seen),
            part(count["newline"], words),
            np.log1p(distinct) / np.maximum(np.log1p(words), 0.5),
            part(same, words),
            part(top, words) * np.minimum(1, np.log1p(words) / 5),
            part(distinct_lines, lines),
            np.log1p(words / np.maximum(lines, 1)),
            part(symbol_ends, words),
        ],
        axis=1,
    )
    return out


class Model:
    """Class means and Cholesky factors of the shrunk covariances of standardised statistics."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink_pooled: float = SHRINK_POOLED, shrink_diagonal: float = SHRINK_DIAGONAL):
        self.ready = len(x) > 0 and 0 < y.sum() < len(y)
        if not self.ready:
            return
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-6
        z = self._standard(x)
        d = z.shape[1]
        centred = np.concatenate([z[y == c] - z[y == c].mean(0) for c in (0, 1)])
        pooled = centred.T @ centred / len(z)
        self.classes = []
        for c in (0, 1):
            own = z[y == c]
            mean = own.mean(0)
            few = d / (d + len(own))  # small classes lean on the pooled covariance
            cov = (own - mean).T @ (own - mean) / len(own)
            lean = max(shrink_pooled, few)
            cov = (1 - lean) * cov + lean * pooled
            cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.classes.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(len(own) / len(z))))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        z = self._standard(x)
        a, b = (-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - 0.5 * logdet + prior for mean, inverse, logdet, prior in self.classes[::-1])
        return a - b

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / np.sqrt(x.shape[1]), -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, label of the rows of at most ``fit_rows`` ids outside the held-out fold. The ids are broadcast: that bound is their size."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isNotNull())
    taught = taught.groupBy("doc_id").agg(F.max("label").alias("label"))
    some = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(some), "doc_id")


def fit_statistics(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """label, x of at most ``fit_rows`` different labelled texts: an id may have any number of rows, and of equal rows one teaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 4 << 20):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("same"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "same", "label", "x"])

    rows = labelled(docs, labels, "quality", fit_rows).select("doc_id", F.xxhash64("text").alias("same"), "label", "text")
    each = rows.mapInArrow(run, "doc_id long, same long, label int, x array<double>").groupBy("doc_id", "same").agg(F.max("label").alias("label"), F.max("x").alias("x"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id", "same").limit(fit_rows).select("label", "x")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    rows = fit_statistics(docs, labels, fit_rows).toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(STATISTICS))
    order = np.lexsort((*x.T, rows["label"]))  # the sums don't depend on the order of tasks
    return Model(x[order], rows["label"].to_numpy()[order])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 4 << 20):
            s = shared.value.score(statistics(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = F.col(doc_id).cast("long")
    return docs.select(own.alias("doc_id"), held_out(own).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text, 4 << 20):
            yield part.filter(pa.array(shared.value.score(statistics(part.column(text))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
