"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters: a fixed lexicon of insults, words and word beginnings mined from the learnable labelled rows, and pattern voters
(several different insults, insults dense in the text, shouting; one insult or none, insults thinly spread). Each votes toxic, clean or
abstains. The label model sees votes only, never a label: expectation-maximisation over the votes of a sample of all
documents, labelled or not, begins at the majority of the votes and estimates for each voter its chances of voting given
either class (its accuracy), and for each pair of voters their correlation within the classes; a voter's evidence is
divided by how much of it other voters repeat. A logistic regression on features of the text (how many, how many
different and how dense insults are, and the word beginnings that tell the posteriors apart best) is trained on the
posteriors and gives the score.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 isn't 1, and only to find words: a word or beginning
is a voter if, by the lower bound of its confidence interval (``SURE`` standard errors), at least half of the labelled
documents that hold it are toxic (a beginning in ``REPEATED`` of their words at least, and one per ``PER_CHARACTERS``); near copies count once. Bounded samples: ``fit_rows`` labelled rows, about
``sample_rows`` documents for the label model and the classifier, chosen by hashes. Nothing else is bounded.

Cases: null and empty texts have no insult and get the classifier's score of that; without labels of both classes the
fixed lexicon alone votes; one made-up text per insult and as many empty ones are part of every sample, so that an empty
table or one without insults gives a model too; documents labelled twice count once, with the larger label; repeated rows
are scored each; extra columns are ignored; scores use the text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, held_out, materialise, text_slices
from .quality import FIT_ROWS, _items, labelled

#: Insults, each a whole word.
LEXICON = """
idiot idiots moron morons loser losers scum trash worthless pathetic stupid disgusting clown clowns dumb imbecile
fool retard bastard bitch asshole jerk dickhead shithead bullshit filth vermin degenerate creep freak pig swine
idioten trottel abschaum dummkopf arschloch imbécile crétin connard salaud ordure idiota estúpido imbécil basura payaso
"""
#: Lengths of word beginnings, which are written with a trailing ``*`` and stand for longer words.
BEGINNINGS = (4, 5, 6, 7)
#: Words of a text that must have a beginning before it counts, and per how many characters: one alone, or a few in a very
#: long text, may be ordinary words that begin so.
REPEATED, PER_CHARACTERS = 2, 1000
#: Standard errors of the confidence bound, and the share of toxic documents that it must reach.
SURE, PRECISE = 2.0, 0.5
#: Documents that the label model and the classifier see, about.
SAMPLE_ROWS = 20_000
#: Word beginnings among the classifier's features, and their length.
FEATURES, FEATURE_LENGTH = 100, 6
#: Correlations within the classes below this count as none: the dependency structure is kept sparse.
SPARSE = 0.5
#: Pattern voters follow the word voters in a vote vector.
PATTERNS = ("several", "dense", "shouted", "few", "thin")
SLICE = 4 << 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the texts' words (runs of letters, lower case): each one's row and its code in the dictionary of words."""
    parted = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    return _items(pc.ascii_split_whitespace(parted))


def beginnings(words: pa.Array, length: int) -> pa.Array:
    """The first letters of longer words; null for the others."""
    return pc.if_else(pc.greater(pc.utf8_length(words), length), pc.utf8_slice_codeunits(words, 0, length), pa.scalar(None, words.type))


def copy_key(text: str | None) -> int:
    """The least hash of the text's word 5-shingles: near copies mostly share it."""
    words = (text or "").split()
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))), default=0)


def one_of_each(rows: DataFrame) -> DataFrame:
    """Labelled rows without most copies, which would lend their rare words the weight of many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            yield part.append_column("key", pa.array([copy_key(t) for t in part.column("text").to_pylist()], pa.int64()))

    # a bounded sample: its rows are spread over all cores
    keyed = rows.select("label", "text").repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "label int, text string, key long")
    return keyed.groupBy("label", "key").agg(F.min("text").alias("text")).select("label", "text")


def _needed(texts: pa.Array) -> np.ndarray:
    """How many words with a beginning each text must have."""
    return np.maximum(REPEATED, pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False) / PER_CHARACTERS)


def _by_document(row: np.ndarray, code: np.ndarray, names: pa.Array, needed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, str]]:
    """For whole words and each length of beginnings: distinct (row, code) with the codes' dictionary, and the mark of a beginning."""
    for length in (0, *BEGINNINGS):
        coded = (beginnings(names, length) if length else names).dictionary_encode()
        own = coded.indices.to_numpy(zero_copy_only=False) if not coded.null_count else pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        at = own.astype(np.int64)[code] if len(code) else np.zeros(0, np.int64)
        key, times = np.unique(row[at >= 0] * (len(coded.dictionary) + 1) + at[at >= 0], return_counts=True)
        key = key[times >= (needed[key // (len(coded.dictionary) + 1)] if length else 1)]
        yield key // (len(coded.dictionary) + 1), key % (len(coded.dictionary) + 1), coded.dictionary, "*" if length else ""


def sure_share(toxic, clean, sure: float = SURE):
    """Lower bound of the toxic share among documents of which so many are toxic and clean (Wilson's interval)."""
    n = toxic + clean
    p, z = toxic / n, sure**2 / n
    return (p + z / 2 - (z * p * (1 - p) + z * z / 4) ** 0.5) / (1 + z)


def mine(rows: DataFrame) -> list[str]:
    """Words (of three letters at least) and beginnings by which labelled documents are toxic rather than clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            label = part.column("label").to_numpy(zero_copy_only=False)
            for at, code, names, mark in _by_document(*words_of(part.column("text")), _needed(part.column("text"))):
                toxic = np.bincount(code, weights=label[at], minlength=len(names)).astype(np.int64)
                total = np.bincount(code, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(names.cast(pa.string()), mark, ""), pa.array(toxic), pa.array(total - toxic)], names=["stem", "toxic", "clean"])

    counts = one_of_each(rows).mapInArrow(run, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sure = sure_share(F.col("toxic").cast("double"), F.col("clean").cast("double"))
    strong = counts.where(F.col("toxic") > F.col("clean")).where((sure >= PRECISE) & (F.length("stem") >= 3))
    chosen: list[str] = []
    taken: set[str] = set()  # all beginnings of what is chosen
    for r in strong.orderBy(F.desc(F.round(sure, 9)), F.length("stem"), "stem").select("stem").collect():
        plain = r["stem"].rstrip("*")
        own = {plain[:k] for k in range(1, len(plain) + 1)}
        if plain not in taken and not any(x + "*" in chosen for x in own):  # else a surer one stands for the same words
            chosen.append(r["stem"])
            taken |= own
    return chosen


class Voters:
    """The votes and insult counts of texts, for a given list of words and beginnings."""

    def __init__(self, stems: list[str]):
        self.names = sorted(set(stems) | set(LEXICON.split()))

    def _hits(self, words: pa.Array) -> np.ndarray:
        """For each word, the voters that it calls: a column for the whole word and for each length, -1 for none."""
        out = np.full((len(words), 1 + len(BEGINNINGS)), -1)
        for column, length in enumerate((0, *BEGINNINGS)):
            own = [k for k, name in enumerate(self.names) if name.endswith("*") == bool(length) and (not length or len(name) == length + 1)]
            if own and len(words):
                found = pc.index_in(beginnings(words, length) if length else words, pa.array([self.names[k].rstrip("*") for k in own], words.type), skip_nulls=True)
                found = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
                out[:, column] = np.where(found >= 0, np.array([*own, -1])[found], -1)
        return out

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, pa.Array]]:
        """(votes: 1 toxic, -1 clean, 0 abstains; counts of insults as features; the words)."""
        row, code, words = spoken = words_of(texts)
        n, m = len(texts), len(self.names)
        hits, needed = self._hits(words), _needed(texts)
        votes = np.zeros((n, m + len(PATTERNS)), dtype=np.int8)
        insult = np.zeros(len(code), bool)
        for column in range(hits.shape[1]):
            own = hits[code, column] if len(code) else code
            token = np.flatnonzero(own >= 0)
            key, back, times = np.unique(row[token] * (m + 1) + own[token], return_inverse=True, return_counts=True)
            counts = times >= (needed[key // (m + 1)] if column else 1)
            votes[key[counts] // (m + 1), key[counts] % (m + 1)] = 1
            insult[token[counts[back]]] = True
        at, what = row[insult], code[insult]
        places = np.bincount(at, minlength=n)
        different = np.bincount(np.unique(at * (len(words) + 1) + what) // (len(words) + 1), minlength=n)
        length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        dense = places / (1 + length / 1000)
        shouted = np.zeros(n, bool)
        for i in np.flatnonzero(places).tolist():
            shouted[i] = sum(map(str.isupper, texts[i].as_py())) > 0.3 * length[i]
        votes[:, m:] = np.stack([(different >= 4) | (different >= 2) & (dense >= 1), (dense >= 1) & (places >= 2), shouted, -(places <= 1).astype(int), -((places > 1) & (dense < 1)).astype(int)], axis=1)
        return votes, np.stack([np.log1p(places), np.log1p(different), np.log1p(dense), different >= 2], axis=1).astype(float), spoken


class LabelModel:
    """Generative model of votes: class balance, voters' vote chances by class, correlations within the classes. No labels.

    The balance is that of the majority votes; estimated along, it and the weakest voters would carry each other away.
    """

    def __init__(self, votes: np.ndarray, rounds: int = 40):
        tally = votes.sum(axis=1, dtype=int)
        post = np.where(tally >= 2, 0.95, np.where(tally == 1, 0.5, 0.02))  # the majority of the votes
        self.balance = float(np.clip((tally >= 1).mean(), 1e-3, 0.5))
        kinds = [(votes == v).astype(float) for v in (1, -1, 0)]
        for _ in range(rounds):
            weights = [post, 1 - post]
            # chances[class][vote][voter], smoothed
            self.chances = [np.stack([(w @ k + s) / (w.sum() + 2) for k, s in zip(kinds, (0.5, 0.5, 1.0), strict=True)]) for w in weights]
            self.correlations = self._correlations(votes, weights)
            self.share = 1 / self.correlations.sum(axis=1)
            new = self.posterior(votes)
            settled = np.abs(new - post).max() < 1e-4
            post = new
            if settled:
                break
        self.accuracy = self.chances[0][0] / (self.chances[0][0] + self.chances[1][0])

    @staticmethod
    def _correlations(votes: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        """Correlation of each pair of voters once the class is known, averaged over the classes; only agreement repeats evidence."""
        total = np.zeros((votes.shape[1],) * 2)
        for kind in ((votes == 1).astype(float), (votes == -1).astype(float)):
            for w in weights:
                centred = (kind - (w @ kind) / w.sum()) * np.sqrt(w)[:, None]
                total += centred.T @ centred
        spread = np.sqrt(np.maximum(np.diag(total), 1e-9))
        out = total / spread[:, None] / spread[None, :]
        out[out < SPARSE] = 0
        np.fill_diagonal(out, 1)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.chances[0]) - np.log(self.chances[1])
        each = np.where(votes == 1, ratio[0], np.where(votes == -1, ratio[1], 0))  # who abstains says nothing
        return 1 / (1 + np.exp(-np.clip(each @ self.share + np.log(self.balance / (1 - self.balance)), -30, 30)))


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.2, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _starts(words: pa.Array) -> pa.Array:
    return pc.utf8_slice_codeunits(words, 0, FEATURE_LENGTH)


class Model:
    """Voters, the classifier's word beginnings and weights; ``label_model`` is kept for those who look into it."""

    def __init__(self, voters: Voters, label_model: LabelModel | None, starts: list[str], weights: np.ndarray):
        self.voters, self.label_model, self.starts, self.weights = voters, label_model, starts, weights

    def features(self, counts: np.ndarray, spoken: tuple[np.ndarray, np.ndarray, pa.Array]) -> np.ndarray:
        """Insult counts, and which of the beginnings a text has, weighed down by how many words it has at all."""
        row, code, words = spoken
        n = len(counts)
        out = np.zeros((n, len(self.starts)))
        if len(words) and self.starts:
            found = pc.fill_null(pc.index_in(_starts(words), pa.array(self.starts, words.type)), -1).to_numpy(zero_copy_only=False)[code]
            out[row[found >= 0], found[found >= 0]] = 1
            out /= np.sqrt(1 + np.bincount(row, minlength=n) / 100)[:, None]
        return np.concatenate([counts, out], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        _, counts, spoken = self.voters.rows(texts)
        return 1 / (1 + np.exp(-np.clip(self.features(counts, spoken) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """About so many documents, by a hash of id and text."""
    step = 1 << 40
    kept = min(step, -(-rows * step // max(1, docs.count())))
    return docs.select("text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) < kept)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, sample_rows: int = SAMPLE_ROWS) -> Model:
    spark = docs.sparkSession
    voters = Voters(mine(labelled(docs, labels, "toxic", fit_rows)))
    insults = LEXICON.split()
    made = [f"{a} {b}" for a, b in zip(insults, insults[1:] + insults[:1], strict=True)] + [""] * len(insults)
    sample = materialise(_sample(docs.select("doc_id", "text"), sample_rows).unionByName(spark.createDataFrame([(t,) for t in made], "text string")).repartition(spark.sparkContext.defaultParallelism), "sample")
    m = len(voters.names) + len(PATTERNS)
    shared = spark.sparkContext.broadcast(voters)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            votes, _, _ = shared.value.rows(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in votes], pa.binary())], names=["votes"])

    def matrix(raw, kind, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(x) for x in raw), dtype=kind).reshape(-1, width)

    votes = matrix(sorted(bytes(x) for x in sample.mapInArrow(voted, "votes binary").toPandas()["votes"]), np.int8, m)
    model = LabelModel(votes)
    with_labels = spark.sparkContext.broadcast((voters, model))

    def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, model = with_labels.value
        for part in text_slices(batches, "text", SLICE):
            votes, _, (row, code, words) = voters.rows(part.column("text"))
            post = model.posterior(votes)
            coded = _starts(words).dictionary_encode()
            key = np.unique(row * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)[code]) if len(row) else np.zeros(0, np.int64)
            at, what = key // (len(coded.dictionary) + 1), key % (len(coded.dictionary) + 1)
            # whole thousandths: sums don't depend on the order of tasks
            toxic = np.bincount(what, weights=np.round(1000 * post[at]), minlength=len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(toxic), pa.array(1000 * np.bincount(what, minlength=len(coded.dictionary)) - toxic)], names=["start", "toxic", "clean"])

    split = sample.mapInArrow(told_apart, "start string, toxic long, clean long").groupBy("start").agg((F.sum("toxic") / 1000).alias("toxic"), (F.sum("clean") / 1000).alias("clean"))
    share, n = float(np.clip(model.posterior(votes).mean(), 1e-6, 1 - 1e-6)), F.col("toxic") + F.col("clean")
    apart = F.abs(F.col("toxic") - share * n) / F.sqrt(share * (1 - share) * n)
    starts = sorted(r["start"] for r in split.where(n >= 5).orderBy(F.desc(F.round(apart, 6)), "start").limit(FEATURES).collect())
    unfitted = Model(voters, model, starts, np.zeros(0))
    ready = spark.sparkContext.broadcast(unfitted)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ready.value
        for part in text_slices(batches, "text", SLICE):
            votes, counts, spoken = own.voters.rows(part.column("text"))
            x = np.concatenate([own.features(counts, spoken), own.label_model.posterior(votes)[:, None]], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["x"])

    x = matrix(sorted(bytes(v) for v in sample.mapInArrow(seen, "x binary").toPandas()["x"]), np.float32, 4 + len(starts) + 1).astype(float)
    discard(sample)
    return Model(voters, model, starts, fit_linear(x[:, :-1], x[:, -1]))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.voters, None, model.starts, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            s = shared.value.score(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own_id = F.col(doc_id).cast("long")
    return docs.select(own_id.alias("doc_id"), held_out(own_id).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
