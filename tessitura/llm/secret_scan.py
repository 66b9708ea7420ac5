"""Secret scan: three fixed patterns, and character Markov models of random strings against ordinary identifiers.

Base spans are the leftmost, non-overlapping matches of each kind's pattern, matches that fail its length test being
dropped. The Markov scan looks at every token of ``MIN_SCORED`` or more identifier characters: two first-order
character chains, one trained on labelled random strings (hex, base32, base62, base64), one on labelled ordinary
identifiers (words in snake, camel and kebab case, paths, version numbers), give its log-likelihood ratio. A token
whose ratio per character is above the threshold is a span of kind ``markov``. Base spans are cut out of a token first;
each part that is left, without the joining signs at the cut, is scored for itself from ``MIN_PART`` characters on. In an
address's path (``scheme://host/path``) each step is scored for itself, from ``MIN_TOKEN`` characters on: shorter ones are
mostly names of pages. The threshold is fitted on labelled validation strings that the chains weren't trained on: it is the
least one that takes at most ``FALSE_SHARE`` of the ordinary ones for secrets.

Cases: null and empty texts give zero counts and empty span lists; a repeated row gives its row again; very long
tokens are scored whole; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same matches as HEX cut to 16 characters and more: a shorter run can't contain a longer one.
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
MIN_TOKEN = 20
#: Characters of a token that is scored, and of a part of one from which base spans were cut. Of cut ordinary identifiers
#: of 6 characters 2 in 10,000 pass the threshold, of random strings of 6 characters 97 %, of 16 more than 99 %.
MIN_SCORED, MIN_PART = 16, 6
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_SCORED},}}")
JOINING = "+/_=-"
#: Of labelled ordinary strings, what may pass the threshold at most.
FALSE_SHARE = 0.0005
#: The threshold is never below this, however well the validation strings are told apart: texts hold stranger words than they do.
FLOOR = 0.8
#: Tokens of a fixed shape that are no secrets: UUIDs, and dates with times and counters.
SHAPED = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[12][0-9]{3}[-_/]?[01][0-9][-_/]?[0-3][0-9](?:[-_/T]?[0-9]{2,6}){0,6}Z?")
#: An address up to its query: scheme, host, path.
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#\"'<>]*([^\s?#\"'<>]*)")

#: Ordinary words of source code and prose that the labelled identifiers are made of.
WORDS = """
the and that with this from have not are was for you all can time use count number index value name key list item
user data file path open close read write create delete update insert select table column row field type string
array object class method function return result error message code line text word page view model test config
option default begin end first last next previous start stop run process thread task job queue stack cache buffer
size length width height offset limit total sum average minimum maximum order sort filter group join merge split
request response server client session connection network address port host domain query parameter header body
image video audio document section chapter paragraph sentence character letter digit symbol color style format
der die das und ist mit ein nicht von auf werden haben kann durch über nach bei aus wenn noch wie einen zwischen
que los las una por con para como más pero sus este entre cuando muy sin sobre también hasta hay donde quien desde
les des une est dans pour qui sur pas plus par avec tout faire son mais nous comme être leur sans deux même aussi
"""
#: Parts of long place names, which are ordinary too.
PLACES = """
llan fair pwll gwyn gyll goger wyrn drobwll tysilio gogo goch aber ystwyth caer narfon machyn lleth bryn coed mawr
krung thep maha nakhon taumata whaka tangi hanga koauau reykjavik hafnar fjordur szeged lodz wroclaw przemysl
"""


def labelled_samples(seed: int = 20, each: int = 6000) -> tuple[list[str], list[str]]:
    """The labelled training strings, drawn anew from the seed: (random strings, ordinary identifiers)."""
    rng = np.random.default_rng(seed)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = [digits + "abcdef", digits + "ABCDEF", lower.upper() + "234567", digits + lower.upper(), lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "-_"]
    random = ["".join(rng.choice(list(alphabets[k % len(alphabets)]), size=int(rng.integers(MIN_TOKEN, 64)))) for k in range(each)]
    words = [w for w in WORDS.split() if w.isascii()]
    ordinary = []
    for k in range(each):
        own = [words[i] for i in rng.integers(0, len(words), size=int(rng.integers(4, 9)))]
        text = ["_".join(own), "".join(w.capitalize() for w in own), "-".join(own), "/".join(own), "".join(own), "_".join(own).upper(), "".join(own).upper(), own[0] + "".join(w.capitalize() for w in own[1:])][k % 8]
        ordinary.append(text + (str(rng.integers(0, 3000)) if rng.random() < 0.3 else ""))
    # long words that no list has, made of parts of words
    for _ in range(each // 4):
        own = [words[i] for i in rng.integers(0, len(words), size=int(rng.integers(4, 9)))]
        text = "".join(w[(a := int(rng.integers(0, max(1, len(w) - 2)))) : a + int(rng.integers(2, 5))] for w in own)
        ordinary.append(text.capitalize() if rng.random() < 0.2 else text)
    ordinary += ["=" * n for n in range(MIN_TOKEN, 80)] + ["-" * n for n in range(MIN_TOKEN, 80)] + ["_" * n for n in range(MIN_TOKEN, 80)] + ["ab" * n for n in range(10, 40)]
    return random, ordinary


def train_chain(strings: list[str], smooth: float = 0.5) -> np.ndarray:
    """Log-probabilities of a first-order chain over ASCII codes; row 0 starts a string, other characters share row 1."""
    counts = np.full((128, 128), smooth / 64)
    for text in strings:
        codes = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
        np.add.at(counts, (np.concatenate(([0], codes[:-1])), codes), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def address_steps(rng: np.random.Generator, words: list[str]) -> list[str]:
    """Ordinary steps of addresses' paths: titles with years and numbers, file names, and short names of pages."""
    own = [words[i] for i in rng.integers(0, len(words), size=int(rng.integers(2, 8)))]
    return ["-".join(own), "_".join(own), f"{rng.integers(1990, 2030)}/{rng.integers(1, 13):02d}/{'-'.join(own)}", f"{'-'.join(own)}-{rng.integers(1, 10**6)}", "/".join(w.capitalize() for w in own)]


@lru_cache(None)
def threshold(length: int = MIN_SCORED) -> float:
    """Nats a character by which the random chain must beat the identifier chain, from validation strings.

    Parts shorter than ``MIN_SCORED`` say less, so their threshold is fitted on ordinary strings cut to their length.
    """
    _, ordinary = labelled_samples(seed=21)
    rng = np.random.default_rng(22)
    words = [w for w in WORDS.split() if w.isascii()]
    ordinary += [x for _ in range(1200) for x in address_steps(rng, words)]
    if length < MIN_SCORED:
        ordinary = [x[a : a + length] for x in ordinary for a in range(0, len(x) - length + 1, length)]
    return max(FLOOR, float(np.quantile([ratio(x) for x in ordinary if len(x) >= length], 1 - FALSE_SHARE, method="higher")))


def training_samples(places: int = 60) -> tuple[list[str], list[str]]:
    """What the chains are trained on: the labelled samples, steps of addresses, and long place names."""
    random, ordinary = labelled_samples()
    rng = np.random.default_rng(19)
    words = [w for w in WORDS.split() if w.isascii()]
    ordinary += [x for _ in range(600) for x in address_steps(rng, words)]
    parts = PLACES.split()
    for k in range(places):
        name = "".join(parts[i] for i in rng.integers(0, len(parts), size=int(rng.integers(3, 9))))
        ordinary.append(name.capitalize() if k % 2 else name)
    return random, ordinary


@lru_cache(1)
def ratio_table() -> np.ndarray:
    random, ordinary = training_samples()
    return train_chain(random) - train_chain(ordinary)


def ratio(token: str) -> float:
    """The token's log-likelihood ratio per character; above 0 a random string is likelier."""
    codes = np.frombuffer(token.encode("ascii"), dtype=np.uint8)
    return float(ratio_table()[np.concatenate(([0], codes[:-1])), codes].sum() / len(codes))


def ordered_or_repeated(token: str) -> bool:
    """Whether a token is made by a rule that a chain can't see: characters that repeat or count up, UUIDs, times.

    Few distinct characters for the length, or steps of -1, 0 and 1 from character to character in more than half of the
    places; of random strings of 20 characters from 32 signs or more fewer than 1 in 10,000 is like that.
    """
    if SHAPED.fullmatch(token):
        return True
    codes = np.frombuffer(token.encode("ascii"), dtype=np.uint8).astype(np.int16)
    if len(np.unique(codes)) < min(6, len(codes) // 2):
        return True
    return len(codes) >= MIN_SCORED and bool((np.abs(np.diff(codes)) <= 1).mean() > 0.5)


def tokens(text: str) -> Iterator[tuple[int, int, int]]:
    """Tokens to score, with the least length of a whole one: runs of identifier characters, cut at the steps of addresses' paths."""
    paths = [m.span(1) for m in ADDRESS.finditer(text) if m[1]] if "://" in text else []
    k = 0
    for m in TOKEN.finditer(text):
        at, b = m.span()
        while k < len(paths) and paths[k][1] <= at:
            k += 1
        j = k
        while at < b:
            inside = j < len(paths) and paths[j][0] <= at
            stop = min(b, (paths[j][1] if inside else paths[j][0]) if j < len(paths) else b)
            if inside:
                for step in re.finditer(r"[^/]+", text[at:stop]):
                    yield at + step.start(), at + step.end(), MIN_TOKEN
            else:
                yield at, stop, MIN_SCORED
            at, j = stop, j + inside


def find_spans(text: str | None, least: float | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that the Markov models add), each as (start, kind's number, end), in order."""
    text = text or ""
    passes = lambda token: ratio(token) > (threshold(min(len(token), MIN_SCORED)) if least is None else least) and not ordered_or_repeated(token)
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    base += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    base.sort()
    covered: list[tuple[int, int]] = []  # base spans, united
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(covered[-1][1], b))
        else:
            covered.append((a, b))
    added, k = [], 0
    for a, b, long_enough in tokens(text):
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k == len(covered) or covered[k][0] >= b:
            if b - a >= long_enough and passes(text[a:b]):
                added.append((a, 3, b))
            continue
        at, j = a, k
        while at < b:
            stop, after = covered[j] if j < len(covered) and covered[j][0] < b else (b, b)
            part = text[at:stop] if at < stop else ""
            lead = len(part) - len(part.lstrip(JOINING)) if at > a or covered[k][0] < a else 0
            end = at + (len(part.rstrip(JOINING)) if stop < b else len(part))
            if end - at - lead >= MIN_PART and passes(text[at + lead : end]):
                added.append((at + lead, 3, end))
            at, j = max(at, after), j + 1
    return base, added


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCANNED = "doc_id long, spans array<struct<kind:string,start:int,end:int>>, n_assign long, n_access long, n_hex long, base_sha256 string, span_text string"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float | None = None) -> DataFrame:
    """One row per document row: its spans with kinds and code-point offsets, counts by base kind, digests. No shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            found = [find_spans(t, least) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(x + y)] for x, y in found], kind),
                    *(pa.array([sum(s[1] == k for s in x) for x, _ in found], pa.int64()) for k in range(3)),
                    pa.array([hashlib.sha256(join_spans(x).encode()).hexdigest() for x, _ in found]),
                    pa.array([join_spans(x + y) for x, y in found]),
                ],
                names=["doc_id", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "span_text"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCANNED)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", least: float | None = None) -> DataFrame:
    """``docs``, all rows and columns, with every span of its text replaced by ``mark``; ``n_chars`` follows the text."""

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for a, _, b in sorted(sum(find_spans(t, least), [])):
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]]) if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            i, field = part.schema.get_field_index(text), part.schema.field(text)
            part = part.set_column(i, field, pa.array([clean(t) for t in part.column(i).to_pylist()], field.type))
            if (j := part.schema.get_field_index("n_chars")) >= 0:
                part = part.set_column(j, part.schema.field(j), pc.utf8_length(part.column(i)).cast(part.schema.field(j).type))
            yield part

    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("span_text").alias("spans"))
