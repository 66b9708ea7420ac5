"""Dictionary lookups and token measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def token_ids(tokens: Column, vocabulary: list[str]) -> Column:
    """Ids of tokens; unknown ones get the last entry's. The vocabulary is a literal map: for large ones join instead."""
    table = F.create_map(*[F.lit(x) for i, t in enumerate(vocabulary) for x in (t, i)])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(len(vocabulary) - 1)))


def tokens_of(ids: Column, vocabulary: list[str]) -> Column:
    """Tokens of ids; ids outside the vocabulary are left out."""
    table = F.array(*[F.lit(t) for t in vocabulary])
    return F.transform(F.filter(ids, lambda i: (i >= 0) & (i < len(vocabulary))), lambda i: F.get(table, i))


def embed(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each row with the vector of its key; keys without a vector have null. Spark broadcasts the table if it is small."""
    return rows.join(table.select(key, "vector"), key, "left")


def choose_text_norm(explicit: Column, use_itn: Column, ids: dict[str, int]) -> Column:
    """An explicit choice, else by the flag; an unknown explicit choice is an error."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    known = F.try_element_at(table, explicit)
    return F.when(explicit.isNotNull(), F.coalesce(known, F.raise_error(F.concat(F.lit("unknown text norm "), explicit)).cast("int"))).when(use_itn, F.lit(ids["withitn"])).otherwise(F.lit(ids["woitn"]))


# Ids of the query tokens that a recogniser is asked with.
LANGUAGE_IDS = {"auto": 0, "zh": 3, "en": 4, "yue": 7, "ja": 11, "ko": 12, "nospeech": 13}
TEXT_NORM_IDS = {"withitn": 14, "woitn": 15}


def language_id(language: Column, ids: dict[str, int] | None = None) -> Column:
    """The query token of a language; unknown and null ones get that of ``auto``."""
    known = LANGUAGE_IDS if ids is None else ids
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), language), F.lit(known.get("auto", 0)))


def default_key(given: Column, source: Column) -> Column:
    """A row's key: the one that was given, else its source."""
    return F.coalesce(given, source)


def tiled_key(index: Column, keys: list[str]) -> Column:
    """The key of the ``index``-th row (from 0): a list that is shorter than the rows is repeated. Null for an empty list."""
    return F.get(F.array(*map(F.lit, keys)), F.pmod(index, F.lit(len(keys))).cast("int")) if keys else F.lit(None).cast("string")


def token_accuracy(predicted: Column, target: Column, ignored: int = -1) -> Column:
    """Aggregate: the share of equal tokens, ignored targets left out; null where there is none."""
    return F.avg(F.when(target != ignored, (predicted == target).cast("double")))


def audio_seconds(frames: Column, shift_ms: float = 10.0, stacked: int = 6) -> Column:
    """Aggregate: seconds of audio behind stacked frames."""
    return F.sum(frames) * shift_ms * stacked / 1000.0


def register(spark: SparkSession) -> None:
    """The Arrow functions by name, for SQL."""
    from .audio import decode_pcm, encode_floats, fbank, json_command, load_wav

    for name, f in {"decode_pcm": decode_pcm, "encode_floats": encode_floats, "load_wav": load_wav, "fbank": fbank, "json_command": json_command}.items():
        spark.udf.register(name, f)
