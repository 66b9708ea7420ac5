"""Sequence queries. Embeddings stand in for frames: a recording is a label, its frames are the vectors by id."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import arrays as A
from tessitura.functions import audio, lookups
from tessitura.operators import alignment, sequences

from .text_queries import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    return e.select(F.col("label").alias("key"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.numbered(_vectors(spark, sf_dir), "key", "vec_id").select("key", "frame", "vec_id", "vec")


_FRAMES = "select label as key, vec_id, row_number() over (partition by label order by vec_id) - 1 as frame, cast(embedding as double[]) as vec from embeddings where embedding is not null and label is not null"

#: Token ids of a text: its words' lengths modulo 5, of which 0 is blank.
_IDS = "transform(split(text, ' '), w -> length(w) % 5)"
_SQL_IDS = "list_transform(string_split(text, ' '), lambda w: length(w) % 5)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_IDS).alias("ids"))


@query(f"with t as (select doc_id, {_SQL_IDS} as a from documents) select doc_id, array_to_string(list_filter(a, lambda x, i: i = 1 or x <> a[i - 1]), ',') as ids from t")
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", F.array_join(A.collapse_repeats(F.col("ids")).cast("array<string>"), ",").alias("ids"))


@query(f"with t as (select doc_id, {_SQL_IDS} as a from documents) select doc_id, array_to_string(list_filter(a, lambda x, i: (i = 1 or x <> a[i - 1]) and x <> 0), ',') as ids from t")
def ctc_greedy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", F.array_join(A.ctc_greedy(F.col("ids")).cast("array<string>"), ",").alias("ids"))


@query(f"with t as (select doc_id, {_SQL_IDS} as a from documents) select doc_id, array_to_string(list_filter(a, lambda x: x <> 0), ',') as ids, array_to_string(a[-7:], ',') as newest from t")
def drop_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("ids")
    return _tokens(spark, sf_dir).select("doc_id", F.array_join(F.filter(ids, lambda x: x != 0).cast("array<string>"), ",").alias("ids"), F.array_join(A.newest(ids, 7).cast("array<string>"), ",").alias("newest"))


@query(f"select vec_id, cast(list_position(vec, list_max(vec)) - 1 as int) as best, cast(list_position(v2, list_max(v2)) - 1 as int) as allowed from (select vec_id, vec, list_transform(vec, lambda x, i: case when i = list_position(vec, list_max(vec)) then cast('-inf' as double) else x end) as v2 from ({_FRAMES}))")
def frame_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).withColumn("best", A.argmax(F.col("vec")))
    return f.select("vec_id", "best", A.argmax(A.ban(F.col("vec"), F.col("best"))).alias("allowed"))


@query(f"select vec_id, round(list_max(e) / list_sum(e), 6) as top_p, round(-ln(list_sum(e)), 6) as top_log_p from (select vec_id, list_transform(vec, lambda x: exp(x - list_max(vec))) as e from ({_FRAMES}))")
def frame_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec")
    return _frames(spark, sf_dir).select("vec_id", F.round(F.array_max(A.softmax(v)), 6).alias("top_p"), F.round(F.array_max(A.log_softmax(v)), 6).alias("top_log_p"))


@query(f"select a.key, a.frame, round(list_sum(list_transform(a.vec, lambda x, i: x * b.vec[i])), 6) as dot, round(list_sum(list_transform(a.vec, lambda x: greatest(x, 0.0))), 6) as positive from ({_FRAMES}) a join ({_FRAMES}) b on a.key = b.key and b.frame = a.frame + 1")
def frame_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    after = f.select("key", (F.col("frame") - 1).alias("frame"), F.col("vec").alias("next"))
    return f.join(after, ["key", "frame"]).select("key", "frame", F.round(A.dot(F.col("vec"), F.col("next")), 6).alias("dot"), F.round(A.total(A.relu(F.col("vec"))), 6).alias("positive"))


@query(f"select vec_id, round(list_sum(list_transform(n, lambda x, i: x * i)), 4) as weighted, round(n[1], 5) as first, round(n[-1], 5) as last from (select vec_id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)) / len(c) + 1e-5)) as n from (select vec_id, list_transform(vec, lambda x: x - list_sum(vec) / len(vec)) as c from ({_FRAMES})))")
def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.layer_norm(F.col("vec"))
    weighted = A.total(F.transform(n, lambda x, i: x * (i + 1)))
    return _frames(spark, sf_dir).select("vec_id", F.round(weighted, 4).alias("weighted"), F.round(F.get(n, 0), 5).alias("first"), F.round(F.element_at(n, -1), 5).alias("last"))


M, N = 7, 6
#: Dimensions of a vector of ``embeddings``.
WIDTH = 64


@query(
    f"""with f as ({_FRAMES}), g as (select key, list(vec order by frame) as v from f group by key),
i as (select key, v, unnest(range(0, cast(ceil(len(v) / {N}.0) as int))) as i from g),
s as (select key, i, flatten(list_transform(range(0, {M}), lambda j: v[greatest(0, least(i * {N} + j - {(M - 1) // 2}, len(v) - 1)) + 1])) as s from i)
select key, cast(i as int) as frame, cast(len(s) as int) as width, round(list_sum(s), 6) as total, round(s[1], 6) as first, round(s[-1], 6) as last from s"""
)
def lfr_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir)
    s = sequences.stack_rows(sequences.numbered(f, "key", "vec_id", total="frames"), "key", "frame", "vec", M, N, "frames").withColumnRenamed("stacked", "s")
    return s.select("key", "frame", F.size("s").alias("width"), F.round(A.total(F.col("s")), 6).alias("total"), F.round(F.get("s", F.lit(0)), 6).alias("first"), F.round(F.element_at("s", -1), 6).alias("last"))


@query(
    f"""with f as ({_FRAMES}), u as (select key, frame, unnest(vec) as x, unnest(range(0, len(vec))) as d from f),
m as (select key, d, avg(x) as mean, stddev_pop(x) as sd from u group by key, d)
select u.key, u.frame, round(sum((x - mean) / sd), 5) as total, round(max((x - mean) / sd), 5) as most from u join m on u.key = m.key and u.d = m.d group by u.key, u.frame"""
)
def cmvn_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift and scale from each recording's own mean and deviation by dimension, as two arrays on each frame."""
    f = _frames(spark, sf_dir)
    own = _vectors(spark, sf_dir)
    made = f.join(sequences.moments(own, "key", "vec", WIDTH), "key").withColumn("v", A.cmvn(F.col("vec"), F.col("shift"), F.col("scale")))
    return made.select("key", "frame", F.round(A.total(F.col("v")), 5).alias("total"), F.round(F.array_max("v"), 5).alias("most"))


_RUN_ROWS = "select conv_id as key, turn as frame, case when turn % 4 < 2 then length(text) % 3 else conv_id % 3 end as token from conversations"


def _run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("frame"), F.expr("cast(case when turn % 4 < 2 then length(text) % 3 else conv_id % 3 end as int)").alias("token"))


_RUNS = f"""with t as ({_RUN_ROWS}), n as (select *, case when row_number() over w = 1 or token is distinct from lag(token) over w then 1 else 0 end as turned from t window w as (partition by key order by frame)),
r as (select *, sum(turned) over (partition by key order by frame) as run from n),
g as (select key, run, min(frame) as first, max(frame) as last, min(token) as value, count(*) as length from r group by key, run)"""


@query(_RUNS + " select key, cast(run as bigint) as run, first, last, value, length from g")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(_run_rows(spark, sf_dir), "key", "frame", "token").select("key", "run", "first", "last", F.col("value").cast("long").alias("value"), "length")


@query(
    _RUNS + ", s as (select *, sum(length) over (partition by key) as frames from g) select key, cast(run as bigint) as run, value, round(greatest((first * 60 - 30) / 1000.0, 0.0), 3) as start_s,"
    " round(least(((last + 1) * 60 - 30) / 1000.0, (frames * 60 - 30) / 1000.0), 3) as end_s from s where value <> 0"
)
def run_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.run_timestamps(_run_rows(spark, sf_dir), "key", "frame", "token").withColumn("value", F.col("value").cast("long"))


TAPS, BEFORE = [0.1, 0.2, -0.3, 0.25, 0.05], 2


@query(
    f"""with f as (select key, frame, vec[1] as x from ({_FRAMES})) select key, frame, round(x + {' + '.join(f'coalesce(lag(x, {BEFORE - k}) over w, 0) * {t}' if BEFORE >= k else f'coalesce(lead(x, {k - BEFORE}) over w, 0) * {t}' for k, t in enumerate(TAPS))}, 6) as y,
cast(sum(case when x > 0 then 1 else 0 end) over (partition by key order by frame rows between 19 preceding and current row) as double) as speech from f window w as (partition by key order by frame)"""
)
def memory_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).select("key", "frame", F.get("vec", F.lit(0)).alias("x"), F.when(F.get("vec", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("loud"))
    y = sequences.memory_filter(f, "key", "frame", "x", TAPS, BEFORE, "y")
    return sequences.sliding_sum(y, "key", "frame", "loud", 20, "speech").select("key", "frame", F.round("y", 6).alias("y"), F.round("speech", 0).alias("speech"))


_D = 8
_RATES = [math.exp(-i * math.log(10_000) / (_D / 2 - 1)) for i in range(_D // 2)]


@query(f"with f as ({_FRAMES}) select key, frame, " + ", ".join([f"round(sin((frame + 1) * {r!r}), 6) as s{i}" for i, r in enumerate(_RATES)] + [f"round(cos((frame + 1) * {r!r}), 6) as c{i}" for i, r in enumerate(_RATES)]) + " from f")
def position_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.position_encoding((F.col("frame") + 1).cast("double"), _D)
    return _frames(spark, sf_dir).withColumn("p", p).select("key", "frame", *[F.round(F.get("p", F.lit(i)), 6).alias(f"s{i}") for i in range(_D // 2)], *[F.round(F.get("p", F.lit(_D // 2 + i)), 6).alias(f"c{i}") for i in range(_D // 2)])


@query(f"with f as ({_FRAMES}) select key, frame, " + ", ".join([f"round(sin((frame + 1 + vec_id % 1000) * {r!r}), 6) as s{i}" for i, r in enumerate(_RATES)] + [f"round(cos((frame + 1 + vec_id % 1000) * {r!r}), 6) as c{i}" for i, r in enumerate(_RATES)]) + " from f")
def position_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of frames behind those that former pushes had."""
    p = A.position_encoding((F.col("frame") + 1 + F.col("vec_id") % 1000).cast("double"), _D)
    return _frames(spark, sf_dir).withColumn("p", p).select("key", "frame", *[F.round(F.get("p", F.lit(i)), 6).alias(f"s{i}") for i in range(_D // 2)], *[F.round(F.get("p", F.lit(_D // 2 + i)), 6).alias(f"c{i}") for i in range(_D // 2)])


#: Vectors that make a waveform of one frame and some samples.
_IN_WAVE = 7


@query(
    f"""with u as (select key, frame // {_IN_WAVE} as wave, frame % {_IN_WAVE} * {WIDTH} + d as t, x * 32768 as x from (select key, frame, unnest(vec) as x, unnest(range(len(vec))) as d from ({_FRAMES}))),
a as (select key, wave, t, x - avg(x) over (partition by key, wave) as x from u where t < 400 qualify count(*) over (partition by key, wave) = 400),
y as (select key, wave, t, (x - 0.97 * coalesce(lag(x) over (partition by key, wave order by t), x)) * (0.54 - 0.46 * cos(2 * pi() * t / 399)) as y from a),
p as (select key, wave, k, pow(sum(y * cos(2 * pi() * k * t / 512)), 2) + pow(sum(y * sin(2 * pi() * k * t / 512)), 2) as p from y, (select unnest(range(257)) as k) group by all),
c as (select 1127 * ln(1 + 20 / 700.0) as low, (1127 * ln(1 + 8000 / 700.0) - 1127 * ln(1 + 20 / 700.0)) / 81 as step),
m as (select m, k, greatest(0, least((1127 * ln(1 + k * 31.25 / 700) - low - m * step) / step, (low + (m + 2) * step - 1127 * ln(1 + k * 31.25 / 700)) / step)) as weight from c, (select unnest(range(80)) as m), (select unnest(range(257)) as k)),
e as (select key, wave, m, ln(greatest(sum(p * weight), 1.1920929e-07)) as e from p join m using (k) where weight > 0 group by all)
select key, wave, round(sum(e), 4) as total, round(sum(e * (m + 1)), 3) as weighted, round(max(e), 5) as most from e group by key, wave"""
)
def log_mel_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-mel energies of waveforms of seven vectors each, against a Fourier sum written out."""
    waves = _frames(spark, sf_dir).groupBy("key", F.floor(F.col("frame") / _IN_WAVE).alias("wave")).agg(F.array_sort(F.collect_list(F.struct("frame", "vec"))).alias("own"))
    samples = F.flatten(F.transform("own", lambda x: x["vec"]))
    found = waves.select("key", "wave", F.explode(audio.log_mel_frames(samples)).alias("e"))
    weighted = A.total(F.transform("e", lambda x, m: x * (m + 1)))
    return found.select("key", "wave", F.round(A.total(F.col("e")), 4).alias("total"), F.round(weighted, 3).alias("weighted"), F.round(F.array_max("e"), 5).alias("most"))


@query("with w as (select doc_id, string_split(text, ' ') as w from documents), i as (select doc_id, w, unnest(range(0, greatest(cast(ceil(len(w) / 20.0) as int), 1))) as i from w) select doc_id, cast(i as int) as part, array_to_string(w[i * 20 + 1:(i + 1) * 20], ' ') as words from i")
def mini_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(A.chunks(F.split("text", " "), 20)).alias("part", "w"))
    return parts.select("doc_id", "part", F.array_join("w", " ").alias("words"))


@query("select event_id, user_id, (row_number() over (partition by user_id order by event_id) - 1) // 8 as batch from events")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.batches(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 8)


@query("with v as (select distinct length(w) % 5 as id from (select unnest(string_split(text, ' ')) as w from documents) where length(w) % 5 < 4), t as (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from documents) select doc_id, string_agg('p' || id, '' order by i) as text, count(*) as n from t join v on length(w) % 5 = id group by doc_id")
def vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by their pieces through a join; id 4 is outside the vocabulary."""
    vocabulary = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "id int, piece string")
    rows = _tokens(spark, sf_dir).select("doc_id", F.posexplode("ids").alias("i", "token"))
    found = sequences.pieces_to_text(rows, vocabulary, "doc_id", "i", "token")
    return found.select("doc_id", F.array_join("pieces", "").alias("text"), F.size("pieces").cast("long").alias("n"))


@query(f"with t as (select doc_id, len(string_split(text, ' ')) * 53 as n from documents) select doc_id, cast(case when n < 400 then 0 else (n - 400) // 160 + 1 end as int) as frames, round(n * 1000.0 / 16000, 4) as elapsed_ms from t")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", " ")) * 53
    return table(spark, sf_dir, "documents").select("doc_id", A.frame_count(n).alias("frames"), F.round(A.elapsed_ms(n), 4).alias("elapsed_ms"))


@query(f"with f as (select vec_id, vec from ({_FRAMES})), i as (select vec_id, vec, unnest(range(0, case when len(vec) < 16 then 0 else (len(vec) - 16) // 6 + 1 end)) as i from f) select vec_id, cast(i as int) as frame, round(list_sum(vec[i * 6 + 1:i * 6 + 16]), 6) as total from i")
def overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _frames(spark, sf_dir).select("vec_id", F.posexplode(A.framing(F.col("vec"), 16, 6)).alias("frame", "w"))
    return w.select("vec_id", "frame", F.round(A.total(F.col("w")), 6).alias("total"))


@query(f"with f as (select vec_id, list_transform(vec, lambda x: x - list_sum(vec) / len(vec)) as v from ({_FRAMES})) select vec_id, round(list_sum(list_transform(v, lambda x, i: abs(x - 0.97 * v[greatest(i - 1, 1)]))), 5) as energy, round(1127 * ln(1 + (vec_id % 8000) / 700.0), 6) as mel from f")
def preemphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.total(F.transform(A.preemphasis(F.col("vec")), F.abs))
    return _frames(spark, sf_dir).select("vec_id", F.round(e, 5).alias("energy"), F.round(A.mel(F.col("vec_id") % 8000), 6).alias("mel"))


@query(f"with f as (select vec_id, list_transform(vec, lambda x: cast(round_even(x * 1000, 0) as int)) as l, list_reverse(list_transform(vec, lambda x: cast(round_even(x * 1000, 0) as int))) as r from ({_FRAMES})) select vec_id, round(list_sum(list_transform(l, lambda x, i: abs((cast(cast(x as double) / 32768 as float) + cast(cast(r[i] as double) / 32768 as float)) / 2) * 32768)), 3) as level from f")
def pcm_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.transform("vec", lambda x: F.bround(x * 1000, 0).cast("int"))
    mono = A.downmix(A.from_int16(left), A.from_int16(F.reverse(left)))
    return _frames(spark, sf_dir).select("vec_id", F.round(A.total(F.transform(A.scale(mono.cast("array<double>"), 32768.0), F.abs)), 3).alias("level"))


@query(f"select vec_id, cast(len(p) as int) as width, round(list_sum(list_transform(p, lambda x, i: x * i)), 4) as total, p[-1] as last from (select vec_id, list_resize(vec, 60 + vec_id % 20, cast(0.5 as double)) as p from (select vec_id, vec[:50 + cast(vec_id % 10 as int)] as vec from ({_FRAMES})))")
def padded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 50 to 59 values, padded to 60 to 79."""
    cut = F.slice("vec", F.lit(1), (50 + F.col("vec_id") % 10).cast("int"))
    p = A.pad(cut, (60 + F.col("vec_id") % 20).cast("int"), 0.5)
    made = _frames(spark, sf_dir).select("vec_id", p.alias("p"))
    return made.select("vec_id", F.size("p").alias("width"), F.round(A.total(F.transform("p", lambda x, i: x * (i + 1))), 4).alias("total"), F.element_at("p", -1).alias("last"))


@query()
def forced_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames' scores against ten tokens per recording; tested against all paths on small cases."""
    f = _frames(spark, sf_dir)
    targets = f.select("key").distinct().withColumn("tokens", F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: ((F.col("key") + i * 7) % 63 + 1).cast("int")))
    return alignment.forced_align(f.withColumn("logp", A.log_softmax(F.col("vec"))), targets, "key", "frame", "logp")


_VOCABULARY = ["the", "and", "of", "to", "in", "<unk>"]


@query(f"select doc_id, array_to_string(list_transform(string_split(lower(text), ' '), lambda w: coalesce(list_position({_VOCABULARY!r}, w) - 1, {len(_VOCABULARY) - 1})), ',') as ids from documents")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lookups.token_ids(F.split(F.lower("text"), " "), _VOCABULARY)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("select lang, round(avg(case when y <> -1 then case when p = y then 1.0 else 0.0 end end), 6) as accuracy, round(sum(n) * 10.0 * 6 / 1000.0, 4) as audio_s from (select lang, doc_id % 3 as p, case when doc_id % 5 = 0 then -1 else length(text) % 3 end as y, length(text) as n from documents) group by lang")
def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 3).alias("p"), F.expr("case when doc_id % 5 = 0 then -1 else length(text) % 3 end").alias("y"), F.length("text").alias("n"))
    return d.groupBy("lang").agg(F.round(lookups.token_accuracy(F.col("p"), F.col("y")), 6).alias("accuracy"), F.round(lookups.audio_seconds(F.col("n")), 4).alias("audio_s"))


@query("with v as (select label, vec_id, embedding from embeddings), f as (select label, min(vec_id) as m from v group by label) select d.doc_id, round(list_sum(cast(v.embedding as double[])), 6) as total from documents d left join f on d.doc_id % 13 = f.label left join v on v.vec_id = f.m")
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector by id: each label's first; documents whose id has none have null."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 13).alias("id"))
    return lookups.embed(d, e, "id").select("doc_id", F.round(A.total(F.col("vector").cast("array<double>")), 6).alias("total"))


@query(
    """with t as (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from documents), e as (select *, regexp_matches(w, '^[a-zA-Z'']+$') as english from t),
n as (select *, case when english is distinct from lag(english) over (partition by doc_id order by i) then 1 else 0 end as turned from e), r as (select *, sum(turned) over (partition by doc_id order by i) as run from n)
select doc_id, cast(run as bigint) as run, english, string_agg(w, ' ' order by i) as words from r group by doc_id, run, english"""
)
def language_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return sequences.language_runs_of_arrays(words, "doc_id", "words").select("doc_id", "run", "english", F.array_join("tokens", " ").alias("words"))
