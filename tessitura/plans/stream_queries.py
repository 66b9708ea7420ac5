"""Segmentation and latency queries. Events stand in for a detector's output: a stream is a user, ordered by (ts, id)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import arrays as A
from tessitura.functions.audio import encode_floats
from tessitura.operators import latency, ordered, segmentation as S
from tessitura.sources import frames as logs
from tessitura.sources.shared import shared_folder
from tessitura.streaming import audio, endpoints, jobs, sink
from tessitura.streaming.session import Limits

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


_EVENTS = "select user_id as key, event_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type, value, case when event_type in ('click', 'purchase') then 'start' when event_type in ('view', 'error') then 'end' end as kind, cast(row_number() over (partition by user_id order by ts, event_id) * 480.0 as double) as time_ms from events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered by user, in ranges of their time: a user with a third of all events isn't one task."""
    kind = F.when(F.col("event_type").isin("click", "purchase"), "start").when(F.col("event_type").isin("view", "error"), "end")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", "value", kind.alias("kind"), "ts", seconds.alias("_s"))
    numbered = ordered.number(e, "key", "_s", "seq", ["ts", "event_id"]).withColumn("seq", F.col("seq") + 1)
    return numbered.select("key", "event_id", "seq", "event_type", "value", "kind", (F.col("seq") * 480.0).cast("double").alias("time_ms"))


_GATED = f"with e as (select * from ({_EVENTS}) where kind is not null), g as (select *, lag(kind) over (partition by key order by seq) as b from e), a as (select key, event_id, seq, kind, time_ms from g where kind <> b or (b is null and kind = 'start'))"


@query(_GATED + " select key, event_id, seq, kind, time_ms from a")
def gate_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("kind is not null")
    return S.alternate(e, "key", "seq").select("key", "event_id", F.col("seq").cast("long").alias("seq"), "kind", "time_ms")


@query(_GATED + f", t as (select key, max(time_ms) as m from ({_EVENTS}) group by key), s as (select key, kind, time_ms, lead(time_ms) over (partition by key order by seq) as n from a) select s.key, time_ms as start_ms, coalesce(n, m) as end_ms from s join t on s.key = t.key where kind = 'start'")
def gate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    ends = e.groupBy("key").agg(F.max("time_ms").alias("stream_ms"))
    return S.pair_segments(S.alternate(e.where("kind is not null"), "key", "seq"), "key", "seq", "time_ms", ends)


_PAIRS = "case event_id % 5 when 0 then array({a}, -1.0D) when 1 then array(-1.0D, {b}) when 2 then array({a}, {b}) when 3 then array(-1.0D, -1.0D) else array({a}) end"


@query(f"with e as ({_EVENTS}) select event_id, kind, time_ms from (select event_id, 'start' as kind, time_ms + 10.0 as time_ms from e where event_id % 5 in (0, 2) union all select event_id, 'end', time_ms + 100.5 from e where event_id % 5 in (1, 2))")
def interval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(F.expr(_PAIRS.format(a="cast(time_ms + 10.0 as double)", b="cast(time_ms + 100.5 as double)")))
    e = _events(spark, sf_dir).select("event_id", F.explode(S.interval_events(pairs)).alias("e"))
    return e.select("event_id", "e.kind", "e.time_ms")


@query("with e as (select user_id as key, event_id, ts, case when event_type = 'signup' then 'fmt' || (event_id % 3) end as setting from events) select key, event_id, coalesce(last_value(setting ignore nulls) over (partition by key order by ts, event_id rows between unbounded preceding and current row), 'float32') as format from e")
def format_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("setting", F.when(F.col("event_type") == "signup", F.concat(F.lit("fmt"), (F.col("event_id") % 3).cast("string"))))
    return S.carry_forward(e, "key", "seq", "setting", "float32", "format").select("key", "event_id", "format")


@query("select event_id, cast(greatest(0, least(round_even(value * 16000 / 1000.0, 0), 100000)) as bigint) as rounded, cast(floor(value * 16000 / 1000) as bigint) as cut, round((event_id % 1000) * 1000.0 / 16000 + value, 6) as stream_ms from events where value is not null")
def sample_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", A.sample_index(v, F.lit(100_000).cast("long")).alias("rounded"), A.sample_index_truncated(v).alias("cut"), F.round(S.rebase(v, F.col("event_id") % 1000), 6).alias("stream_ms"))


_SEGMENTS = "select user_id as key, event_id, event_id * 37 % 9000 as start, event_id * 37 % 9000 + cast(floor(abs(value)) as bigint) * 3 as \"end\" from events where value is not null"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select(F.col("user_id").alias("key"), "event_id", (F.col("event_id") * 37 % 9000).alias("start"), (F.col("event_id") * 37 % 9000 + F.floor(F.abs("value")).cast("long") * 3).alias("end"))


@query(f"with s as ({_SEGMENTS}), m as (select key, event_id, greatest(0, start, coalesce(max(\"end\") over (partition by key order by start, \"end\", event_id rows between unbounded preceding and 1 preceding), 0)) as start, least(\"end\", 9100) as \"end\" from s) select key, event_id, start as start_at, \"end\" as end_at from m where \"end\" - start >= 4")
def segments_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).withColumn("total", F.lit(9100).cast("long"))
    kept = S.at_least(S.keep_apart(s, "key", ["end", "event_id"], "total"), 4)
    return kept.select("key", "event_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(f"with s as (select * from ({_SEGMENTS}) where \"end\" > start), c as (select key, event_id as chunk, greatest(start - 160, 0) as lo, start + 480 as hi from s) select s.key, s.event_id, c.chunk, greatest(lo, start) as \"from\", least(hi, \"end\") as \"to\" from s join c on s.key = c.key and lo < \"end\" and hi > start")
def lookback_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (with a look-back margin) against segments of the same stream."""
    s = _segments(spark, sf_dir).where("`end` > start")
    chunks = s.select("key", F.col("event_id").alias("chunk"), F.greatest(F.col("start") - 160, F.lit(0)).alias("lo"), (F.col("start") + 480).alias("hi"))
    return S.slice_chunks(chunks, s, "key", 640).select("key", "event_id", "chunk", "from", "to")


@query("select event_id, (1.0 - s) >= (s + 0.5) as speech from (select event_id, (event_id * 7919 % 1000) / 1000.0 as s from events)")
def speech_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.is_speech((F.col("event_id") * 7919 % 1000) / 1000.0).alias("speech"))


@query("select event_type as label, count(value) as n, round(avg(v), 2) as mean_ms, round(quantile_cont(v, 0.5), 2) as median_ms, round(quantile_cont(v, 0.95), 2) as p95_ms, round(min(v), 2) as min_ms, round(max(v), 2) as max_ms from (select event_type, value, cast(value as double) as v from events) group by event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency.summarise(table(spark, sf_dir, "events").withColumnRenamed("event_type", "label"), "label", "value")


_P95 = "select event_type as label, user_id % 12 as frames, cast(quantile_cont(cast(value as double), 0.95) as double) as p from events group by event_type, user_id % 12"


@query(
    f"""with p as ({_P95}), b as (select label, round(avg(p), 6) as budget_ms from p group by label), o as (select *, lead(frames) over w as nf, lead(p) over w as np from p window w as (partition by label order by frames)),
f as (select o.*, budget_ms, row_number() over (partition by o.label order by frames desc) as k from o join b on o.label = b.label where p <= budget_ms)
select b.label, b.budget_ms, f.frames as max_measured_frames, case when np - p > 0 then cast(floor(frames + (f.budget_ms - p) / (np - p) * (nf - frames)) as bigint) end as interpolated_frames from b left join f on f.label = b.label and k = 1"""
)
def budget_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = e.groupBy(F.col("event_type").alias("label"), (F.col("user_id") % 12).alias("frames")).agg(F.percentile(F.col("value").cast("double"), 0.95).alias("p95_ms"))
    budgets = p.groupBy("label").agg(F.round(F.avg("p95_ms"), 6).alias("budget"))
    return latency.recommend(p.join(budgets, "label"), "budget")


@query("select user_id as key, array_to_string(list_sort(list_distinct(list(cast(floor(value) as bigint)))), ',') as loads from events group by user_id")
def distinct_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.array_join(F.sort_array(F.collect_set(F.floor("value").cast("long"))).cast("array<string>"), ",").alias("loads"))


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    a, b = "cast(time_ms - 200 as double)", "cast(time_ms + 150 as double)"
    pairs = F.array(F.expr(f"case kind when 'start' then array({a}, -1.0D) when 'end' then array(-1.0D, {b}) else array(-1.0D, -1.0D) end"))
    ends = e.groupBy("key").agg(F.max("seq").alias("_last"))
    last = F.col("seq") == F.col("_last")
    return e.join(ends, "key").select(F.col("key").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.lit(7680).cast("long").alias("samples"), pairs.alias("intervals"), last.alias("is_final"), F.lit(None).cast("string").alias("control"))


_GATE = f"""with recursive e as (select key, seq, kind, time_ms, max(seq) over (partition by key) as n from ({_EVENTS})),
s as (select key, cast(0 as bigint) as seq, false as speaking, cast(0 as double) as opened, cast(null as varchar) as said, cast(null as double) as said_ms, cast(null as varchar) as closed, cast(null as double) as closed_ms from e group by key
union all select key, seq, turned and not capped and not last, opened, said, said_ms, case when turned and capped then 'forced_end' when turned and last then 'end' end, case when turned and (capped or last) then time_ms end
from (select *, time_ms - opened >= 30000 as capped from (select e.key, e.seq, e.time_ms, e.seq = e.n as last,
case when kind = 'start' then true when kind = 'end' then false else speaking end as turned,
case when kind = 'start' and not speaking then time_ms - 200 else opened end as opened,
case when (kind = 'start' and not speaking) or (kind = 'end' and speaking) then kind end as said,
case when kind = 'start' and not speaking then time_ms - 200 when kind = 'end' and speaking then time_ms + 150 end as said_ms
from s join e on e.key = s.key and e.seq = s.seq + 1)))"""


@query(_GATE + " select key as stream_id, seq, said as kind, said_ms as time_ms from s where said is not null union all select key, seq, closed, closed_ms from s where closed is not null")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, ends and forced ends of the session fold, against a recursive query."""
    return jobs.fold_sessions(_pushes(spark, sf_dir)).where("kind in ('start', 'end', 'forced_end')").select("stream_id", "seq", "kind", "time_ms")


_CONTROLS = f"""with recursive e as (select key, seq, kind, time_ms, case when event_type = 'signup' then 'reset' when event_id % 11 = 0 then 'eof' end as control from ({_EVENTS})),
s as (select key, cast(0 as bigint) as seq, false as speaking, cast(0 as bigint) as pushed, cast(null as varchar) as said, cast(null as double) as said_ms from e group by key
union all select e.key, e.seq, case when control is not null then false when kind = 'start' then true when kind = 'end' then false else speaking end,
case when control = 'reset' then 0 when control = 'eof' then pushed else pushed + 1 end,
case when control = 'eof' and speaking then 'end' when control is null and ((kind = 'start' and not speaking) or (kind = 'end' and speaking)) then kind end,
case when control = 'eof' then pushed * 480.0 when kind = 'start' then time_ms - 200 else time_ms + 150 end
from s join e on e.key = s.key and e.seq = s.seq + 1)"""


@query(_CONTROLS + " select key as stream_id, seq, said as kind, cast(said_ms as double) as time_ms from s where said is not null")
def session_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with flushes and resets in their middle; a reset says nothing and starts the stream's clock again."""
    e = _events(spark, sf_dir)
    control = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_id") % 11 == 0, "eof")
    a, b = "cast(time_ms - 200 as double)", "cast(time_ms + 150 as double)"
    pairs = F.expr(f"case when control is not null then array() when kind = 'start' then array(array({a}, -1.0D)) when kind = 'end' then array(array(-1.0D, {b})) else array() end")
    pushes = e.withColumn("control", control).select(
        F.col("key").alias("stream_id"), "seq", F.when(F.col("control").isNull(), 7680).otherwise(0).cast("long").alias("samples"), pairs.cast("array<array<double>>").alias("intervals"), F.lit(False).alias("is_final"), "control"
    )
    return jobs.fold_sessions(pushes, limits=Limits(segment_ms=1e12)).where("kind in ('start', 'end')").select("stream_id", "seq", "kind", "time_ms")


@query()
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, cap, look-back, partial and final results of every stream; tested by scripted traces and in streaming."""
    return jobs.fold_sessions(_pushes(spark, sf_dir))


#: The detector as a recursion over frames of 10 ms: 20 frames' flags as bits, 15 of them begin and end speech, 40 frames of look-back, the wait for silence
#: (185 frames, 5 after a minute of speech, none after two) looked up at each minute's border, at most 6000 frames a segment.
_DETECTOR = f"""with recursive e as (select key, seq, cast(case when value % 10 < 0 then (value % 10 + 10) % 10 else value % 10 end / 10 as float) as s from ({_EVENTS})),
f as (select key, (seq - 1) * 30 + k as t, cast(coalesce(cast(1 as float) - s >= s + cast(0.5 as float), false) as bigint) as flag from e, (select unnest(range(30)) as k)),
z as (select distinct key, cast(-1 as bigint) as t, cast(0 as bigint) as m, false as talking, cast(null as bigint) as began, cast(0 as bigint) as quiet, cast(0 as bigint) as spoken, false as latched, cast(0 as bigint) as last_end, cast(185 as bigint) as wait, cast(null as bigint) as a, cast(null as bigint) as b from e
union all select key, t, case when ended then 0 else m1 end, talks and not ended, case when not ended then began1 end, case when ended then 0 else quiet1 end, case when ended then 0 else spoken1 end, latched1 and not ended,
  case when ended and stop > first then stop else last_end end, wait1, case when ended and stop > first then first end, case when ended and stop > first then stop end
from (select *, not opens and began is not null and ((quiet1 > 0 and quiet1 >= wait1) or t - began + 1 > 6000) as ended, case when quiet1 > 0 and quiet1 >= wait1 then t - greatest(0, wait1 - 11) else t end as stop, greatest(began, last_end, 0) as first
from (select *, case when opens or talking or talks then 0 else quiet + 1 end as quiet1, case when opens then greatest(t - 40, last_end, 0) else began end as began1
from (select *, not talking and talks and began is null as opens
from (select *, case when talking then bit_count(m1) > 15 else bit_count(m1) >= 15 end as talks, case when not border then wait when spoken1 = 0 then 185 when spoken1 = 60000 then 5 else 0 end as wait1
from (select *, case when border and (began is not null or latched) then spoken + 60000 else spoken end as spoken1, latched or (border and (began is not null or latched)) as latched1
from (select f.key, f.t, f.t > 0 and f.t % 6000 = 0 as border, ((m << 1) & 1048575) | flag as m1, talking, began, quiet, spoken, latched, last_end, wait from z join f on f.key = z.key and f.t = z.t + 1))))))),
l as (select key, max(t) as t from z group by key)
select key, a * 10 as start_ms, b * 10 as end_ms from z where a is not null
union all select z.key, greatest(began, last_end, 0) * 10, (z.t + 1) * 10 from z join l on z.key = l.key and z.t = l.t where began is not null and z.t + 1 > greatest(began, last_end, 0)"""


@query(_DETECTOR)
def offline_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint detection over silence probabilities, each user's values, thirty frames an event; against a recursive query."""
    e = _events(spark, sf_dir)
    frames = e.select("key", "seq", (F.pmod(F.col("value"), F.lit(10.0)) / 10).alias("silence"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    return endpoints.detect_segments(frames.withColumn("o", F.col("seq") * 30 + F.col("k")), "key", "o", "silence")


@query(
    """with f as (select label as key, row_number() over (partition by label order by vec_id) - 1 as frame, embedding from embeddings where embedding is not null and label is not null),
x as (select key, frame * 64 + unnest(range(64)) as pos, cast(unnest(embedding) as double) as x from f),
s as (select key, frame, case frame % 5 when 1 then greatest(frame * 64 - 96, 0) else frame * 64 end as first, case frame % 5 when 4 then frame * 64 + 16 else frame * 64 + 64 end as stop from f where frame % 5 > 0)
select s.key as stream_id, frame as seq, first as from_sample, stop as to_sample, round(sum(x), 5) as total from s join x on x.key = s.key and pos >= first and pos < stop group by all"""
)
def audio_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact slices of the audio that a recogniser is fed: each label's vectors are pushes of 4 ms, and speech begins 6 ms before a push."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    pushes = ordered.number(e.select(F.col("label").alias("stream_id"), "vec_id", "embedding"), "stream_id", "vec_id", "seq")
    at = F.col("seq") * 4
    pair = F.when(F.col("seq") % 5 == 1, F.array(at - 6.0, F.lit(-1.0))).when(F.col("seq") % 5 == 4, F.array(F.lit(-1.0), at + 1.0))
    frames = pushes.select("stream_id", "seq", F.lit("binary").alias("kind"), encode_floats("embedding").alias("payload"), F.when(pair.isNotNull(), F.array(pair)).alias("intervals"))
    fed = audio.fold_audio(frames, model=audio.Model(Limits(look_back_ms=10.0, segment_ms=1e9))).where("kind = 'fed'")
    return fed.select("stream_id", "seq", "from_sample", "to_sample", F.round(A.total(F.transform("audio", lambda x: x.cast("double"))), 5).alias("total"))


@query(
    """with e as (select user_id, event_id, ts, event_type, case when event_type = 'signup' then case event_id % 3 when 0 then 'int16' when 1 then 'float32' else 'float64' end end as asked,
  case when user_id % 2 = 0 then 'int16' else 'float32' end as opened from events),
f as (select *, coalesce(last_value(case when asked <> 'float64' then asked end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), opened) as form from e)
select 'results' as output, cast(user_id as varchar) as stream_id, '{"type":"ready","format":"' || opened || '"}' as value from (select distinct user_id, opened from e)
union all select 'results', cast(user_id as varchar), '{"type":"config","format":"' || asked || '"}' from f where asked <> 'float64'
union all select 'errors', cast(user_id as varchar), case when asked = 'float64' then '{"type":"error","message":"no such format: float64"}' else '{"type":"error","message":"3 bytes hold no whole ' || form || ' samples"}' end from f where asked = 'float64' or event_type = 'error'"""
)
def frame_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of frames, a stream per user, through the streaming source, the stateful decoder and the repeatable sink.

    Signups change the format (to an unknown one at times), errors are payloads of three bytes; what was said about them is read
    back from the sink.
    """
    e = _events(spark, sf_dir)
    asked = F.element_at(F.array(F.lit("int16"), F.lit("float32"), F.lit("float64")), (F.col("event_id") % 3 + 1).cast("int"))
    folder, out, checkpoint = (shared_folder(spark, name) for name in ("frames", "written", "checkpoint"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, then in order; a log is open until the next key."""
        fs, place = pafs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, own in groupby(rows, key=itemgetter(0)):
            with fs.open_output_stream(f"{place}/{key}{logs.SUFFIX}", buffer_size=1 << 16) as log:
                log.write(logs.encode_frames([("open", f"/?format={'int16' if key % 2 == 0 else 'float32'}".encode())]))
                for _, event_type, form in own:
                    frame = ("text", f'{{"type": "config", "format": "{form}"}}'.encode()) if event_type == "signup" else ("binary", b"\0" * (3 if event_type == "error" else 4))
                    log.write(logs.encode_frames([frame]))
            yield pa.RecordBatch.from_pydict({"key": [key]})

    rows = e.select("key", "event_type", asked.alias("asked"), "seq").repartition("key").sortWithinPartitions("key", "seq")
    rows.drop("seq").mapInArrow(write, "key long").write.format("noop").mode("overwrite").save()
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, jobs.ROCKSDB)
    try:
        running = sink.write_frames(audio.stream_audio(logs.read_frames_stream(spark, folder)), out, checkpoint).start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    finally:
        spark.conf.set(provider, before)
    written = [sink.read_written(spark, out, name).select(F.lit(name).alias("output"), "stream_id", "value") for name in ("results", "errors")]
    return written[0].unionByName(written[1])
